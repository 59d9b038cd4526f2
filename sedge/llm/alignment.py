"""Two tokenizers aligned: which tokens of one cover the same bytes as which of the other, counted over the corpus.

Both tokenizers are reversible here: the tokens of each join to the same bytes, a space and the text. The ends of both token sequences, as
running sums of their lengths, are merged; places where both end cut the text into groups, and every token of one side in a group is linked to
every token of the other. Inside mapInPandas each document becomes one row of its own figures and one row for each different pair of ids that it
links, with the times it does. These rows are written once. Spark counts the documents of each pair, takes the greatest count of each id on either
side (as many rows as the vocabulary has), and joins both back: the HOT most frequent pairs, at most so many rows, are broadcast and summed by
document before anything moves; the others meet their counts in a shuffle, where no pair has more than 1 / HOT of the rows.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sedge.llm.packing import Encoder, _byte_letters, default_tokenizer
from sedge.llm.pieces import cut, unique
from sedge.llm.tokencount import _begins, default_model
from sedge.session import stored

#: Entries of the table of pieces; bytes aligned at a time; links of a group that are written out one by one; pairs broadcast; rows of a batch.
KEPT, CHUNK, SMALL, HOT, BATCH = 100_000, 500_000, 4096, 100_000, 1 << 16
#: Bits of a token id in a key.
BITS = 20
_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, times long"


class ByteTokens:
    """The byte-level tokenizer: ids by an encoder equal to the library's that takes special strings for text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Encoder(path)
        self.encoder.special = []
        letter = _byte_letters()
        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else b""

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8 with the space before it."""
        return self.encoder.encode([r.decode() for r in raws])


class PieceTokens:
    """The sentencepiece model: texts are cut where no piece can reach over (see tokencount), pieces seen before come from a table."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of this model holds a space or a line feed inside: texts can't be cut there")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.whole = {b" ": [self.sp.piece_to_id("▁")]}  # a space that nothing follows
        self.table: dict[bytes, list[int]] = dict(self.whole)

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8 with the space that the library adds."""
        out = []
        for raw in raws:
            out.append([self._encoded([part])[0] for part in cut(raw, CHUNK, _begins)] if len(raw) > 2 * CHUNK else None)
        whole = self._encoded([r for r, o in zip(raws, out) if o is None])
        rest = iter(whole)
        return [next(rest) if o is None else np.concatenate(o) for o in out]

    def _encoded(self, raws: list[bytes]) -> list[np.ndarray]:
        raw = b"".join(raws)
        if not raw:
            return [np.zeros(0, np.int64) for _ in raws]
        buf = np.frombuffer(raw, np.uint8)
        start = _begins(buf)
        at = np.concatenate([[0], np.cumsum([len(t) for t in raws])])
        start[at[:-1][at[:-1] < at[-1]]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        first, of = unique(buf, starts, ends)
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        got = list(map(self.table.get, keys))
        new = [i for i, ids in enumerate(got) if ids is None]
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            texts = [keys[i][keys[i][0] == 32 :].decode() for i in part]
            for i, ids in zip(part, self.sp.encode(texts, num_threads=1)):
                got[i] = ids[keys[i][0] == 10 :]  # without the space that the library puts before a line feed
        if len(self.table) + len(new) > KEPT:
            self.table = self.whole | dict(zip(keys, got))
        else:
            self.table.update((keys[i], got[i]) for i in new)
        length = np.fromiter(map(len, got), np.int64, len(got))
        ids, begin = np.fromiter(chain.from_iterable(got), np.int64, int(length.sum())), np.cumsum(length) - length
        n = length[of]
        stop = np.cumsum(n)
        ids = ids[np.repeat(begin[of] - stop + n, n) + np.arange(stop[-1])]
        edge = np.concatenate([[0], stop])[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


class Aligner:
    """Both tokenizers; one for each Python worker."""

    made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a: str, b: str):
        self.sides = (ByteTokens(a), PieceTokens(b))
        if max(len(s.bytes) for s in self.sides) > 1 << BITS:
            raise ValueError(f"a vocabulary has more than 2 ** {BITS} entries")
        self.widths = [np.array([len(x) for x in s.bytes], np.int64) for s in self.sides]
        self.flat, self.places = [np.frombuffer(b"".join(s.bytes), np.uint8) for s in self.sides], [np.cumsum(w) - w for w in self.widths]
        # An id as text with what follows it: more of its side, the other side, the next group.
        self.shown = [np.array([[f"{i}{end}".encode() for end in ends] for i in range(len(s.bytes))], object) for s, ends in zip(self.sides, (",|", ",;"))]

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls.made:
            cls.made[a, b] = cls(a, b)
        return cls.made[a, b]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides for each text; None where it has none or one side doesn't give its bytes."""
        raws = [f" {t}".encode() if t else b"" for t in texts]
        a, b = [s.encode(raws) for s in self.sides]
        fits = [bool(r) for r in raws]
        for s, ids in enumerate((a, b)):
            for i, same in self._gives_back(s, ids, raws, fits):
                fits[i] = same
        return [(x, y) if f else None for f, x, y in zip(fits, a, b)]

    def _gives_back(self, s: int, ids: list[np.ndarray], raws: list[bytes], asked: list[bool]):
        """(text, whether a side's tokens join to its bytes) of the texts asked for, all compared at once."""
        width, flat, at = self.widths[s], self.flat[s], self.places[s]
        size = {i: int(width[ids[i]].sum()) for i, f in enumerate(asked) if f}
        whole = [i for i, n in size.items() if n == len(raws[i])]
        yield from ((i, False) for i in size.keys() - set(whole))
        if whole:
            x = np.concatenate([ids[i] for i in whole]).astype(np.int64)
            stop = np.cumsum(width[x])
            joined = flat[np.repeat(at[x] - stop + width[x], width[x]) + np.arange(stop[-1])]
            equal = joined == np.frombuffer(b"".join([raws[i] for i in whole]), np.uint8)
            begin = np.concatenate([[0], np.cumsum([size[i] for i in whole])[:-1]])
            yield from zip(whole, np.logical_and.reduceat(equal, begin).tolist())

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """(figures of each text, keys (text, a, b) of its different pairs in order, times that each is linked)."""
        held = self.tokens(texts)
        out = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups_sha256": [""] * len(texts)}
        which = [i for i, h in enumerate(held) if h]
        if not which:
            return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = [np.concatenate([held[i][s].astype(np.int64) for i in which]) for s in (0, 1)]
        ends = [np.cumsum(w[x]) for w, x in zip(self.widths, ids)]
        last = [np.cumsum([len(held[i][s]) for i in which]) for s in (0, 1)]  # texts end at tokens of both sides
        at = np.minimum(np.searchsorted(ends[1], ends[0]), len(ends[1]) - 1)
        both = ends[1][at] == ends[0]
        stop = [np.flatnonzero(both) + 1, at[both] + 1]  # where groups end on either side
        begin = [np.concatenate([[0], x[:-1]]) for x in stop]
        n = [y - x for x, y in zip(begin, stop)]
        text = np.searchsorted(last[0], begin[0], "right")  # of each group, among `which`
        groups, links = np.bincount(text, minlength=len(which)), np.zeros(len(which), np.int64)
        np.add.at(links, text, n[0] * n[1])

        # Tokens of both sides in order of groups, first a's, then b's, each with what follows it.
        of = [np.repeat(np.arange(len(x)), x) for x in n]
        place = [np.arange(len(ids[0])) + begin[1][of[0]], np.arange(len(ids[1])) + stop[0][of[1]]]
        shown = np.empty(len(ids[0]) + len(ids[1]), object)
        for s in (0, 1):
            ended = np.zeros(len(ids[s]), np.int64)
            ended[stop[s] - 1] = 1
            shown[place[s]] = self.shown[s][ids[s], ended]
        shown, edge = shown.tolist(), np.concatenate([[0], last[0] + last[1]]).tolist()
        for k, i in enumerate(which):
            out["n_a"][i], out["n_b"][i], out["n_groups"][i], out["n_links"][i] = len(held[i][0]), len(held[i][1]), int(groups[k]), int(links[k])
            out["groups_sha256"][i] = hashlib.sha256(b"".join(shown[edge[k] : edge[k + 1]])[:-1]).hexdigest()

        row = np.array(which)[text]
        return out, *_totals(list(_pairs(row, ids, begin, n)))


def _pairs(row: np.ndarray, ids: list, begin: list, n: list):
    """(keys, times) of all links, group by group; a large group's by its different ids."""
    size = n[0] * n[1]
    small = np.flatnonzero(size <= SMALL)
    total = np.cumsum(size[small])
    for lo, hi in zip(edges := np.unique([0, *np.searchsorted(total, np.arange(1 << 22, total[-1], 1 << 22)), len(small)]) if len(small) else [], edges[1:]):
        g = np.repeat(small[lo:hi], size[small[lo:hi]])
        k = np.arange(len(g)) - np.repeat(np.cumsum(size[small[lo:hi]]) - size[small[lo:hi]], size[small[lo:hi]])
        a, b = ids[0][begin[0][g] + k // n[1][g]], ids[1][begin[1][g] + k % n[1][g]]
        keys = row[g] << 2 * BITS | a << BITS | b
        yield np.unique(keys, return_counts=True)
    for g in np.flatnonzero(size > SMALL).tolist():
        (a, x), (b, y) = [np.unique(ids[s][begin[s][g] : begin[s][g] + n[s][g]], return_counts=True) for s in (0, 1)]
        yield (row[g] << 2 * BITS | a[:, None] << BITS | b[None]).ravel(), (x[:, None] * y[None]).ravel()


def _totals(found: list) -> tuple[np.ndarray, np.ndarray]:
    keys, times = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(times, new)


def _frame(columns: dict) -> pd.DataFrame:
    """Rows of linked(), null where columns has nothing."""
    n, names = len(columns["row"]), [c.split()[0] for c in _ROWS.split(", ")]
    return pd.DataFrame({c: pd.Series(columns[c] if c in columns else [None] * n, dtype=None if isinstance(columns.get(c), np.ndarray) else object) for c in names})


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """docs -> a row of figures for each document, and a row (row, a, b, times) for each different pair of ids that it links."""

    def run(batches):
        aligner, row = Aligner.of(a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, at = batch["text"].astype(object).where(batch["text"].notna(), None).tolist(), 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and size < CHUNK and len(some) < 1 << 16:
                    some.append(texts[at + len(some)])
                    size += len(some[-1] or "")
                figures, keys, times = aligner.align(some)
                own = {"row": row + np.arange(len(some)), "doc_id": batch["doc_id"].iloc[at : at + len(some)].tolist(), **figures}
                yield _frame(own)
                for k in range(0, len(keys), BATCH):
                    key = keys[k : k + BATCH]
                    pair = {"row": row + (key >> 2 * BITS), "a": key >> BITS & (1 << BITS) - 1, "b": key & (1 << BITS) - 1, "times": times[k : k + BATCH]}
                    yield _frame(pair)
                row += len(some)
                at += len(some)

    return docs.mapInPandas(run, _ROWS)


def pair_counts(links: DataFrame) -> DataFrame:
    """links (row, a, b, ...) -> a, b, documents, best_a, best_b: the documents of each pair, and whether no pair of its a (its b) has more."""
    counts = stored(links.groupBy("a", "b").agg(F.count("*").alias("documents")), "pairs")
    for side in ("a", "b"):  # maxima: a row for each entry of a vocabulary, at most
        most = counts.groupBy(side).agg(F.max("documents").alias(f"best_{side}"))
        counts = counts.join(F.broadcast(most), side)
    return counts.select("a", "b", "documents", *[(F.col(f"best_{s}") == F.col("documents")).alias(f"best_{s}") for s in ("a", "b")])


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256.

    a is the file of a byte-level BPE of the tokenizers library, b a sentencepiece model. n_best (n_best_b) counts the links whose pair is linked
    in as many documents as any pair of its a id (its b id), ties included; count_sum sums over links the documents of their pair. One row for each
    row; each row is a document of its own, so doc_id may be null or repeat, and copies count. Null and empty texts, and those that either side
    doesn't give back byte for byte (b takes U+2581 for a space), have no tokens: zeros and ''. Very long texts are aligned whole: memory holds
    the tokens of one text and its different pairs. Other columns are ignored; no rows give none.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(linked(found, a or default_tokenizer(), b or default_model()), "alignment")
    links = found.where("a is not null").select("row", "a", "b", "times")
    counts = stored(pair_counts(links), "counts")
    common = counts.orderBy(F.desc("documents"), "a", "b").limit(hot)
    near = links.join(F.broadcast(common), ["a", "b"])
    far = links.join(F.broadcast(common.select("a", "b")), ["a", "b"], "left_anti").join(counts, ["a", "b"])
    names = {"n_best": F.col("times") * F.col("best_a").cast("long"), "n_best_b": F.col("times") * F.col("best_b").cast("long"), "count_sum": F.col("times") * F.col("documents")}
    sums = [x.groupBy("row").agg(*[F.sum(v).alias(k) for k, v in names.items()]) for x in (near, far)]
    sums = sums[0].unionByName(sums[1]).groupBy("row").agg(*[F.sum(k).alias(k) for k in names])
    own = found.where("a is null").join(sums, "row", "left")
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in names], "groups_sha256")
