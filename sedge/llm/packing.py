"""Packing of token sequences: online, in bounded space, best fit.

Each partition keeps at most OPEN windows of SIZE tokens. Whole windows of a long document leave at once; the rest of
it goes to the open window with the least room that holds it. When none does and all OPEN are open, the fullest is
filled to the brim with the head of the piece and leaves. At a partition's end its windows are merged to one tail below
SIZE tokens; the tails of all partitions, one each, are merged in the order of the partitions, and what is left of
that, below SIZE, is cut at powers of two. So no sequence needs padding, and memory holds OPEN windows a task.

Tokens: the text is cut before a space that no white space follows; the pretokenizer of the byte-level BPE always
breaks there, so pieces can be encoded alone. Pieces seen before come from a table of bounded size, the others go to a
fast encoder with the same vocabulary; texts with the vocabulary's special strings go to the library itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sedge.llm.pieces import cut, unique
from sedge.session import stored

SIZE, OPEN, END = 1024, 16, 0
#: Entries of the table of pieces; characters encoded at a time.
KEPT, CHUNK = 400_000, 1_500_000
#: Bytes that surely begin no white space: it lies at or below \x20 or begins with one of four lead bytes.
_SAFE = np.array([b > 32 and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts; one for each Python worker."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for w, i in ranks.items():
            self.width[i] = len(w)
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces; those that begin with a space and a character of a word all at once."""
        pieces.sort(key=_alone)
        n_safe = sum(not _alone(p) for p in pieces)
        parts = [np.array(self.fast.encode_ordinary(b"".join(pieces[:n_safe]).decode()), np.uint32)]
        ends = np.cumsum([len(p) for p in pieces[:n_safe]])
        cuts = [np.searchsorted(np.cumsum(self.width[parts[0]]), ends) + 1] if n_safe else []
        at = len(parts[0])
        for p in pieces[n_safe:]:
            parts.append(np.array(self.fast.encode_ordinary(p.decode()), np.uint32))
            at += len(parts[-1])
            cuts.append([at])
        ids, cuts = np.concatenate(parts), np.concatenate(cuts).astype(np.int64)
        first, n = len(self.table), len(pieces)
        while len(self.start) < first + n:
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        begins = np.concatenate([[0], cuts[:-1]])
        self.start[first : first + n], self.length[first : first + n] = begins + self.used, cuts - begins
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.table.update(zip(pieces, range(first, first + n)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        raws = [b"" if i in odd else t.encode() for i, t in enumerate(texts)]
        long = {i for i, r in enumerate(raws) if len(r) > 2 * CHUNK}
        out = self._encoded([b"" if i in long else r for i, r in enumerate(raws)])
        for i in long:
            out[i] = np.concatenate([self._encoded([part])[0] for part in cut(raws[i], CHUNK, _begins)])
        for i in odd:
            out[i] = np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _encoded(self, raws: list[bytes]) -> list[np.ndarray]:
        raw = b"".join(raws)
        if not raw:
            return [np.zeros(0, np.uint32) for _ in raws]
        buf = np.frombuffer(raw, np.uint8)
        start = _begins(buf)
        at = np.concatenate([[0], np.cumsum([len(t) for t in raws])])
        start[at[:-1][at[:-1] < at[-1]]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        first, of = unique(buf, starts, ends)
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        got = list(map(self.table.get, keys))
        new = [keys[i] for i, k in enumerate(got) if k is None]
        if new:
            if len(self.table) + len(new) > KEPT:
                self._clear()
                new = list(keys)
            self._learn(new)
            got = list(map(self.table.__getitem__, keys))
        k = np.array(got, np.int64)[of]
        n = self.length[k]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[k] - stop + n, n) + np.arange(stop[-1])]
        edge = np.concatenate([[0], stop])[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _begins(buf: np.ndarray) -> np.ndarray:
    """Where a piece begins: at a space that surely no white space follows."""
    start = np.zeros(len(buf), bool)
    start[:-1] = (buf[:-1] == 32) & _SAFE[buf[1:]]
    return start


def _alone(piece: bytes) -> bool:
    return len(piece) < 2 or piece[0] != 32 or not _SAFE[piece[1]]


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Packer:
    """The open windows of one partition; a window is [pieces, tokens], a piece (document, start, ids)."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most, self.open, self.done = size, most, [], []

    def add(self, doc, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= self.size:
            self.done.append([(doc, at, ids[at : at + self.size])])
            at += self.size
        while at < n:
            need = n - at
            fits = [w for w in self.open if self.size - w[1] >= need]
            if fits or len(self.open) < self.most:
                if fits:
                    w = max(fits, key=lambda w: w[1])
                else:
                    self.open.append(w := [[], 0])
            else:
                w = max(self.open, key=lambda w: w[1])
                need = self.size - w[1]
            w[0].append((doc, at, ids[at : at + need]))
            w[1] += need
            at += need
            if w[1] == self.size:
                self.open = [x for x in self.open if x is not w]  # not by value: repeated rows make windows alike
                self.done.append(w[0])

    def close(self) -> list:
        """Merge the open windows; what remains, below size, is returned as pieces."""
        tail, used = [], 0
        for w in self.open:
            for doc, at, ids in w[0]:
                while used + len(ids) >= self.size:
                    cut = self.size - used
                    self.done.append([*tail, (doc, at, ids[:cut])])
                    at, ids, tail, used = at + cut, ids[cut:], [], 0
                if len(ids):
                    tail.append((doc, at, ids))
                    used += len(ids)
        self.open = []
        return tail


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local long, offset long, ids binary"
)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, most_open: int = OPEN, end: int = END) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then `end`; null and empty texts are `end` alone, so each row of docs has a piece; doc_id may
    be null or repeat (each row is packed as a document of its own); other columns are ignored; no rows give none. A
    sequence has `size` tokens, but for at most log2(size) at the very end, which have a power of two: none has padding.
    size must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoder, packer, part, local = Encoder.of(path), Packer(size, most_open), TaskContext.get().partitionId(), 0

        def rows(windows, first):
            cols = [[] for _ in range(9)]
            for i, w in enumerate(windows, max(first, 0)):
                offset = 0
                for (doc, total), at, ids in w:
                    raw = ids.astype("<u4").tobytes()
                    row = (doc, at, len(ids), zlib.crc32(raw), total, part, i if first >= 0 else -1, offset, raw if first < 0 else None)
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 8 else pa.int64()) for k, c in enumerate(cols)],
                names=[x.split()[0] for x in _PIECES.split(", ")],
            )

        for b in batches:
            ids, texts, at = b.column(0).to_pylist(), b.column(1), 0
            while at < len(ids):
                some, chars = [], 0
                while at + len(some) < len(ids) and chars < CHUNK:
                    some.append(texts[at + len(some)].as_py() or "")
                    chars += len(some[-1])
                for doc, x in zip(ids[at:], encoder.encode(some)):
                    x = np.append(x, np.uint32(end))
                    packer.add((doc, len(x)), x)
                at += len(some)
                if packer.done:
                    yield rows(packer.done, local)
                    local += len(packer.done)
                    packer.done = []
        tail = packer.close()
        if packer.done:
            yield rows(packer.done, local)
        if tail:
            yield rows([tail], -1)

    text = F.col("text").cast("string")
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, _PIECES), "pieces")
    whole = pieces.where("local >= 0").withColumn("sequence_id", (F.col("part") + 1) * F.lit(1 << 33) + F.col("local"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*names).unionByName(_merged(pieces.where("local < 0"), size).select(*names))


def _merged(tails: DataFrame, size: int) -> DataFrame:
    """The partitions' tails, one after the other, cut to sequences."""
    lengths = tails.groupBy("part").agg(F.sum("length").alias("n"))
    total = lengths.agg(F.sum("n")).first()[0] or 0
    full = total // size * size
    cuts, left = [full], total - full  # where the sequences after the last full one start, and the end
    while left:
        step = 1 << (left.bit_length() - 1)
        cuts.append(cuts[-1] + step)
        left -= step
    # One row for each partition of the input.
    before = lengths.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")
    g = tails.join(F.broadcast(before), "part").withColumn("g", F.col("base") + F.col("offset"))
    last = F.array(*[F.lit(c).cast("long") for c in cuts])
    end = F.col("g") + F.col("length")
    turn = (F.floor(F.col("g") / size) + 1) * size
    inner = F.concat(F.array("g"), F.array(turn), last, F.array(end))
    g = g.withColumn("at", F.array_sort(F.array_distinct(F.filter(inner, lambda x: (x >= F.col("g")) & (x <= end)))))
    g = g.select("*", F.explode(F.sequence(F.lit(1), F.size("at") - 1)).alias("k"))
    g = g.withColumn("a", F.element_at("at", F.col("k"))).withColumn("b", F.element_at("at", F.col("k") + 1))
    skip = F.col("a") - F.col("g")
    passed = F.size(F.filter(last, lambda c: c <= F.col("a")))
    return g.select(
        "doc_id",
        (F.col("start") + skip).alias("start"),
        (F.col("b") - F.col("a")).alias("length"),
        F.crc32(F.expr("substring(ids, cast((a - g) * 4 + 1 as int), cast((b - a) * 4 as int))")).alias("ids_crc32"),
        "doc_tokens",
        F.when(F.col("a") < full, F.floor(F.col("a") / size)).otherwise(F.lit(full // size) + passed - 1).cast("long").alias("sequence_id"),
        F.when(F.col("a") < full, F.col("a") % size).otherwise(F.col("a") - F.element_at(last, F.greatest(passed, F.lit(1)))).cast("long").alias("offset"),
    )
