"""Token counts under a sentencepiece model, with a shortcut for words that are one token.

The model turns a text into "▁" + text with every space as "▁", then merges pairs. No piece of the vocabulary holds
"▁" after another character (checked when the model is loaded), so no merge crosses the start of a run of "▁": the text
can be cut there, and likewise before a line feed, which no piece holds, and the pieces counted alone. Which pieces are one token is proved beforehand, by encoding each
vocabulary string alone; those count 1 by a lookup. Only the others are merged, and the results of the last ones kept
in a table of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sedge.llm.pieces import cut, unique

#: Tokens above which a document is over the limit; entries of the table of merged pieces; bytes handled at a time.
LIMIT, KEPT, CHUNK = 4096, 500_000, 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _begins(buf: np.ndarray) -> np.ndarray:
    """Where a piece begins: at a line feed, and at the first of a run of spaces (what comes before buf is taken for one)."""
    space = buf == 32
    start = buf == 10
    start[1:] |= space[1:] & ~space[:-1]
    return start


class Counter:
    """Counts the tokens of texts; one for each Python worker."""

    made: dict[str, Counter] = {}

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of this model holds a space or a line feed inside: texts can't be cut there")
        words = [p[1:] for p in pieces if p.startswith("▁") and len(p) > 1 and "▁" not in p[1:]]
        self.whole = {f" {w}".encode(): 1 for w, ids in zip(words, self.sp.encode(words, num_threads=1)) if len(ids) == 1}
        self.whole[b" "] = 1
        self.table = dict(self.whole)

    @classmethod
    def of(cls, model: str) -> Counter:
        if model not in cls.made:
            cls.made[model] = cls(model)
        return cls.made[model]

    def count(self, texts: list[str | None]) -> list[int]:
        total = np.zeros(len(texts), np.int64)
        todo: list[bytes] = []
        of: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            for part in cut(f" {t}".replace("▁", " ").encode(), CHUNK, _begins) if t else ():
                todo.append(part)
                of.append(i)
                size += len(part)
                if size >= CHUNK:
                    np.add.at(total, of, self._counted(todo))
                    todo, of, size = [], [], 0
        np.add.at(total, np.array(of, np.int64), np.array(self._counted(todo), np.int64))
        return total.tolist()

    def _counted(self, todo: list[bytes]) -> list[int]:
        """Each text has the space before it that the library adds; pieces start at a run of spaces or at a line feed."""
        raw = b"".join(todo)
        if not raw:
            return [0] * len(todo)
        buf = np.frombuffer(raw, np.uint8)
        start = _begins(buf)
        start[0] = True
        at = np.concatenate([[0], np.cumsum([len(t) for t in todo])])
        start[at[:-1][at[:-1] < at[-1]]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        first, of = unique(buf, starts, ends)
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        got = list(map(self.table.get, keys))
        new = [i for i, n in enumerate(got) if n is None]
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            texts = [keys[i][keys[i][0] == 32 :].decode() for i in part]
            for i, t, ids in zip(part, texts, self.sp.encode(texts, num_threads=1)):
                got[i] = len(ids) - (keys[i][0] == 10)  # without the space that the library puts before a line feed
        if len(self.table) + len(new) > KEPT:  # what this part of the texts holds stays
            self.table = self.whole | dict(zip(keys, got))
        else:
            self.table.update((keys[i], got[i]) for i in new)
        total = np.concatenate([[0], np.cumsum(np.array(got, np.int64)[of])])
        edge = np.searchsorted(starts, at)
        return (total[edge[1:]] - total[edge[:-1]]).tolist()


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes (of UTF-8), n_tokens, over_limit (n_tokens > limit).

    One row for each row; null and empty texts count 0 tokens and 0 bytes; doc_id may be null or repeat; other columns
    are ignored; very long texts are counted whole. Tokens are the library's own for the model, no begin or end added.
    """
    model = model or default_model()

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(Counter.of(model).count(texts.to_pylist()), pa.int64())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
