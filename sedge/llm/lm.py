"""Stupid-backoff language model scores, from n-gram counts of all documents.

A document's score is the mean over its words of log S(word | words before), where S takes the longest context of at most
ORDER - 1 words that other documents continue with the word:

    S(w | v) = BACKOFF ** (ORDER - 1 - length of v) * c(v w) / c(v)          for the longest v with c(v w) > 0
    S(w)     = BACKOFF ** (ORDER - 1) * (c(w) + 1) / (N + 1)                 if there is none

with counts c (and words N) of the whole corpus less the document's own, so that a text isn't likely merely for being in it.

Everything is a relation. occurrences: a row (n-gram, document, times) for each different n-gram of a document, n-grams of
all orders as 64-bit hashes. They are dealt by n-gram, summed, and each learns how often other documents have its n-gram; of
n-grams that no other document has nothing is returned. What is returned is grouped by document, at most its own
n-grams, and summed along its words. Nothing depends on the order of rows: documents are written once with a number.

The occurrences of a corpus are many times its size. So n-grams that a SHARE-th of the texts holds often, COMMON at most, are summed inside
tasks before they move, and their sums sent round as a table; which ones are in it changes no result. The others move in up to PARTS parts of
the n-grams and return in as many parts of the documents, one after the other; Spark deletes a part's shuffle files when it is written.
Documents are written as words: the place in the table of those that it holds, the hashes of the rest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from sedge.llm.pieces import hashes, mixed
from sedge.session import discard, shuffles_deleted, stored

ORDER, BACKOFF, BLOCK = 3, 0.4, 2_000_000
#: Parts of the n-grams and of the documents at most, words for which there is another; n-grams of the table at most; one in so many texts is asked which; n-grams of a batch of these, documents of it that hold one of the table; occurrences of a task.
PARTS, EACH, COMMON, SHARE, BATCH, OFTEN, ROWS = 4, 1 << 23, 1 << 21, 4, 1 << 22, 2, 1 << 20
_SPACE = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])


def word_hashes(raw: bytes, block: int = BLOCK) -> np.ndarray:
    """The hash of each word of a text in order; a long text is taken in parts that end at white space."""
    buf = np.frombuffer(raw, np.uint8)
    found, at = [], 0
    while at < len(buf):
        end = min(at + block, len(buf))
        while end < len(buf) and not (gap := _SPACE[buf[end : end + block]]).any():
            end = min(end + block, len(buf))
        if end < len(buf):
            end += int(gap.argmax())
        part = buf[at:end]
        word = ~_SPACE[part]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        found.append(hashes(part, edges[::2], edges[1::2]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length from 1 to order: the hash of the n-gram that each word ends, from the first word that ends one."""
    made = [words]
    for n in range(1, order):
        before = made[-1][:-1]
        made.append(mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + words[n:] + np.uint64(n)) if len(before) else np.zeros(0, np.uint64))
    return made


def _places(table: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram whether the table, which is in order, holds it, and where."""
    if not len(table):
        return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
    at = np.minimum(np.searchsorted(table, gram), len(table) - 1)
    return table[at] == gram, at


def common_grams(docs: DataFrame, order: int) -> np.ndarray:
    """The n-grams that OFTEN or more documents of a batch hold, the most frequent of them, in order: at most COMMON; of one in SHARE texts."""

    def counted(held: list) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], names=["gram", "n"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(np.unique(np.concatenate(grams(word_hashes(t.as_py().encode()), order))))
                n += len(held[-1])
                if n >= BATCH:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    asked = docs.select(F.col("text").cast("string").alias("text")).where((F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0) & F.col("text").isNotNull())
    found = asked.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    with shuffles_deleted(docs.sparkSession):
        top = found.orderBy(F.desc("n"), "gram").limit(COMMON).select("gram").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def numbered(docs: DataFrame, common: Broadcast) -> DataFrame:
    """docs -> doc_id, row, n_words, places, rest: each word's place in `common`, -1 for those that it doesn't hold, whose hashes are the rest."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(2):
                words = word_hashes((t.as_py() or "").encode())
                has, at = _places(common.value, words)
                out.append((len(words), np.where(has, at, -1).astype(np.int32).tobytes(), words[~has].tobytes()))
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "row", "n_words", "places", "rest"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, row long, n_words long, places binary, rest binary")


def _words(places: pa.Scalar, rest: pa.Scalar, common: np.ndarray) -> np.ndarray:
    at = np.frombuffer(places.as_buffer(), np.int32)
    words, known = np.zeros(len(at), np.uint64), at >= 0
    words[known], words[~known] = common[at[known]], np.frombuffer(rest.as_buffer(), np.uint64)
    return words


def occurrences(held: DataFrame, order: int, common: Broadcast, part: int, parts: int, rows: int = 1 << 16) -> DataFrame:
    """held -> gram, row, times: the different n-grams of each document, of all lengths up to order, of one part of so many.

    Those in `common` are summed for each task instead, with row null.
    """

    def run(batches):
        table, held, n = common.value, [], 0
        total = np.zeros(len(table), np.int64)
        for b in batches:
            for row, places, rest in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                gram = np.concatenate(grams(_words(places, rest, table), order))
                gram, times = np.unique(gram[gram % np.uint64(parts) == part], return_counts=True)
                has, at = _places(table, gram)
                total[at[has]] += times[has]
                gram, times = gram[~has], times[~has]
                held.append((gram.view(np.int64), np.full(len(gram), row, np.int64), times))
                n += len(gram)
                if n >= rows:
                    yield from _batches(held, rows)
                    held, n = [], 0
        yield from _batches(held, rows)
        at = np.flatnonzero(total)
        yield from _batches([(table[at].view(np.int64), pa.nulls(len(at), pa.int64()), total[at])], rows)

    return held.select("row", "places", "rest").mapInArrow(run, "gram long, row long, times long")


def _batches(held: list, rows: int):
    if held:
        columns = [c[0] if len(c) == 1 else np.concatenate(c) for c in zip(*held)]
        whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "row", "times"])
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def others(found: DataFrame, parts: int, rows: int = 1 << 16) -> DataFrame:
    """occurrences -> row, gram, n: those whose n-gram other documents have, n times in all; with row null what tasks summed: an n-gram's times in all."""

    def run(batches):
        batches = list(batches)  # ROWS and the table's n-grams, dealt evenly
        if not sum(b.num_rows for b in batches):
            return
        whole = pa.Table.from_batches(batches)
        by = np.argsort(whole.column(0).to_numpy())
        gram, row, times = (whole.column(k).take(pa.array(by)) for k in range(3))
        g, t, none = gram.to_numpy(), times.to_numpy(), row.is_null().to_numpy()
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        total = np.repeat(np.add.reduceat(t, first), np.diff(np.append(first, len(g))))
        n, begins = np.where(none, total, total - t), np.zeros(len(g), bool)
        begins[first] = True
        made = pa.Table.from_arrays([row, gram, pa.array(n)], names=["row", "gram", "n"]).filter(pa.array(np.where(none, begins, n > 0)))
        yield from made.combine_chunks().to_batches(max_chunksize=rows)

    return found.repartition(parts, "gram").mapInArrow(run, "row long, gram long, n long")


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_seen (words that other documents have after the word before), log_score.

    log_score is the mean natural logarithm, null without words. One row for each row. Null, empty and blank texts have no words; doc_id
    may be null or repeat (each row is a document of its own); other columns are ignored; no rows give none. Words are runs without
    \\x20 and \\x09-\\x0D. order is at least 1.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(common_grams(docs, order))
    held = stored(numbered(docs, table), "numbered", "zstd")
    with shuffles_deleted(spark):
        corpus = held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
        parts = min(PARTS, 1 + corpus // EACH)
        found = [stored(others(occurrences(held, order, table, k, parts), 1 + order * corpus // (parts * ROWS)), "others") for k in range(parts)]
    every = reduce(DataFrame.unionByName, found)
    summed = every.where("row is null").select("gram", "n").toArrow()
    total = np.zeros(len(table.value), np.int64)
    total[_places(table.value, summed.column(0).to_numpy().astype(np.int64).view(np.uint64))[1]] = summed.column(1).to_numpy()
    totals = spark.sparkContext.broadcast(total)

    def finish(batches):
        for b in batches:
            out = []
            for doc, places, rest, known in zip(b.column(0).to_pylist(), *(b.column(k) for k in (1, 2, 3))):
                made = grams(_words(places, rest, table.value), order)
                gram, of, times = np.unique(np.concatenate(made), return_inverse=True, return_counts=True)
                has, at = _places(table.value, gram)
                n = np.zeros(len(gram), np.int64)
                n[has] = totals.value[at[has]] - times[has]
                if known.is_valid:
                    rare, n_rare = (known.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    n[np.searchsorted(gram, rare.view(np.uint64))] = n_rare
                c = np.split(n[of], np.cumsum([len(g) for g in made])[:-1])
                out.append((doc, len(made[0]), *_summed(c, corpus - len(made[0]), backoff)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "n_words", "n_seen", "log_score"]
            )

    done = []
    for k in range(parts):
        mine = F.pmod("row", F.lit(parts)) == k
        of = every.where(mine).groupBy("row").agg(F.collect_list(F.struct("gram", "n")).alias("others"))
        both = held.where(mine).join(of, "row", "left").select("doc_id", "places", "rest", "others")
        with shuffles_deleted(spark):
            done.append(stored(both.mapInArrow(finish, "doc_id long, n_words long, n_seen long, log_score double"), "scores"))
    for made in (held, *found):
        discard(made)
    return reduce(DataFrame.unionByName, done)


def _summed(c: list[np.ndarray], rest: int, backoff: float) -> tuple[int, float | None]:
    """(n_seen, log_score) of one text: c are its n-grams' counts in other documents, from the first word that ends one; rest: all other words."""
    words, order = len(c[0]), len(c)
    if not words:
        return 0, None
    logs = np.log((c[0] + 1) / (rest + 1)) + (order - 1) * np.log(backoff)
    seen = np.zeros(words, bool)
    for k in range(1, order):  # longer contexts take over where other documents have them
        has = np.flatnonzero(c[k] > 0)
        logs[has + k] = np.log(c[k][has] / c[k - 1][has]) + (order - 1 - k) * np.log(backoff)
        seen[has + k] = True
    return int(seen.sum()), float(logs.mean())
