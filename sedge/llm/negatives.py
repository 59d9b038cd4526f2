"""Hard negatives for contrastive training: product quantisation filters rigorously, exact integer products decide.

A component x is the integer floor(SCALE * x); a row's score for an anchor is their integer inner product. The index holds for each row a code
byte for every SUB components (the nearest of at most 256 centroids, fitted on a bounded sample) and the norm of the residual, what the
centroids leave of the vector. A score lies within |anchor| * residual norm of the sum that lookup tables give, so a row is left out only
where that interval proves that it can't be among the rows sought; the others are scored exactly.

Anchors meet all rows in cells of at most ANCHORS anchors and about ROWS rows: once for the positives, the best rows of the anchor's own label,
and once for the windows below each positive's score, the best rows of other labels inside. A cell returns its best few alone, and these
are ranked over all cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.session import stored

#: Positives an anchor, negatives a positive, per cent of the positive's score that a negative has at least and at most.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: What components are multiplied by; components of one code; centroids; rows that the centroids are fitted on; rounds of fitting.
SCALE, SUB, CENTROIDS, SAMPLE, FITTED = 256, 2, 256, 2048, 10
#: Anchors and rows of a cell; numbers held at a time in one of its matrices.
ANCHORS, ROWS, HELD = 4096, 100_000, 1 << 21
_CODED = "id long, label long, dim int, v binary, codes binary, residual double"


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, every component times SCALE a finite number."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(SCALE))) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def whole(vectors: list) -> np.ndarray:
    return np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), -1))


def as_bytes(x: np.ndarray) -> list[bytes]:
    """Each row's integers: 4 bytes each where they fit, else as doubles."""
    small = (np.abs(x) < 2**31).all(axis=1) if x.size else np.ones(len(x), bool)
    return [r.astype("<i4").tobytes() if s else r.tobytes() for r, s in zip(x, small)]


def from_bytes(raw: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dim).astype(np.float64)
    return np.array([np.frombuffer(r, "<i4" if len(r) == 4 * dim else np.float64) for r in raw], np.float64).reshape(len(raw), dim)


def split(x: np.ndarray) -> np.ndarray:
    """(rows, codes, SUB): the components of each code, zeros after the last."""
    wide = -(-x.shape[1] // SUB) * SUB
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), -1, SUB)


def coded(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid of every part of every row; book: (codes, centroids, SUB)."""
    codes, parts = np.zeros((len(x), len(book)), np.uint8), split(x)
    half = (book**2).sum(axis=2) / 2
    for m in range(len(book)):
        for at in range(0, len(x), 4096):
            codes[at : at + 4096, m] = np.argmin(half[m] - parts[at : at + 4096, m] @ book[m].T, axis=1)
    return codes


def decoded(codes: np.ndarray, book: np.ndarray, dim: int) -> np.ndarray:
    return book[np.arange(len(book)), codes].reshape(len(codes), -1)[:, :dim]


def fit(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Centroids for each part, by Lloyd's rounds from rows of x; no more than rows."""
    book = split(x[np.random.default_rng(seed).permutation(len(x))[:CENTROIDS]]).transpose(1, 0, 2).copy()
    parts = split(x)
    for _ in range(FITTED):
        codes = coded(x, book)
        for m in range(len(book)):
            n = np.bincount(codes[:, m], minlength=book.shape[1])
            for s in range(SUB):
                total = np.bincount(codes[:, m], parts[:, m, s], book.shape[1])
                book[m, n > 0, s] = total[n > 0] / n[n > 0]
    return book


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b; beyond a long they are an error."""
    if not a.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2**53:
        return (a * b).sum(axis=1).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a, b)], np.int64)


def scored(y: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """products(y[i], x[j]), a part at a time."""
    step = max(1, HELD // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0, np.int64), *[products(y[i[k : k + step]], x[j[k : k + step]]) for k in range(0, len(i), step)]])


def bounds(y: np.ndarray, codes: np.ndarray, residual: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) that each row's score for each anchor of y can be."""
    tables = np.einsum("cms,mks->cmk", split(y), book)
    middle = np.zeros((len(y), len(codes)))
    for m in range(len(book)):
        middle += tables[:, m][:, codes[:, m]]
    norm = np.sqrt((y**2).sum(axis=1))
    rounding = 1e-6 + 1e-9 * norm[:, None] * (np.sqrt((book**2).sum(axis=2).max(axis=1).sum()) if book.size else 0)
    reach = norm[:, None] * residual * (1 + 1e-9) + rounding
    return middle - reach, middle + reach


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, -inf where there are fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the rows are the best k of their group, by score, then the smaller id."""
    order = np.lexsort((ids, -score, group))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def _meeting(books, positives: int, negatives: int, low: int, high: int, seek: bool):
    """The function of a cell. seek: the best rows of the anchor's label; else of other labels, in the windows below `scores`."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        dims, own = left.column("dim").to_numpy(), right.column("dim").to_numpy()
        for dim in np.intersect1d(dims, own).tolist():
            a, b = left.filter(pa.array(dims == dim)), right.filter(pa.array(own == dim))
            y, x = from_bytes(a.column("v").to_pylist(), dim), from_bytes(b.column("v").to_pylist(), dim)
            book = books.value.get(dim, np.zeros((-(-dim // SUB), 1, SUB)))
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(x), len(book))
            residual, ids = b.column("residual").to_numpy(), b.column("id").to_numpy()
            asked, key = a.column("id").to_numpy(), a.column("anchor").to_numpy()
            same = a.column("label").to_numpy()[:, None] == b.column("label").to_numpy()[None]
            step = max(1, HELD // max(1, len(x)))
            for at in range(0, len(y), step):
                s = slice(at, at + step)
                least, most = bounds(y[s], codes, residual, book)
                if seek:
                    ok = same[s] & (asked[s, None] != ids[None])
                    i, j = np.nonzero(ok & (most >= kth(np.where(ok, least, -np.inf), positives)[:, None]))
                    score = scored(y[s], x, i, j)
                    best = first(positives, i, score, ids[j])
                    found = (key[s][i[best]], score[best], score[best], ids[j[best]])
                    for o, f in zip(out, found):
                        o.append(f)
                    continue
                windows = a.column("scores")[at : at + step].to_pylist()
                maybe = np.zeros(least.shape, bool)
                for w in range(max(map(len, windows))):
                    p = np.array([float(t[w]) if w < len(t) else -np.inf for t in windows])[:, None]  # nothing lies under -inf
                    floor, roof = low / 100 * p, high / 100 * p
                    sure = ~same[s] & (least >= floor) & (most <= roof)
                    enough = kth(np.where(sure, least, -np.inf), negatives)[:, None]
                    maybe |= ~same[s] & (most >= np.maximum(enough, floor)) & (least <= roof)
                i, j = np.nonzero(maybe)
                score = scored(y[s], x, i, j)
                for w in range(max(map(len, windows))):
                    p = np.array([t[w] if w < len(t) else -1 for t in windows], object if any(abs(v) > 2**55 for t in windows for v in t) else np.int64)[i]
                    n = score.astype(p.dtype)
                    inside = np.flatnonzero(((low * p <= 100 * n) & (100 * n <= high * p)).astype(bool))
                    best = inside[first(negatives, i[inside], score[inside], ids[j[inside]])]
                    for o, f in zip(out, (key[s][i[best]], p[best].astype(np.int64), score[best], ids[j[best]])):
                        o.append(f)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out], names=["anchor", "window", "score", "id"])

    return meet


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    anchors_a_cell: int = ANCHORS,
    rows_a_cell: int = ROWS,
) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors is the condition for a row to be an anchor, label an integer column. An anchor's positives are the best other rows (of another
    vec_id) of its label, a positive's negatives the best rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score; higher scores first, ties by smaller vec_id; all of them where there are fewer. A positive without negatives has no row.
    Rows without a vec_id, label or usable() vector take no part; vectors meet those of their own length; rows that repeat count once, rows of one
    vec_id that differ are rows of their own; other columns are ignored; no rows give none. high is at most 100.
    """
    if high > 100:
        raise ValueError("high must be at most 100")
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).where(usable(F.col("embedding")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.distinct()
    # Of equal vectors of one label only those with the least ids can be sought: all have one score.
    place = F.row_number().over(Window.partitionBy("label", "h", "embedding").orderBy("id"))
    sought = rows.withColumn("h", F.xxhash64("embedding")).withColumn("n", place).where(F.col("n") <= max(positives + 1, negatives))
    some = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id", "embedding").limit(SAMPLE).toArrow()
    by: dict[int, list] = {}
    for v in some.column("embedding").to_pylist():
        by.setdefault(len(v), []).append(v)
    books = spark.sparkContext.broadcast({dim: fit(whole(vs)) for dim, vs in by.items() if dim})  # no more numbers than the sample has

    def encode(batches):
        for b in batches:
            own: dict[int, list[int]] = {}
            vs = b.column(2).to_pylist()
            for i, v in enumerate(vs):
                own.setdefault(len(v), []).append(i)
            for dim, at in own.items():
                x = whole([vs[i] for i in at])
                book = books.value.get(dim, np.zeros((-(-dim // SUB), 1, SUB)))
                codes = coded(x, book)
                residual = np.sqrt(((x - decoded(codes, book, dim)) ** 2).sum(axis=1))
                picked = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0), picked.column(1), pa.array([dim] * len(at), pa.int32()), pa.array(as_bytes(x), pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual)],
                    names=[c.split()[0] for c in _CODED.split(", ")],
                )

    index = stored(sought.select("id", "label", "embedding").mapInArrow(encode, _CODED), "index")
    asked = rows.where("asks").select("id", "label", "embedding").mapInArrow(encode, _CODED).select("id", "label", "dim", "v", F.xxhash64("id", "label", "v").alias("anchor"))
    asked = stored(asked, "anchors")
    groups = max(1, -(-asked.count() // anchors_a_cell))
    blocks = max(parts, -(-index.count() // rows_a_cell))
    block, group = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)), F.pmod(F.xxhash64("anchor"), F.lit(groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = index.withColumn("block", block).withColumn("group", each(groups)).withColumn("cell", F.col("group") * F.lit(blocks) + F.col("block"))

    def met(asking: DataFrame, seek: bool, k: int) -> DataFrame:
        """anchor, window, score, id: the best k of all cells for each anchor and window."""
        asking = asking.withColumn("group", group).withColumn("block", each(blocks)).withColumn("cell", F.col("group") * F.lit(blocks) + F.col("block"))
        cell = _meeting(books, positives, negatives, low, high, seek)
        got = asking.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(cell, "anchor long, window long, score long, id long")
        keys = ["anchor"] if seek else ["anchor", "window"]
        ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= k)

    near = stored(met(asked, True, positives), "positives")
    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("scores"))  # as many as positives at most
    far = met(asked.join(scores, "anchor"), False, negatives)
    pair = near.select("anchor", F.col("score").alias("window"), F.col("id").alias("positive_id"))
    return far.join(pair, ["anchor", "window"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")
    )
