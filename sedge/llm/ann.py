"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are scaled to length 1, where the largest cosine is the least Euclidean distance. A table hashes a vector x to
the cells floor((a_i . x + b_i) / W) of HASHES Gaussian directions a_i. A query visits PROBES cells of each table: its own
and those that differ by one step in some directions, in the order of their estimated success, the sum of squared
distances from the query to the boundaries crossed. Candidates of all visited cells are ranked by their exact cosine
where they lie; only the best K of each place are sent on and merged.

Every row is indexed. Of equal vectors all but the K + 1 with the smallest ids are set aside first, which changes no
result: their scores are equal, and ties go to smaller ids. A cell of more than BLOCK rows is dealt to blocks, each
visited by the cell's queries. A query that finds fewer than K visits every cell of one table, which is an exact search.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.session import stored

K, TABLES, HASHES, WIDTH, PROBES, BLOCK, SEED = 5, 6, 6, 1.8, 64, 20_000, 11
#: Rows of the index and of queries that meet in one part, about.
PART = 200_000


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def family(table: int, dim: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions and offsets of one table for vectors of one length."""
    rng = np.random.default_rng([seed, table, dim])
    return rng.normal(size=(dim, hashes)), rng.uniform(0, width, hashes)


def cell_ids(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One 64-bit number for each row of cells."""
    h = np.full(len(cells), np.uint64((table + 1) * 1_000_003 + dim))
    for c in cells.T:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def probe_cells(x: np.ndarray, table: int, hashes: int, width: float, probes: int, seed: int) -> np.ndarray:
    """(rows, probes) cell numbers that each row of x visits in a table, its own first."""
    a, b = family(table, x.shape[1], hashes, width, seed)
    f = (x @ a + b) / width
    home = np.floor(f)
    down = (f - home) * width
    cost = np.stack([down**2, np.zeros_like(down), (width - down) ** 2], axis=-1)
    steps = np.array(list(product((-1, 0, 1), repeat=hashes)))
    probes = min(probes, len(steps))
    total = sum(cost[:, i, :][:, steps[:, i] + 1] for i in range(hashes))
    best = np.argsort(total, axis=1, kind="stable")[:, :probes]
    cells = (home[:, None, :] + steps[best]).reshape(-1, hashes)
    return cell_ids(cells, table, x.shape[1]).reshape(len(x), probes)


def _rows(batch: pa.RecordBatch):
    """The ids and unit vectors of a batch by length: (ids, raw vectors as doubles, unit vectors)."""
    ids, vs = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vs):
        by.setdefault(len(v), []).append(i)
    for own in by.values():
        raw = np.array([vs[i] for i in own], np.float64)
        scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
        yield ids[own], raw, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _emit(ids, raw, cells):
    """Rows (cell, id, vector) for each id and each of its cells."""
    n, k = cells.shape
    at = 0
    while at < n:
        s = slice(at, at + max(1, 20_000 // k))
        vectors = [r.tobytes() for r in raw[s]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cells[s].ravel()), pa.array(np.repeat(ids[s], k)),
                pa.array([v for v in vectors for _ in range(k)], pa.binary()),
            ],
            names=["cell", "id", "v"],
        )
        at = s.stop


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = K,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank (from 1), vec_id, score: the k nearest found of each query.

    queries is the condition for a row to be a query. Candidates are all usable rows but the query's own vec_id; fewer
    than k candidates are all returned, ties go to the smaller vec_id. Vectors that aren't usable() and rows without a
    vec_id take no part; vectors meet only those of their own length; rows that repeat a vec_id and vector count once;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks"))
    first = Window.partitionBy("h", "embedding").orderBy("id")
    distinct = rows.select("id", "embedding", F.xxhash64("embedding").alias("h")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)

    def index(batches):
        for b in batches:
            for ids, raw, unit in _rows(b):
                cells = np.stack([probe_cells(unit, t, hashes, width, 1, seed)[:, 0] for t in range(tables)], axis=1)
                yield from _emit(ids, raw, cells)

    def ask(batches):
        for b in batches:
            for ids, raw, unit in _rows(b):
                for t in range(tables):
                    yield from _emit(ids, raw, probe_cells(unit, t, hashes, width, probes, seed))

    shape = "cell long, id long, v binary"
    indexed = stored(distinct.select("id", "embedding").mapInArrow(index, shape), "index")
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.length("v")).alias("width"))
    sizes = stored(sizes.select("cell", "width", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
    asked = rows.where("asks").select("id", "embedding").distinct()
    # Parts grow in number, not in size: what a part reads is bounded.
    parts = max(4 * parts, -(-(indexed.count() + asked.count() * tables * probes) // PART))

    def search(indexed: DataFrame, asking: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best k of each place, from rows dealt by cell and block."""
        i = indexed.join(sizes.where("blocks > 1").select("cell", "blocks"), "cell", "left")
        i = i.withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
        q = asking.join(sizes.select("cell", "blocks"), "cell")
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        i, q = [x.select(F.pmod(F.xxhash64("cell", "block"), F.lit(parts)).cast("int").alias("part"), F.xxhash64("cell", "block").alias("place"), "id", "v") for x in (i, q)]

        def meet(left, right):
            return _best(left, right, k)

        return q.groupBy("part").cogroup(i.groupBy("part")).applyInArrow(meet, "query_id long, vec_id long, score double")

    found = stored(search(indexed, asked.mapInArrow(ask, shape)), "found")
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = stored(asked.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"), "short")
    if short.limit(1).count():
        # Every cell of the first table, once for each vector length: an exact search for these queries.
        one = stored(_first_table(indexed, distinct, index, shape, hashes, width, seed), "table")
        every = one.select("cell", F.length("v").alias("width")).distinct()
        wide = short.withColumn("width", F.size("embedding") * 8)
        asking = wide.join(every, "width").select("cell", "id", F.col("embedding"))
        found = found.unionByName(search(one, _as_binary(asking)))
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _first_table(indexed, distinct, index, shape, hashes, width, seed):
    def only(batches):
        for b in batches:
            for ids, raw, unit in _rows(b):
                yield from _emit(ids, raw, probe_cells(unit, 0, hashes, width, 1, seed))

    return distinct.select("id", "embedding").mapInArrow(only, shape)


def _as_binary(asking: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            vs = [np.array(v, np.float64).tobytes() for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vs, pa.binary())], names=["cell", "id", "v"])

    return asking.mapInArrow(run, "cell long, id long, v binary")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b, each made alone, so that equal vectors have equal scores."""
    a, b = [x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b)]
    return np.clip((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), -1, 1)


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The best k candidates of each query over the places of one part; left holds queries, right the index."""
    out_q, out_v, out_s = [], [], []
    if left.num_rows and right.num_rows:
        qp, ip = left.column("place").to_numpy(), right.column("place").to_numpy()
        q_order, i_order = np.argsort(qp, kind="stable"), np.argsort(ip, kind="stable")
        qp, ip = qp[q_order], ip[i_order]
        q_id, i_id = left.column("id").to_numpy()[q_order], right.column("id").to_numpy()[i_order]
        q_v, i_v = left.column("v").to_pylist(), right.column("v").to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], qp[1:] != qp[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            lo, hi = np.searchsorted(ip, qp[a], "left"), np.searchsorted(ip, qp[a], "right")
            if lo == hi:
                continue
            x = np.frombuffer(b"".join([i_v[j] for j in i_order[lo:hi]]), np.float64).reshape(hi - lo, -1)
            ids = i_id[lo:hi]
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for at in range(a, b, 256):
                y = np.frombuffer(b"".join([q_v[j] for j in q_order[at : min(b, at + 256)]]), np.float64).reshape(min(b, at + 256) - at, -1)
                near = y / np.abs(y).max(axis=1, keepdims=True)
                near = (near / np.linalg.norm(near, axis=1, keepdims=True)) @ unit.T
                near[q_id[at : at + len(y), None] == ids[None]] = -np.inf
                least = np.partition(near, -min(k, hi - lo), axis=1)[:, -min(k, hi - lo)]
                r, c = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
                out_q.append(q_id[at + r])
                out_v.append(ids[c])
                out_s.append(cosines(y[r], x[c]))
    if not sum(map(len, out_q)):
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q, v, s = np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])
    q, v, s = q[new], v[new], s[new]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return pa.table({"query_id": q[keep], "vec_id": v[keep], "score": s[keep]})
