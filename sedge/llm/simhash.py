"""Near-duplicate texts by SimHash, linked through vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word shingles. Two fingerprints
link when at most `reach` = 3 of 64 bits differ.

Tree. Split the 64 bits into two halves: of at most 3 differing bits, one half holds at most 1. So two searches,
each with Hamming distance over one half as its metric and a radius of 1, find every link, and distances over
32 bits with radius 1 are pruned far better than distances over 64 bits with radius 3 (a median split sends about
1.3 instead of 1.6 of the 2 branches). For each half a vantage-point tree is built from a bounded sample of the
fingerprints: an inner node holds a vantage point v and a radius r; points with d(x, v) <= r go inside. By the
triangle inequality a point within 1 of x lies inside only if d(x, v) - 1 <= r, outside only if d(x, v) + 1 > r.
Each fingerprint has one home leaf (a shard) and visits every leaf that these bounds leave open. In a shard, home
points meet home points and visitors, by the same kind of tree over the shard's own home, whose leaves hold some LEAF
points, and with the full 64-bit distance in these; only the shard's connected components
leave it, as stars, never its pairs. A shard whose home is too large is dealt to blocks, and its points visit
the other blocks: nothing is cut. Leaves number at most 2**DEPTH, so the outer trees' broadcast is bounded (1.5 MB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sedge.operators.components import components
from sedge.session import stored

#: Bits that may differ; words of a shingle.
REACH, WORDS = 3, 3
#: Fingerprints wanted in a shard and in a leaf of its own tree, the deepest outer tree, fingerprints sampled for each of its leaves.
SHARD, LEAF, DEPTH, SAMPLE = 1 << 15, 256, 16, 16
_SHIFT = {0: np.uint64(32), 1: np.uint64(0)}


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of one text; 0 without words (null, empty, only white space)."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not ws:
        return 0
    flat, h = b" ".join(ws), xxhash.xxh64_digest
    if len(ws) <= words:
        hashes = h(flat, 42)
        n = 1
    else:
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        starts = [0, *(gaps[: len(ws) - words] + 1).tolist()]
        stops = [*gaps[words - 1 :].tolist(), len(flat)]
        n = len(stops)
        hashes = b"".join([h(flat[a:b], 42) for a, b in zip(starts, stops)])
    total, step = np.zeros(64, np.int64), 1 << 16
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, step):
        total += np.unpackbits(raw[at : at + step], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long. One row for each row of docs; null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long"
    )


def half(fps: np.ndarray, which: int) -> np.ndarray:
    return ((fps >> _SHIFT[which]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build_tree(points: np.ndarray, depth: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(vantage points, radii) of a complete tree in heap order over 32-bit points; radius 255 makes a node pass all inside."""
    size = (1 << depth) - 1
    v, r = np.zeros(max(size, 1), np.uint32), np.full(max(size, 1), 255, np.uint8)
    rng = np.random.default_rng(seed)
    held = {0: points}
    for node in range(size):
        own = held.pop(node, None)
        if own is None or len(own) < 2:
            continue
        best = None
        for c in rng.choice(own, min(4, len(own)), replace=False):  # of a few, the one whose median split overlaps least
            d = np.bitwise_count(own ^ c)
            for cut in {int(np.median(d)), max(0, int(np.median(d)) - 1)}:
                inside = d <= cut
                if inside.all() or not inside.any():
                    continue
                both = np.count_nonzero((d == cut) | (d == cut + 1)) / len(own)
                uneven = abs(inside.mean() - 0.5)
                if best is None or both + uneven < best[0]:
                    best = (both + uneven, c, cut, inside)
        if best is None:
            held[2 * node + 1] = own
            continue
        _, v[node], r[node], inside = best
        held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
    return v, r


def leaves(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether it is at home there) of every leaf that the triangle bounds leave open."""
    v, r = tree
    idx, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(depth):
        d = np.bitwise_count(points[idx] ^ v[node]).astype(np.int16)
        cut = r[node].astype(np.int16)
        inside = d <= cut
        go_in, go_out = d - 1 <= cut, d + 1 > cut
        idx, node, home = (
            np.concatenate([idx[go_in], idx[go_out]]),
            np.concatenate([2 * node[go_in] + 1, 2 * node[go_out] + 2]),
            np.concatenate([home[go_in] & inside[go_in], home[go_out] & ~inside[go_out]]),
        )
    return idx, node - ((1 << depth) - 1), home


def link_block(home: np.ndarray, guests: np.ndarray, which: int, reach: int = REACH, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, least member) of the components among home and guests, by links with an end at home that show in one half of the bits."""
    points = np.concatenate([home, guests])
    up = np.arange(len(points))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    depth = max(0, int(np.ceil(np.log2(max(1, len(home)) / leaf))))
    tree = build_tree(half(home, which), depth)
    i, place, own = leaves(half(points, which), tree, depth)
    order = np.argsort(place, kind="stable")
    i, place, own = i[order], place[order], own[order] & (i[order] < len(home))
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(i) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        here = i[a:b]
        mine = here[own[a:b]]
        for at in range(0, len(mine), leaf):
            part = mine[at : at + leaf]
            x, y = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[here][None]) <= reach)
            _joined(up, root, part[x], here[y])
    roots = np.array([root(k) for k in range(len(points))], np.int64) if len(points) else up
    met = np.flatnonzero(roots != np.arange(len(points)))
    return points[met], points[roots[met]]


def _joined(up: np.ndarray, root, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a's members with those of b's; the many pairs within one set cost no step of Python."""
    for _ in range(64):
        a, b = up[a], up[b]
        if np.array_equal(a, up[a]) and np.array_equal(b, up[b]):
            break
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    differ = lo != hi
    for x, y in np.unique(np.stack([lo[differ], hi[differ]], axis=1), axis=0).tolist():
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)


def links(distinct: DataFrame, reach: int = REACH, shard: int = SHARD, depth: int | None = None) -> DataFrame:
    """(a, b) of fingerprints: enough exact links (differing bits <= reach) to give the same components as all of them.

    distinct: fp, each once. reach is at most 3 (two halves, one bit each).
    """
    if not 0 <= reach <= 3:
        raise ValueError("reach must lie between 0 and 3")
    spark = distinct.sparkSession
    n = distinct.count()
    if depth is None:
        depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    want = SAMPLE * (1 << depth)  # bounded: 2**20 at most
    some = distinct.orderBy(F.xxhash64("fp")).limit(want) if depth else distinct.limit(0)
    sample = some.select("fp").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([build_tree(half(sample, w), depth) for w in (0, 1)])

    def route(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for which in (0, 1):
                i, leaf, home = leaves(half(fps, which), trees.value[which], depth)
                for at in range(0, len(i), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((leaf[s] * 2 + which).astype(np.int32)), pa.array(home[s]), pa.array(fps[i[s]].view(np.int64))],
                        names=["shard", "home", "fp"],
                    )

    routed = distinct.select("fp").mapInArrow(route, "shard int, home boolean, fp long")
    # Shards are few (2**17 at most) and their home counts are numbers: large ones get blocks.
    if depth:
        counts = stored(routed.where("home").groupBy("shard").count(), "shards")
        blocks = counts.select("shard", F.ceil(F.col("count") / (4 * shard)).cast("int").alias("blocks"))
        routed = routed.join(F.broadcast(blocks), "shard", "left")
        routed = routed.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        routed = routed.withColumn("blocks", F.lit(max(1, -(-n // (4 * shard)))))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        routed.withColumn("own", own)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("shard", "block", (F.col("home") & (F.col("block") == F.col("own"))).alias("home"), "fp")
    )

    def meet(key, batch):
        fps = batch.column("fp").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy().astype(bool)
        a, b = link_block(fps[home], fps[~home], key[0].as_py() % 2, reach)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard", "block").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, reach: int = REACH, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id, root, text_hash.

    One row for each row of docs. component_id is the least doc_id reachable through links, root a value that is
    the same for exactly the rows of a component (two components may hold the same doc_id only if doc_ids repeat).
    Null text counts as empty, texts without a word have fingerprint 0 and link like any other; a null doc_id is
    kept and never is a component's least unless all of it are null; other columns are ignored; no rows give none.
    Rows with equal fingerprints, a third of the table or more, meet as one before any link is sought.
    """
    prints = stored(fingerprints(docs, words), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), reach, shard))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root")
    return prints.join(of, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash"
    )


def deduplicated(docs: DataFrame, words: int = WORDS, reach: int = REACH) -> DataFrame:
    """docs without all but one row of each component: the row with the least doc_id stays, with its own columns."""
    names = docs.columns
    mark, text = _fresh(names, "text_hash"), F.xxhash64(F.col("text").cast("string"))
    found = stored(near_duplicates(docs, words, reach), "components")
    # One row for each component. Equal rows of docs have equal (doc_id, text_hash), so one of them stays.
    keep = (
        found.where("doc_id <=> component_id")
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
        .select(F.col("one.doc_id").alias("kept_id"), F.col("one.text_hash").alias("kept_hash"))
    )
    marked = docs.withColumn(mark, text)
    met = marked.join(keep, (marked["doc_id"].cast("long").eqNullSafe(keep.kept_id)) & (marked[mark] == keep.kept_hash), "left_semi")
    return met.dropDuplicates(["doc_id", mark]).select(*[F.col(f"`{c}`") for c in names])


def _fresh(names: list[str], want: str) -> str:
    while want in names:
        want += "_"
    return want
