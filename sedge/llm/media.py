"""Chroma fingerprints of recordings in a binary column, and their alignment.

Sound (unsigned 8-bit mono samples, or a WAV file of such) is cut to overlapping frames; the energies of a frame's spectrum
are folded to 12 pitch classes. Over the image of pitch classes by frames, filters compare the sums of rectangles,
read from an integral image; each of the 16 filters gives two bits (Gray code), together one packed 32-bit integer for
each place of a SPAN frames wide window.

Alignment. Two packed integers in a row are a key (64 bits). For two recordings every pair of places with equal keys votes
for an offset; the offset with the most votes (ties: the least shift) is taken. It is a link if the votes are at least MIN_VOTES and
SHARE of the shorter recording's places, and at most MAX_ERROR of the bits of the whole overlap differ: so one recording is for the
most part heard in the other, and a stretch that many recordings share doesn't join those that are unlike otherwise.

Search. Of a recording with n places, of which SHARE must agree, any n - SHARE * n + 1 places hold one that agrees: its probes
are those with the rarest keys. A pair can be a link only if the two share a key that is a probe of the shorter one, at an offset
whose overlap is long enough; so keys of common stretches bring pairs together only where little else is left to tell them by. Classes are the
components of all links, exactly: recordings with equal fingerprints meet as one; then ROUNDS rounds, each linear in the keys,
compare every holder of a key with one leader of it, and classes grow; at last every pair of different classes that meets the condition
above is compared. A group of copies is thus never compared in pairs.

Short recordings. One with fewer than MIN_OVERLAP places is aligned at a finer scale (SCALES: shorter frames and hops), the first
at which it has as many; recordings up to twice as long as any of that scale take part there too, so that two whose lengths differ by less
than a factor of two always meet. Recordings too short for every scale meet when their samples are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedge.llm.pieces import mixed
from sedge.operators.components import components
from sedge.session import stored

RATE, FRAME, HOP, SPAN = 8000, 256, 64, 16
MIN_VOTES, SHARE, MAX_ERROR, MIN_OVERLAP = 4, 0.5, 0.2, 8
ROUNDS = 2
LOWEST, HIGHEST = 28.0, 3520.0
CHUNK = 1 << 15


#: (samples of a frame, of a hop) of each scale, and the least samples that give MIN_OVERLAP places.
SCALES = ((FRAME, HOP), (128, 32), (64, 16), (32, 8), (16, 4), (16, 2), (16, 1))
LEAST = tuple(frame + (SPAN + MIN_OVERLAP - 2) * hop for frame, hop in SCALES)


def _fold(frame: int) -> np.ndarray:
    """Weights from spectrum bins to pitch classes."""
    f = np.fft.rfftfreq(frame, 1 / RATE)
    m = np.zeros((len(f), 12))
    for i, x in enumerate(f):
        if LOWEST <= x <= HIGHEST:
            m[i, int(round(12 * np.log2(x / 440))) % 12] = 1
    return m


#: Filters (shape, first pitch class, pitch classes, frames), by a rule: shapes in turn, over bands that move by five.
FILTERS = [(i % 4, (5 * i) % 12 - (5 * i) % 12 % 2, (4, 6, 8, 12)[i // 4], (16, 8, 12, 4)[i % 4]) for i in range(16)]
#: Quarters of what each shape gives on noise.
LEVELS = (-0.15, 0.0, 0.15)
_FOLD, _TAPER = {f: _fold(f) for f, _ in SCALES}, {f: np.hanning(f) for f, _ in SCALES}


def _wav(raw: bytes) -> np.ndarray | None:
    """The samples of a WAV file of whole-number samples, its channels averaged; None if raw is none."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]  # a size beyond the file's end means the rest of it
        if name == b"fmt " and len(body) >= 16:
            form = int.from_bytes(body[:2], "little"), int.from_bytes(body[2:4], "little"), int.from_bytes(body[14:16], "little")
        elif name == b"data" and form:
            kind, channels, bits = form
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels:
                return None
            wide = bits // 8
            body = np.frombuffer(body[: len(body) // (wide * channels) * wide * channels], np.uint8).reshape(-1, wide)
            if wide == 1:
                x = (body[:, 0].astype(np.float32) - 128) / 128
            else:
                whole = np.zeros((len(body), 4), np.uint8)
                whole[:, 4 - wide :] = body
                x = (whole.view("<i4")[:, 0] / np.float64(1 << 31)).astype(np.float32)
            return x.reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    return None


def samples(media: bytes | None) -> np.ndarray:
    """The samples of a recording, from -1 to 1: of a WAV file if it is one that can be read, else of all bytes, 8 bits each."""
    if not media:
        return np.zeros(0, np.float32)
    if (x := _wav(media)) is not None:
        return x
    return (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128


def chroma(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, 12): the pitch classes of each whole frame, each row of length 1 (silence: 0)."""
    n = (len(x) - frame) // hop + 1
    if n < 1:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    parts = []
    for at in range(0, n, CHUNK):
        energy = np.abs(np.fft.rfft((view[at : at + CHUNK] - view[at : at + CHUNK].mean(axis=1, keepdims=True)) * _TAPER[frame], axis=1)) ** 2
        parts.append(energy @ _FOLD[frame])
    c = np.concatenate(parts)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _boxes() -> np.ndarray:
    """For the places of an integral image under one window, a column for each filter's first sum and one for each one's second."""
    out = np.zeros((2, len(FILTERS), SPAN + 1, 25))

    def box(side, f, t0, t1, y0, y1, sign=1):
        for t, y, one in ((t1, y1, 1), (t0, y1, -1), (t1, y0, -1), (t0, y0, 1)):
            out[side, f, t, y] += sign * one

    for f, (shape, y, h, w) in enumerate(FILTERS):
        m, q, k = w // 2, y + h // 2, h // 4
        if shape == 0:  # upper against lower pitch classes
            box(0, f, 0, w, y, q), box(1, f, 0, w, q, y + h)
        elif shape == 1:  # earlier against later
            box(0, f, 0, m, y, y + h), box(1, f, m, w, y, y + h)
        elif shape == 2:  # diagonals
            box(0, f, 0, m, y, q), box(0, f, m, w, q, y + h), box(1, f, 0, m, q, y + h), box(1, f, m, w, y, q)
        else:  # the middle half against the rest
            box(0, f, 0, w, y + k, y + h - k), box(1, f, 0, w, y, y + h), box(1, f, 0, w, y + k, y + h - k, -1)
    return out.reshape(2 * len(FILTERS), -1).T.copy()


#: Steps of an energy from 0 to 1: whole numbers, whose sums are exact however they are added up.
STEPS = 1 << 16
_BOXES, _GRAY = _boxes(), np.array([0, 1, 3, 2], np.uint32)
_PLACES = (np.uint32(1) << np.arange(2 * (len(FILTERS) - 1), -1, -2, dtype=np.uint32)).astype(np.uint32)


def packed(c: np.ndarray) -> np.ndarray:
    """The packed integers (as signed 32 bits) of pitch-class frames; none for fewer than SPAN frames."""
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int32)
    image = np.zeros((len(c) + 1, 25))
    whole = np.rint(c * STEPS)
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([whole, whole], axis=1), axis=0), axis=1)  # pitch classes go round
    windows = np.lib.stride_tricks.sliding_window_view(image, (SPAN + 1, 25))[:, 0]
    out = np.zeros(n, np.uint32)
    for at in range(0, n, CHUNK // 8):
        sums = STEPS + np.maximum(windows[at : at + CHUNK // 8].reshape(-1, len(_BOXES)) @ _BOXES, 0)
        ratio = sums[:, : len(FILTERS)] / sums[:, len(FILTERS) :]
        level = sum((ratio > x).astype(np.uint8) for x in np.exp(LEVELS))
        out[at : at + CHUNK // 8] = _GRAY[level] @ _PLACES
    return out.view(np.int32)


def fingerprint(media: bytes | None) -> np.ndarray:
    return packed(chroma(samples(media)))


def scales_of(n: int) -> list[int]:
    """The scales at which a recording of n samples is aligned, the coarsest first; none for the shortest."""
    return [k for k, least in enumerate(LEAST) if n >= least and (k == 0 or n < 2 * LEAST[k - 1])]


_SCALED = "array<struct<scale:int,fp:array<int>>>"


def fingerprints(media: DataFrame) -> DataFrame:
    """media (id, media: binary) -> id, fp: array<int>, finer: array of (scale, fp), digest: 16 bytes.

    Null, empty and short recordings have an empty fp; finer holds the fingerprints to be aligned at scales after the first. The digest
    is of the coarsest fingerprint to be aligned, without one of the samples; null for null.
    """

    def run(batches):
        for b in batches:
            fps, finer, digests = [], [], []
            for m in b.column(1):
                x = samples(m.as_py())
                fps.append(packed(chroma(x)))
                own = [(k, fps[-1] if k == 0 else packed(chroma(x, *SCALES[k]))) for k in scales_of(len(x))]
                finer.append([{"scale": k, "fp": fp} for k, fp in own if k])
                if not m.is_valid:
                    digests.append(None)
                elif own:
                    digests.append(hashlib.blake2b(own[0][1].tobytes(), digest_size=16, salt=bytes([own[0][0]])).digest())
                else:
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16, salt=b"samples").digest())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(fps, pa.list_(pa.int32())),
                    pa.array(finer, pa.list_(pa.struct([("scale", pa.int32()), ("fp", pa.list_(pa.int32()))]))), pa.array(digests, pa.binary()),
                ],
                names=["id", "fp", "finer", "digest"],
            )

    return media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media")).mapInArrow(
        run, f"id long, fp array<int>, finer {_SCALED}, digest binary"
    )


def keys(fp: np.ndarray) -> np.ndarray:
    """The key of each place: two packed integers in a row."""
    wide = fp.astype(np.int64)
    return (wide[:-1] << 32) | (wide[1:] & 0xFFFFFFFF)


def needed(n):
    """The votes that a link needs whose shorter recording has n places; of a number, an array or a Column."""
    if isinstance(n, Column):
        return F.greatest(F.lit(MIN_VOTES), F.ceil(F.lit(SHARE) * n)).cast("int")
    return np.maximum(MIN_VOTES, np.ceil(SHARE * n)).astype(np.int64)


def best_offset(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(votes, offset) of the best offset of two recordings' keys: place i of a lies at place i - offset of b."""
    votes = np.zeros(len(a) + len(b), np.int64)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    both, at_a, n_a = np.unique(a[order_a], return_index=True, return_counts=True)
    there, at_b, n_b = np.unique(b[order_b], return_index=True, return_counts=True)
    _, i, j = np.intersect1d(both, there, assume_unique=True, return_indices=True)
    once = (n_a[i] == 1) & (n_b[j] == 1)
    np.add.at(votes, order_a[at_a[i[once]]] - order_b[at_b[j[once]]] + len(b) - 1, 1)
    for x, y in zip(i[~once].tolist(), j[~once].tolist()):  # a key that is held more than once: each pair of its places votes
        one, two = order_a[at_a[x] : at_a[x] + n_a[x]], order_b[at_b[y] : at_b[y] + n_b[y]]
        for part in range(0, len(one), max(1, CHUNK // len(two))):
            off = (one[part : part + max(1, CHUNK // len(two)), None] - two[None]).ravel() + len(b) - 1
            votes += np.bincount(off, minlength=len(votes))
    most = votes.max(initial=0)
    tied = np.flatnonzero(votes == most) - (len(b) - 1)
    return int(most), int(min(tied.tolist(), key=lambda x: (abs(x), x)))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, length) of the overlap of two fingerprints when place i of a lies at place i - offset of b."""
    x, y = a[max(offset, 0) :], b[max(-offset, 0) :]
    n = min(len(x), len(y))
    return int(np.bitwise_count((x[:n] ^ y[:n]).view(np.uint32)).sum()) / (32 * n), n


def link(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(votes, shift, error) of two fingerprints if they are a link."""
    ka, kb = keys(a), keys(b)
    votes, shift = best_offset(ka, kb)
    if votes < needed(min(len(ka), len(kb))):
        return None
    error, n = bit_error(a, b, shift)
    return (votes, shift, error) if n >= MIN_OVERLAP and error <= MAX_ERROR else None


def key_hashes(recordings: pa.ListArray, bits: int) -> tuple[np.ndarray, ...]:
    """(row, scale, fingerprint, its places, place, key) of each place of a column's fingerprints, as arrays.

    row counts the column's rows and fingerprint its fingerprints. A key is the hash of scale and key in so many bits: equal ones of
    different keys only add pairs to compare.
    """
    of = recordings.flatten()
    row = np.repeat(np.arange(len(recordings)), recordings.value_lengths().to_numpy())
    fps, scale = of.field(1), of.field(0).to_numpy()
    n = fps.value_lengths().to_numpy().astype(np.int64)
    ints = fps.flatten().to_numpy()
    which = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(ints), bool)
    keep[np.cumsum(n)[n > 0] - 1] = False  # the last integer of a fingerprint begins no key
    at = np.flatnonzero(keep)
    which = which[at]
    start = np.concatenate([[0], np.cumsum(n)])[which]
    wide = ints.astype(np.int64)
    key = ((wide[at] << 32) | (wide[np.minimum(at + 1, len(ints) - 1)] & 0xFFFFFFFF)).view(np.uint64)
    key = mixed(key + scale[which].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return row[which], scale[which], which, n[which] - 1, at - start, key.view(np.int64)


def _firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts rows by these columns, whether each row in that order is the first of its kind)."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, new


def held_keys(recordings: DataFrame, bits: int) -> DataFrame:
    """recordings (id, scaled) -> id, key: each different key of a recording once."""

    def run(batches):
        for b in batches:
            row, *_, key = key_hashes(b.column(1), bits)
            order, new = _firsts(row, key)
            ids = b.column(0).to_numpy()[row[order[new]]]
            whole = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key[order[new]])], names=["id", "key"])
            for at in range(0, whole.num_rows, CHUNK):
                yield whole.slice(at, CHUNK)

    return recordings.select("id", "scaled").mapInArrow(run, "id long, key long")


def probed(held: DataFrame, bits: int) -> DataFrame:
    """held (id, scaled, common: array of (key, holders)) -> id, scale, key, first, last (places), n (places of the recording), probe.

    A row for each common key of a recording; probe marks those of which a link to a recording at least as long must share one.
    Keys that only one recording holds come first among the probes and need no row.
    """

    def run(batches):
        for b in batches:
            row, scale, which, n, at, key = key_hashes(b.column(1), bits)
            known = b.column(2).flatten()
            known_row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            known_key, holders = known.field(0).to_numpy(), known.field(1).to_numpy()
            # the common keys of all rows and the places of all fingerprints, sorted together: a place finds its key's holders just before it
            order, _ = _firsts(np.concatenate([known_row, row]), np.concatenate([known_key, key]), np.concatenate([np.zeros(len(known_row), int), 1 + which]), np.concatenate([np.zeros(len(known_row), int), at]))
            is_known = order < len(known_row)
            last_known = np.maximum.accumulate(np.where(is_known, np.arange(len(order)), -1))
            place = np.flatnonzero(~is_known & (last_known >= 0))
            mine, of = order[place] - len(known_row), order[last_known[place]]
            same = (known_row[of] == row[mine]) & (known_key[of] == key[mine])
            mine, of = mine[same], of[same]
            new = np.ones(len(mine), bool)
            new[1:] = (which[mine[1:]] != which[mine[:-1]]) | (key[mine[1:]] != key[mine[:-1]])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(mine)))
            head, tail = mine[first], mine[first + times - 1]
            # of each fingerprint the rarest first; those that only it holds come before all of these
            rare = np.lexsort((key[head], holders[of[first]], which[head]))
            done = np.cumsum(times[rare])
            begins = np.ones(len(rare), bool)
            begins[1:] = which[head[rare[1:]]] != which[head[rare[:-1]]]
            base = np.maximum.accumulate(np.where(begins, done - times[rare], 0))
            common = np.bincount(which[mine], minlength=int(which.max(initial=-1)) + 1)
            before = np.empty(len(rare), np.int64)
            before[rare] = done - times[rare] - base + (n - common[which])[head[rare]]
            out = [b.column(0).to_numpy()[row[head]], scale[head].astype(np.int32), key[head], at[head].astype(np.int32), at[tail].astype(np.int32), n[head].astype(np.int32), before < n[head] - needed(n[head]) + 1]
            whole = pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["id", "scale", "key", "first", "last", "n", "probe"])
            for i in range(0, whole.num_rows, CHUNK):
                yield whole.slice(i, CHUNK)

    return held.select("id", "scaled", "common").mapInArrow(run, "id long, scale int, key long, first int, last int, n int, probe boolean")


def _may_overlap(a: str, b: str) -> Column:
    """Whether at some offset that puts a place of a's key on one of b's the overlap can hold the needed votes."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    lo, hi = F.col(f"{a}.first") - F.col(f"{b}.last"), F.col(f"{a}.last") - F.col(f"{b}.first")
    off = F.greatest(lo, F.least(hi, F.least(F.lit(0), n_a - n_b)))  # the offset in lo..hi with the longest overlap
    overlap = F.least(n_a - F.greatest(off, F.lit(0)), n_b - F.greatest(-off, F.lit(0)))
    return overlap >= needed(F.least(n_a, n_b))


def links(met: DataFrame, recordings: DataFrame) -> DataFrame:
    """met (scale, a, b), repeats allowed, recordings (id, scale, fp) -> the links id > to, scale, votes, shift (hops), error."""
    pairs = (
        met.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("to"), "scale")
        .distinct()
        .join(recordings.select("id", "scale", F.col("fp").alias("a")), ["id", "scale"])
        .join(recordings.select(F.col("id").alias("to"), "scale", F.col("fp").alias("b")), ["to", "scale"])
    )

    def run(batches):
        for batch in batches:
            i, to, scale = [batch.column(k).to_pylist() for k in range(3)]
            found = [link(*[x.values.to_numpy(zero_copy_only=False) for x in ab]) for ab in zip(batch.column(3), batch.column(4))]
            rows = [(x, y, z, *f) for x, y, z, f in zip(i, to, scale, found) if f]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))],
                names=["id", "to", "scale", "votes", "shift", "error"],
            )

    return pairs.select("id", "to", "scale", "a", "b").mapInArrow(run, "id long, to long, scale int, votes long, shift int, error double")


def linked(recordings: DataFrame, total: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """recordings (id, scaled), each id once, with about `total` places in all -> (links that join the classes; node, root of all linked ones)."""
    bits = min(64, total.bit_length() + 9)  # a key meets a different one of the same number in less than one of 512 cases
    every = held_keys(recordings, bits)
    common = every.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1")
    of = every.join(common, "key").groupBy("id").agg(F.collect_list(F.struct("key", "holders")).alias("common"))  # at most a recording's own keys
    # Only recordings with a common key can be compared.
    compared = stored(recordings.join(of, "id").select("id", "scaled", "common"), "compared")
    rows = stored(probed(compared, bits), "probed")
    live = rows.groupBy("scale", "key").agg(F.max("probe").alias("live"), F.count("*").alias("n")).where("live and n > 1").select("scale", "key")
    rows = stored(rows.join(live, ["scale", "key"], "left_semi"), "keys")
    prints = compared.select("id", F.inline("scaled")).join(rows.select("id", "scale").distinct(), ["id", "scale"], "left_semi")
    prints = stored(prints, "prints")  # of those that can still be compared
    found, roots = None, None
    for r in range(rounds + 1):
        if roots is None:
            holders = rows.withColumn("class", F.col("id"))
        else:
            now = roots.select(F.col("node").alias("id"), F.col("root").alias("class"))
            holders = rows.join(now, "id", "left").withColumn("class", F.coalesce("class", "id"))
        mine = holders.select("scale", "key", F.struct("id", "first", "last", "n", "probe", "class").alias("a"))
        order = F.col("n").cast("long") if r == 0 else F.xxhash64("id", F.lit(r))
        leads = (
            holders.groupBy("scale", "key")
            .agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max(F.struct("probe", order.alias("order"), "id", "first", "last", "n", "class")).alias("b"))
            .where("lo < hi")
        )
        if r < rounds:
            met = mine.join(leads.select("scale", "key", "b"), ["scale", "key"]).where((F.col("a.class") != F.col("b.class")) & _may_overlap("a", "b"))
        else:  # what is left: classes that share keys and did not link by way of leaders
            mine = stored(mine.join(leads.select("scale", "key"), ["scale", "key"], "left_semi"), "contested")
            met = mine.where("a.probe").join(mine.withColumnRenamed("a", "b"), ["scale", "key"])
            met = met.where((F.col("a.class") != F.col("b.class")) & (F.col("a.n") <= F.col("b.n")) & _may_overlap("a", "b"))
        new = stored(links(met.select("scale", F.col("a.id").alias("a"), F.col("b.id").alias("b")), prints), "links")
        found = new if found is None else found.union(new)
        joins = new.select(F.col("id").alias("a"), F.col("to").alias("b"))
        if roots is None:
            roots = stored(components(joins), "classes")
        elif not new.isEmpty():
            roots = stored(components(joins.union(roots.where("node <> root").select("node", "root"))), "classes")
    return found, roots


def aligned(media: DataFrame, shown: Column | None = None) -> DataFrame:
    """media (id, media: binary, ...) -> id, n_places, fp (the packed integers at FRAME and HOP), class_id, match_id, shift, hop, error.

    shown, an expression over fp, takes its place: a digest travels lighter than a fingerprint.

    One row for each row. class_id is the least id of the recording's class. match_id is the least id of an equal
    fingerprint or, for that one itself, of the links that joined the classes the one to a smaller id with the most votes (ties:
    the smallest): a link, not always the best of all; shift is its offset in hops, hop the samples of one, error the share of differing bits; null without one.
    Recordings of fewer than LEAST[-1] samples, also empty ones, meet only equal ones; null ones are classes of their own; rows with a null id
    aren't aligned; of rows that repeat an id one, that of the least digest, is aligned for all of them; other columns are ignored.
    """
    prints = stored(fingerprints(media), "prints")
    one = prints.where("id is not null and digest is not null").groupBy("id").agg(F.min("digest").alias("digest"))
    least = one.groupBy("digest").agg(F.min("id").alias("rec"))
    named = stored(one.join(least, "digest").select("id", "rec", "digest"), "named")
    every = F.size("fp") + F.aggregate("finer", F.lit(0), lambda n, x: n + F.size(x["fp"]))
    total = prints.agg(F.coalesce(F.sum(every), F.lit(0))).first()[0]
    first = F.when(F.size("fp") >= MIN_OVERLAP, F.array(F.struct(F.lit(0).alias("scale"), "fp"))).otherwise(F.array().cast(_SCALED))
    scaled = prints.select("id", "digest", F.concat(first, "finer").alias("scaled")).where(F.size("scaled") > 0)
    chosen = named.where("id = rec").select("id", F.col("digest").alias("its"))
    found, roots = linked(scaled.join(chosen, "id").where("digest = its").dropDuplicates(["id"]).select("id", "scaled"), total)
    match = found.groupBy("id").agg(F.max(F.struct("votes", (-F.col("to")).alias("less"), "to", "shift", "scale", "error")).alias("m"))
    known = (
        named.join(roots.select(F.col("node").alias("rec"), "root"), "rec", "left")
        .join(match.select(F.col("id").alias("rec"), "m"), "rec", "left")
        .select("id", "rec", F.coalesce("root", "rec").alias("class"), "m")
    )
    copy = F.col("rec") < F.col("id")
    heard = prints.select("id", F.size("fp").cast("long").alias("n_places"), (F.col("fp") if shown is None else shown).alias("fp"))
    return heard.join(known, "id", "left").select(
        "id",
        "n_places",
        "fp",
        F.coalesce("class", "id").alias("class_id"),
        F.when(copy, F.col("rec")).otherwise(F.col("m.to")).alias("match_id"),
        F.when(copy, F.lit(0)).otherwise(F.col("m.shift")).alias("shift"),
        F.when(~copy & F.col("m").isNotNull(), F.element_at(F.array(*[F.lit(hop) for _, hop in SCALES]), F.col("m.scale") + 1)).alias("hop"),
        F.when(copy, F.lit(0.0)).otherwise(F.col("m.error")).alias("error"),
    )
