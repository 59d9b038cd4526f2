"""Pieces of many texts at once, as numpy arrays: where they start, their hashes, which are equal."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """h with every bit depending on all of it."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]: a polynomial of random letters, made for all slices by one running sum."""
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LETTER[buf] * power[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def unique(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each different piece, number of its piece for each). Pieces of one hash are compared in length and ends."""
    h = hashes(buf, starts, ends)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    n, rep = ends - starts, first[of]
    same = (n == n[rep]) & (buf[starts] == buf[starts[rep]]) & (buf[ends - 1] == buf[ends[rep] - 1])
    if not same.all():  # two pieces share a hash: compare the bytes themselves
        raw, seen = buf.tobytes(), {}
        of = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        _, first = np.unique(of, return_index=True)
    return first, of


def cut(raw: bytes, size: int, starts) -> list[bytes]:
    """raw in parts of some `size` bytes, each but the first from one of starts(buf), where it may be cut; a part without such a place is as long as it is."""
    parts, at = [], 0
    while len(raw) - at > size:
        end, step = at + size, size
        while end < len(raw):
            found = np.flatnonzero(starts(np.frombuffer(raw, np.uint8, min(step, len(raw) - end) + 1, end - 1))[1:])
            if len(found):
                end += int(found[0])
                break
            end += step
        if end >= len(raw):
            break
        parts.append(raw[at:end])
        at = end
    return [*parts, raw[at:]]
