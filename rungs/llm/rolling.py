"""Hashes of all windows of a sequence with numpy, and the choice of the least hash in each window."""

from __future__ import annotations

import numpy as np
import xxhash

_M64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: One random 64-bit value for each byte.
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG = 256
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def _grown(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n of them at least."""
    if len(_powers[which][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            a = np.ones(1, np.uint64)
            while len(a) < size:  # doubling: the second half is the first times base**len
                a = np.concatenate([a, a * np.uint64(pow(base, len(a), 1 << 64))])
            made.append(a)
        _powers[which] = (made[0], made[1])
    return _powers[which]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values times the powers of a base: what spans() needs."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _grown(which, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of values[start:end], the same wherever these values stand."""
    return mixed((prefix[end] - prefix[start]) * _grown(which, len(prefix))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text: runs of anything but space and the bytes 9 to 13."""
    b = np.frombuffer(data, np.uint8)
    ink = np.zeros(len(b) + 2, bool)
    ink[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    turn = np.flatnonzero(ink[1:] != ink[:-1])
    start, end = turn[::2], turn[1::2]
    h = spans(sums(_BYTES[b]), start, end)
    for i in np.flatnonzero(end - start > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], 1)
    return start, end, h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the place of the least (by its upper 32 bits; the leftmost of equals)."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    key = (h & np.uint64(_M64 ^ 0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    grid = np.concatenate([key, np.full(pad, _M64, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, first window, windows after the last: the runs of windows that choose one place."""
    if not len(places):
        return places, places, places
    first = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
    return places[first], first, np.concatenate([first[1:], [len(places)]])
