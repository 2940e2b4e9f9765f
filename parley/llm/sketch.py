"""Fast similarity sketches of sets: rounds of hashed bin placement in which every coordinate fills.

In round i every element of the set is hashed to a bin and a value; the bin keeps the least (round, value). For the
first t rounds an element's bin is random, in round t + b it is bin b; so after 2 t rounds at the latest every bin is
full, and most sets are done after about t ln(t) / |set| rounds. Two sets agree in a coordinate with a probability
equal to their Jaccard similarity, with concentration as of independent draws.
"""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _shift(i: int) -> np.uint64:
    return np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def sketches(values: np.ndarray, offsets: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """Sketches [n, t] of n sets of 64-bit hashes; set k is values[offsets[k]:offsets[k + 1]]. Empty sets give rows of the greatest number.

    t must be below 2**15. Repeated elements count once, as equal hashes meet in the same bin.
    """
    base, where = np.unique(values.astype(np.uint64), return_inverse=True)
    return placed(base, where.ravel(), offsets, t, seed)


def placed(base: np.ndarray, where: np.ndarray, offsets: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """As sketches(), of sets given as places in the table `base` of hashes: set k is base[where[offsets[k]:offsets[k + 1]]]."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    base = mix(base + _shift(seed))
    row = np.repeat(np.arange(n), sizes)
    open_rows = np.flatnonzero(sizes > 0)
    live_row, live_elem = row, where
    for i in range(t):
        if not len(open_rows):
            break
        h = mix(base + _shift(i + 1))
        slot = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)  # a bin from the upper half
        key = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, live_row * t + slot[live_elem].astype(np.int64), key[live_elem])
        if i % 4 == 3 or i == t - 1:  # a full bin no longer changes, as its round is earlier
            full = (out.reshape(n, t)[open_rows] != np.iinfo(np.uint64).max).all(axis=1)
            open_rows = open_rows[~full]
            alive = np.zeros(n, bool)
            alive[open_rows] = True
            keep = alive[live_row]
            live_row, live_elem = live_row[keep], live_elem[keep]
    if len(open_rows):  # the second half of the rounds, for the bins still empty
        r, b = np.nonzero(out.reshape(n, t)[open_rows] == np.iinfo(np.uint64).max)
        starts, lens = offsets[open_rows[r]], sizes[open_rows[r]]
        ends = np.cumsum(lens)
        elem = where[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]
        bins = np.repeat(b, lens)
        h = mix(base[elem] + (np.uint64(t + 1) + bins.astype(np.uint64)) * _STEP)
        key = ((np.uint64(t) + bins.astype(np.uint64)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        out[open_rows[r] * t + b] = np.minimum.reduceat(key, ends - lens)
    return out.reshape(n, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each run of `rows` coordinates; the band's number is part of it."""
    n, t = sketch.shape
    count = t // rows
    parts = sketch[:, : count * rows].reshape(n, count, rows)
    h = np.broadcast_to(mix(np.arange(count, dtype=np.uint64) + np.uint64(77)), (n, count)).copy()
    for k in range(rows):
        h = mix(h * np.uint64(31) + parts[:, :, k] + _STEP)
    return h.view(np.int64)
