"""Anchored stretches of texts: where equal 200-byte strings can be told from few places.

Of the 161 grams of 40 bytes inside a 200-byte string, the one with the smallest hash (the first of equals) is
the string's anchor. It depends on the string alone, so equal strings have equal anchors at equal offsets.
Neighbouring strings mostly share their anchor; a *stretch* is a run of string starts with one anchor, about 80 starts long.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200  # bytes of a string
GRAM = 40
WINDOWS = LENGTH - GRAM + 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)
PLACE_BITS = np.uint64(24)
MOST_BYTES = 1 << 20  # of a slice; positions must fit into PLACE_BITS
_TABLES = np.random.default_rng(20_240).integers(0, 1 << 63, size=(2, 256), dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.empty(n + 1, dtype=np.uint64), np.empty(n + 1, dtype=np.uint64)
    for out, factor in ((up, BASE), (down, inverse)):
        out[0] = 1
        done = 1
        step = factor
        while done <= n:  # doubling: the next run is the one before times a power
            take = min(done, n + 1 - done)
            out[done : done + take] = out[:take] * step
            done += take
            with np.errstate(over="ignore"):
                step = step * step
    return up, down


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = _powers(size)
    up, down = _CACHE[size]
    return up[: n + 1], down[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX
    h = (h ^ (h >> SHIFT)) * MIX
    return h ^ (h >> SHIFT)


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, count, gram hash, content hash, anchor's offset of every stretch of the texts laid end to end in ``data``.

    ``ends``: where each text ends. No string crosses an end. The content is all bytes that the strings of the
    stretch touch; its hash also holds its length and the anchor's offset.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    up, down = powers(n)
    sums = []
    for table in _TABLES:
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        sums.append(total)
    grams = mixed((sums[0][GRAM:] - sums[0][:-GRAM]) * down[: n - GRAM + 1])
    keys = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(n - GRAM + 1, dtype=np.uint64)
    least, width = keys, 1
    while width * 2 <= WINDOWS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOWS - width
    least = np.minimum(least[: len(least) - rest], least[rest:])  # one for each string start
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n - LENGTH + 2, dtype=np.int8)
    long_enough = ends - starts >= LENGTH
    np.add.at(valid, starts[long_enough], 1)
    np.add.at(valid, ends[long_enough] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    change = np.empty(len(least), dtype=bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.concatenate([first, [len(least)]]))
    keep = valid[first]
    first, count = first[keep], count[keep]
    anchor = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    stop = first + count + LENGTH - 1
    content = mixed((sums[1][stop] - sums[1][first]) * down[first])
    content = mixed(content + ((stop - first).astype(np.uint64) << np.uint64(16)) + (anchor - first).astype(np.uint64))
    return first, count, grams[anchor], content, anchor - first
