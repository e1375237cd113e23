"""Sorted runs of byte strings: front coding, and a merge that never compares a known common prefix again.

A run stores of each string how many bytes it shares with the one before, and the rest. The merge is a loser
tree whose nodes keep, with each loser, how many bytes it shares with the string that beat it. Of two strings that
share different lengths with the last output, the one that shares more is smaller, without looking at a byte; only
equal lengths are compared, from that length on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, at least ``known`` bytes of which are known to agree."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def front_coded(strings: list[bytes], repeated: list[bool]) -> bytes:
    """A sorted run without equal strings; ``repeated`` tells which ones stood for several."""
    prefix = [0] * len(strings)
    for i in range(1, len(strings)):
        prefix[i] = shared(strings[i - 1], strings[i])
    lengths = np.array([len(s) for s in strings], dtype="<u2")
    return b"".join(
        [
            np.array([len(strings)], dtype="<u4").tobytes(),
            np.array(prefix, dtype="<u2").tobytes(),
            lengths.tobytes(),
            np.array(repeated, dtype=np.uint8).tobytes(),
            *[s[p:] for s, p in zip(strings, prefix)],
        ]
    )


def decoded(run: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """(string, bytes shared with the one before, repeated) of a run, in order."""
    n = int(np.frombuffer(run, dtype="<u4", count=1)[0])
    prefix = np.frombuffer(run, dtype="<u2", count=n, offset=4).tolist()
    lengths = np.frombuffer(run, dtype="<u2", count=n, offset=4 + 2 * n).tolist()
    repeated = np.frombuffer(run, dtype=np.uint8, count=n, offset=4 + 4 * n).tolist()
    at, last = 4 + 5 * n, b""
    for p, length, twice in zip(prefix, lengths, repeated):
        last = last[:p] + run[at : at + length - p]
        at += length - p
        yield last, p, bool(twice)


def merged(runs: list[bytes]) -> Iterator[tuple[bytes, int, bool]]:
    """(string, bytes shared with the output before, repeated) of all runs, in order, equal strings one after the other."""
    size = 1
    while size < max(2, len(runs)):
        size *= 2
    sources = [decoded(run) for run in runs]
    head: list[tuple[bytes, int, bool] | None] = [next(s, None) for s in sources] + [None] * (size - len(runs))
    common = [0] * size  # of each run's head with the last output, or with the string that beat it
    loser = [0] * size

    def beats(a: int, b: int) -> bool:
        """Plays two heads whose ``common`` refer to one string; leaves the loser's as shared with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None
        if common[a] != common[b]:
            return common[a] > common[b]
        known = shared(x[0], y[0], common[a])
        wins = x[0][known:] <= y[0][known:]
        common[b if wins else a] = known
        return wins

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        wins = beats(a, b)
        loser[node] = b if wins else a
        return a if wins else b

    best = build(1)
    while (top := head[best]) is not None:
        yield top[0], common[best], top[2]
        following = next(sources[best], None)
        head[best] = following
        common[best] = following[1] if following else 0
        node = (best + size) // 2
        while node:
            if beats(loser[node], best):
                best, loser[node] = loser[node], best
            node //= 2
