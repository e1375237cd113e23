"""Periodic runs of words, found with a dictionary of basic factors.

A basic factor is a stretch of 2^k words. Level by level each place gets the number of the factor that begins there: a
factor of 2^(k+1) words is the pair of the numbers of its halves. Occurrences of one factor of length m that lie within
2m words of each other form an arithmetic progression, whose difference is a period. So on each level the next
occurrence of each place's factor, if it begins at most m words on, proposes a period; neighbouring places that propose the same
one are a stretch, which is extended by the length of the factor and merged with equal runs of other levels.

With m between q and 2q, a factor inside of a run of smallest period q recurs in it at multiples of q alone. A run of
four periods or more has such factors, so each run is proposed by the level of such an m, whole and with its
smallest period. A factor that occurs once in its text cannot be part of a longer one that recurs and is dropped, so in plain prose
the higher levels are all but empty. A text of n words takes O(n log n) numbers sorted on each of log n levels; no text is compared with another.

The rows of a table are treated one by one, a few megabytes at a time; nothing is shuffled.

Cases: a null or empty text has no words, no run, and the digests of the empty string. A text of any length is taken whole. Repeated
rows give equal results. A null ``doc_id`` stays null, and its words stay as they are in the query. Ties for the longest run go to the smallest
start, then the smallest period. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import table
from termloom.llm.wordcut import BLANKS, Words, flat, gathered, numbered, sliced, words_in

LEAST_WORDS = 6
LEAST_PERIODS = 4
BATCH_BYTES = 2 << 20
WORDS_AT_ONCE = 1 << 18  # that are put into a digest
COLUMNS = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long"
)
Order = Callable[[int | None, int], np.ndarray | None]


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of every run of the texts, by start and period.

    ``ids``: numbers that tell words apart, all texts laid end to end. ``bounds``: where each begins, with the end of the last.
    """
    none = np.empty(0, dtype=np.int64)
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    places = np.flatnonzero(lengths[text] >= LEAST_WORDS) if len(text) else none
    names = _compact(text[places] * (int(ids.max()) + 1) + ids[places]) if len(places) else none
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    m = 1
    while len(places):
        order = np.argsort(names, kind="stable")  # by factor, and by place within it
        ordered, name = places[order], names[order]
        again = name[1:] == name[:-1]
        gap = ordered[1:] - ordered[:-1]
        near = again & (gap <= m)
        found.append(_stretches(ordered[:-1][near], gap[near], m))
        recurs = np.zeros(len(order), dtype=bool)
        recurs[1:] |= again
        recurs[:-1] |= again
        kept = np.zeros(len(order), dtype=bool)
        kept[order] = recurs
        # Longer periods need a text of LEAST_PERIODS times more than m words.
        kept &= lengths[text[places]] >= LEAST_PERIODS * (m + 1)
        places, names = places[kept], names[kept]
        if not len(places):
            break
        other = np.minimum(np.searchsorted(places, places + m), len(places) - 1)
        both = (places[other] == places + m) & (text[places[other]] == text[places])
        names = _compact(names[both] * (int(names.max()) + 1) + names[other[both]])
        places = places[both]
        m *= 2
    start, length, period = (np.concatenate([f[i] for f in found]) if found else none for i in range(3))
    order = np.lexsort((length, period, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (period[1:] != period[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def _compact(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


def _stretches(places: np.ndarray, gaps: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places with the same gap, extended by factor and gap; those long enough to be a run."""
    order = np.argsort(places, kind="stable")
    places, gaps = places[order], gaps[order]
    breaks = np.ones(len(places), dtype=bool)
    breaks[1:] = (places[1:] != places[:-1] + 1) | (gaps[1:] != gaps[:-1])
    first = np.flatnonzero(breaks)
    last = np.append(first[1:], len(places)) - 1 if len(first) else first
    start, period = places[first], gaps[first]
    length = places[last] - start + m + period
    whole = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return start[whole], length[whole], period[whole]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for each of the n words that some run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def joined_digests(words: Words, which: np.ndarray, text: np.ndarray, n_texts: int) -> list[str]:
    """sha256 of the named words of each text, joined by one blank. ``text`` ascends."""
    digests = [hashlib.sha256() for _ in range(n_texts)]
    begun = np.zeros(n_texts, dtype=bool)
    for low in range(0, len(which), WORDS_AT_ONCE):
        some, own = which[low : low + WORDS_AT_ONCE], text[low : low + WORDS_AT_ONCE]
        lengths = words.ends[some] - words.starts[some] + 1
        ends = np.cumsum(lengths)
        content = gathered(words.data, words.starts[some] - 1, lengths)  # each word and the byte before it
        content[ends - lengths] = 0x20
        content = content.tobytes()
        firsts = np.flatnonzero(np.diff(own, prepend=-1))
        for first, last in zip(firsts.tolist(), np.append(firsts[1:], len(own)).tolist()):
            one = int(own[first])
            at = int(ends[first] - lengths[first]) + (0 if begun[one] else 1)
            digests[one].update(content[at : int(ends[last - 1])])
            begun[one] = True
    return [d.hexdigest() for d in digests]


def described(texts: pa.Array, doc_ids: list[int | None], order_of: Order | None = None) -> dict[str, list]:
    """The columns of ``COLUMNS`` for a few texts. ``order_of`` may name other words to stand in the places of a text."""
    words = words_in(*flat(texts), BLANKS)
    counts = np.bincount(words.text, minlength=len(doc_ids)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    which = np.arange(len(words.starts))
    for i, doc_id in enumerate(doc_ids):
        if order_of and counts[i]:
            own = order_of(doc_id, int(counts[i]))
            if own is not None:
                which[bounds[i] : bounds[i + 1]] = bounds[i] + own
    ids = numbered(words)[0][which] if len(which) else which
    start, length, period = runs_of(ids, bounds)
    kept = np.flatnonzero(kept_words(len(which), start, length, period))
    collapsed = joined_digests(words, which[kept], words.text[kept], len(doc_ids))
    out: dict[str, list] = {pair.split()[0]: [] for pair in COLUMNS.split(",")}
    edges = np.searchsorted(start, bounds)
    for i in range(len(doc_ids)):
        low, high = edges[i], edges[i + 1]
        s, n, q = start[low:high] - bounds[i], length[low:high], period[low:high]
        best = int(np.lexsort((q, s, -n))[0]) if len(s) else None
        chosen = (None,) * 3 if best is None else (int(s[best]), int(n[best]), int(q[best]))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()))
        exponent = None if best is None else 1000 * chosen[1] // chosen[2]
        row = (len(s), *chosen, exponent, hashlib.sha256(lines.encode()).hexdigest(), collapsed[i], int(counts[i]))
        for column, value in zip(out.values(), row):
            column.append(value)
    return out


def periodic_runs(docs: DataFrame, order_of: Order | None = None) -> DataFrame:
    """doc_id and ``COLUMNS``: the number of runs, the longest, and digests of all runs and of the text without repetitions."""
    kinds = [*[pa.int64()] * 5, *[pa.string()] * 2, pa.int64()]
    names = [pair.split()[0] for pair in COLUMNS.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BATCH_BYTES):
            doc_ids = batch.column("doc_id").cast(pa.int64())
            made = described(batch.column("text"), doc_ids.to_pylist(), order_of)
            columns = [pa.array(made[name], kind) for name, kind in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([doc_ids, *columns], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, {COLUMNS}")


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten, by its id: words from a place on that repeat with a period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), looped)
