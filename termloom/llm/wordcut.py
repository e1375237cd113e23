"""Words of many texts at a time, as places in the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_set(*parts: str | range) -> np.ndarray:
    """A table of 256 marks: true for the bytes named."""
    marks = np.zeros(256, dtype=bool)
    for part in parts:
        marks[[ord(c) for c in part] if isinstance(part, str) else list(part)] = True
    return marks


BLANKS = byte_set("\x20", range(0x09, 0x0E))


class Words(NamedTuple):
    """Where each word begins and ends in ``data``, and the number of its text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with the row that reaches ``most_bytes`` of text; no row is cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = min(int(np.searchsorted(ends, before + most_bytes)) + 1, batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts laid end to end, and where each text begins, with the end of the last; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_in(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> Words:
    """Maximal runs of bytes that are not ``outside``; none goes on from one text into the next."""
    inside = ~outside[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, side="right") - 1)


def numbered(words: Words) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the different words, and these."""
    lengths = words.ends - words.starts
    places = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=places[1:])
    content = gathered(words.data, words.starts, lengths)
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(content)]
    )
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The named stretches of the bytes, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.uint8)
    before = np.cumsum(lengths) - lengths
    return data[np.arange(total) + np.repeat(starts - before, lengths)]
