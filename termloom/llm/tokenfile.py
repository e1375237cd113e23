"""Token ids in seekable zstandard files: independent frames, a document index and a trailing seek table.

A file is: zstandard frames, each with the ids of one or more whole documents as little-endian unsigned
32-bit integers; a skippable frame with the document index; a skippable frame with the seek table of
the public seekable format, which ends the file and has each frame's sizes and the low 32 bits of
the XXH64 of its content. Plain ``zstd -d`` yields all ids; a reader with the table decompresses only the frames
that hold the documents asked for, and checks each.

Files are written by Spark's own text writer, one row a file, so they go to any store that Spark can write and are
committed like any output: what a lost task left is never seen. That writer ends each row with a separator;
here the separator is the last byte of the seek table's magic number.

Documents lie in ascending ``doc_id`` order (null first) within and across files. Order and counts of
equal ids follow the texts' hashes and then arrival, so a hot id spreads over many tasks.

Cases: a null text is an empty text, with only the end id. Repeated rows are kept, each with its own place. Only ``doc_id`` and
``text`` are read. An empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm.common import parts, table
from termloom.llm.vocabulary import loose, pieces, slices
from termloom.llm.wordcut import gathered
from termloom.session import shared_folder

FRAME_BYTES = 1 << 18  # of ids; a frame ends with the document that reaches it
FILE_BYTES = 1 << 25  # compressed; a file ends with the frame that reaches it
# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
INDEX = 0x184D2A5D
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
END_BYTE = "\u008f"  # the last byte of a file, as the writer's separator in ISO-8859-1
END_ID = 0
KNOWN_BYTES = 48 << 20  # of parts and their ids that a worker remembers
SLICE_CHARS = 4_000_000
ENCODED_AT_ONCE = 20_000
TORN = "the file does not end with a seek table"


class FileMaker:
    """Collects documents into frames, and frames into the bytes of a file without its last byte."""

    def __init__(self, level: int = 3):
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[bytes] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, frame, ids
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(self.frames), len(ids) // 4))
        self.open.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            content = b"".join(self.open)
            frame = self.press.compress(content)
            self.frames.append(frame)
            self.table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def made(self, part: int, number: int) -> bytes:
        self.end_frame()
        ids = np.array([d or 0 for d, _, _ in self.docs], dtype="<i8")
        known = np.array([d is not None for d, _, _ in self.docs], dtype=np.uint8)
        frames = np.array([f for _, f, _ in self.docs], dtype="<u4")
        counts = np.array([n for _, _, n in self.docs], dtype="<u8")
        index = struct.pack("<QQQ", part, number, len(self.docs)) + b"".join(
            x.tobytes() for x in (ids, known, frames, counts)
        )
        index = zstandard.compress(index)
        # The index and the seek table are both skippable; the table lists only the frames with ids.
        seek = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        whole = b"".join(
            [
                *self.frames,
                struct.pack("<II", INDEX, len(index)) + index,
                struct.pack("<II", SKIPPABLE, len(seek)) + seek,
            ]
        )
        self.clear()
        return whole[:-1]


class OpenFile:
    """The bytes of a file, decompressed frame by frame on demand."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        frames, flags, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(TORN)
        seek_at = len(content) - 9 - 12 * frames
        self.table = np.frombuffer(self.content[seek_at:-9], dtype="<u4").reshape(frames, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self.content[at : at + 8])
        if magic != INDEX:
            raise ValueError(TORN)
        index = zstandard.decompress(self.content[at + 8 : at + 8 + length])
        self.part, self.number, n = struct.unpack("<QQQ", index[:24])
        at = 24
        columns = []
        for kind in ("<i8", "u1", "<u4", "<u8"):
            columns.append(np.frombuffer(index, dtype=kind, count=n, offset=at))
            at += n * columns[-1].itemsize
        self.ids, self.known, self.frame_of, self.counts = columns

    def frame(self, k: int) -> bytes:
        """The ids of a frame, checked against its checksum."""
        content = zstandard.decompress(self.content[self.starts[k] : self.starts[k + 1]])
        if len(content) != self.table[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return content

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids); only frames with wanted documents are decompressed."""
        before = np.concatenate([[0], np.cumsum(self.counts)])
        first = np.searchsorted(self.frame_of, np.arange(len(self.table)))
        held, content = -1, b""
        for i in range(len(self.ids)):
            doc = int(self.ids[i]) if self.known[i] else None
            if wanted is not None and doc not in wanted:
                continue
            k = int(self.frame_of[i])
            if k != held:
                held, content = k, self.frame(k)
            at = 4 * int(before[i] - before[first[k]])
            yield doc, int(before[i]), content[at : at + 4 * int(self.counts[i])]


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, with each different part of the texts encoded once.

    Known parts lie in one array of bytes and their ids in another, and all parts of a slice of texts are looked up at
    once. What is remembered is bounded in bytes: beyond them only the parts of the present slice stay.
    """

    def __init__(self, path: str, most_bytes: int = KNOWN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.ends = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def encoded(self, parts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in made]

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """A text with the wording of a special token is encoded as a whole, since that may span parts."""
        for some in slices(texts, SLICE_CHARS):
            made: list[bytes] = [b""] * len(some)
            plain, listed = [], []
            for i, text in enumerate(some):
                if any(s in text for s in self.special):
                    made[i] = self.encoded([text])[0]
                else:
                    (listed if loose(text) else plain).append(i)
            for group, cut in ((plain, blank_chunks), (listed, listed_pieces)):
                if group:
                    for i, ids in zip(group, self.joined(*cut([some[i] for i in group]))):
                        made[i] = ids
            yield from made

    def joined(self, parts: pa.Array, counts: np.ndarray) -> Iterator[bytes]:
        """The ids of each text, from its number of parts and the parts of all."""
        coded = parts.dictionary_encode()
        own = self.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.ends[own + 1] - self.ends[own]
        flat_ids = gathered(self.ids, self.ends[own], lengths)
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        for low, high in zip(edges, edges[1:]):
            yield flat_ids[low:high].tobytes()

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where each of the different parts is among the known ones; new ones become known."""
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes > self.most_bytes:
            self.forget()
        found = pc.index_in(parts, value_set=self.known)
        fresh = found.is_null()
        new = parts.filter(fresh)
        place = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            place[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            ids = []
            for low in range(0, len(new), ENCODED_AT_ONCE):
                ids += self.encoded(new.slice(low, ENCODED_AT_ONCE).cast(pa.large_string()).to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(one) // 4 for one in ids])])
        return place


def blank_chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts that are not ``loose``, and their number in each: blanks and line feeds begin a chunk, and line feeds end one."""
    coded = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    ends = np.cumsum([len(one) for one in coded])
    line = data == 0x0A
    begins = np.append(line | (data == 0x20), True)
    begins[1:] |= np.append(line[:-1], False) if len(line) else False
    begins[np.concatenate([[0], ends])] = True
    places = np.flatnonzero(begins)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]
    )
    return parts, np.diff(np.searchsorted(places, np.concatenate([[0], ends])))


def listed_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    cut = [pieces(text) for text in texts]
    parts = pa.array([p.encode("utf-8", "surrogatepass") for own in cut for p in own], pa.large_binary())
    return parts, np.array([len(own) for own in cut])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer."""
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Writes the ids of every document, each followed by the end id, into files under ``path``."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, number, part = FileMaker(), 0, TaskContext.get().partitionId()
        end = struct.pack("<I", END_ID)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([maker.made(part, number)], pa.binary())], names=["content"])

        for batch in parts(batches, 2048):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer_path).of(texts)):
                maker.add(doc_id, ids + end)
                if maker.bytes >= FILE_BYTES:
                    yield row()
                    number += 1
        if maker.docs:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.withColumns({"__hash": F.xxhash64("text"), "__at": F.monotonically_increasing_id()})
    order = ["doc_id", "__hash", "__at"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        rows.mapInArrow(files, "content binary")
        .select(F.col("content").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", END_BYTE)
        .text(path)
    )


def read_tokens(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """part, number, doc_id, before, ids (binary) of the wanted documents, or of all.

    ``before`` counts the ids ahead of the document in its file. The list of wanted ids is
    for look-ups: it goes to every task with the function.
    """
    asked = None if wanted is None else set(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in filter(None, batch.column("content").to_pylist()):
                opened = OpenFile(content)
                held: list[tuple] = []
                size = 0
                for doc, before, ids in opened.documents(asked):
                    held.append((opened.part, opened.number, doc, before, ids))
                    size += len(ids)
                    if size >= 1 << 24:
                        yield as_batch(held)
                        held, size = [], 0
                if held:
                    yield as_batch(held)

    def as_batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in held], kind) for i, kind in enumerate(kinds)],
            names=["part", "number", "doc_id", "before", "ids"],
        )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "part long, number long, doc_id long, before long, ids binary")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, number, file_start: how many ids lie before each file. Reads the indexes only, and orders one row a file."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = [OpenFile(content) for content in filter(None, batch.column("content").to_pylist())]
            rows = [(one.part, one.number, int(one.counts.sum())) for one in opened]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in rows], pa.int64()) for i in range(3)], names=["part", "number", "total"]
            )

    files = spark.read.format("binaryFile").load(path).select("content")
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.mapInArrow(totals, "part long, number long, total long").select(
        "part", "number", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("file_start")
    )


def placed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its ids as read back."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in filter(None, batch.column("content").to_pylist()):
                opened = OpenFile(content)
                rows = [(doc, before, len(ids) // 4, zlib.crc32(ids)) for doc, before, ids in opened.documents()]
                columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(4)]
                place = [pa.array([x] * len(rows), pa.int64()) for x in (opened.part, opened.number)]
                yield pa.RecordBatch.from_arrays(
                    [*place, *columns], names=["part", "number", "doc_id", "before", "n_tokens", "ids_crc32"]
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    own = files.mapInArrow(
        digests, "part long, number long, doc_id long, before long, n_tokens long, ids_crc32 long"
    )
    return own.join(file_starts(spark, path), ["part", "number"]).select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), default_tokenizer(), path)
    return placed(spark, path)
