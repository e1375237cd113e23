"""Suffix-array removal of repeated passages: every byte covered by a 200-byte string that also starts elsewhere.

A suffix array over all bytes would move each byte's suffix. Here only suffixes that can matter are sorted:

1. *Anchors.* Equal 200-byte strings have equal anchors at equal offsets (``anchors.py``), so the texts are cut into
   stretches of string starts with one anchor. A question "who else has this anchor, and this very stretch?" goes to
   the partition of its hash, once from each block of texts, and is answered in bits. Stretches whose anchor occurs once hold no
   repeated string; those whose whole content occurs twice are repeated throughout. Only different
   stretches around one anchor are left *open*.
2. *Suffixes.* Of each open stretch the suffix from its anchor on, followed by the reversed prefix before it, and the same the other way
   round, are sorted over the whole corpus: each task sorts a run, cuts it at common splitters and sends it front-coded; loser trees
   merge the runs of a range without comparing known prefixes again (``merging.py``).
3. *Decision.* A neighbour in the merged order that shares r bytes from the anchor on and l bytes before it repeats every string of
   the stretch that begins at most l bytes before the anchor and ends at most r bytes after it: these are removed. Since no other suffix shares more than
   a neighbour does, strings that reach further than that to one side occur once. The first and last suffixes of a
   range count as sharing all their bytes, so no range need know its neighbours. What is left lies between the
   two: strings whose right side agrees with one text and whose left side with another. Only around anchors with such strings are the strings
   told apart by two 64-bit hashes of their content, asked and answered as in 1.

Questions and answers travel in packed arrays, one for each block and partition; equal questions of a block travel
once, so a passage in a third of all texts sends no more than one question from each block. Every step handles a
bounded block or one range of hashes, and nothing is collected on the driver but 4,096 sampled splitter candidates.
Hashes are 128 bits together.

Cases: a null text is an empty text; texts under 200 bytes lose nothing; repeated rows repeat each other. Rows are told apart by
their place in the stored blocks, so null and equal ids do no harm. Only ``doc_id`` and ``text`` are read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.anchors import BASE, GRAM, LENGTH, MOST_BYTES, mixed, powers, stretches
from termloom.llm.common import parts, small_batches, stored, table
from termloom.llm.merging import front_coded, merged, shared

BLOCK_BYTES = 1 << 20  # of text; a block ends with the text that reaches it
ANCHOR, STRETCH, STRING = 0, 1, 2  # kinds of questions
TWICE, VARIED, CHOSEN = 1, 2, 4  # bits of an answer
SPLITTERS = 4096  # sampled strings for the splitters, at most
SAMPLE_OF_BLOCK = 16

Batches = Iterator[pa.RecordBatch]


def rows_of(batches: Batches) -> Iterator[dict]:
    """One row at a time: the rows hold whole blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [field.split() for field in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)],
        names=[name for name, _ in fields],
    )


BLOCKS = "block long, ids binary, known binary, lengths binary, texts binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """The texts in compressed blocks of a few MB, each with a number of its own; stored, so that all steps see the same blocks."""

    def pack(batches: Batches) -> Batches:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            made = (
                (part << 32) + number,
                np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
                np.array([i is not None for i in ids], dtype=np.uint8).tobytes(),
                np.array([len(t) for t in texts], dtype="<i8").tobytes(),
                zstandard.compress(b"".join(texts), 3),
            )
            return batch_of(BLOCKS, [made])

        for batch in parts(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, BLOCKS)
    return stored(packed, "repeats-blocks")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block and where each text ends."""
    lengths = np.frombuffer(row["lengths"], dtype="<i8")
    return np.frombuffer(zstandard.decompress(row["texts"]), dtype=np.uint8), np.cumsum(lengths)


def all_stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of a block of any size, by slices; a string that crosses slices is in exactly one of them."""
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(data):
        stop = min(len(data), at + MOST_BYTES)
        own = np.append(ends[(ends > at) & (ends < stop)], stop)
        first, *rest = stretches(data[at:stop], own - at)
        found.append((first + at, *rest))
        # The next slice begins early enough for the strings that this one cut off.
        at = stop if stop == len(data) or stop in ends else stop - LENGTH + 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else stretches(data, ends)


ASK = "owner long, dest int, kind int, keys binary"
ANSWER = "owner long, dest int, kind int, bits binary"


def asked(owner: int, kind: int, a: np.ndarray, b: np.ndarray, dests: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Questions about the pairs (a, b): rows, and for each pair its place among the answers in order of (dest, place).

    Pairs are sent once each, with the mark whether the owner has it several times. For anchors only the first b
    of each a is sent, with the mark whether there are several b.
    """
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new_a = np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, dtype=bool)
    new = new_a if kind == ANCHOR else new_a | np.append(True, y[1:] != y[:-1])[: len(x)]
    group = np.cumsum(new) - 1
    counts = np.bincount(group, minlength=int(new.sum()))
    first = np.flatnonzero(new)
    marks = np.where(counts > 1, TWICE, 0).astype(np.uint8)
    if kind == ANCHOR and len(x):
        marks |= np.where(np.maximum.reduceat(y, first) != np.minimum.reduceat(y, first), VARIED, 0).astype(np.uint8)
    keys_a, keys_b = x[first], y[first]
    dest = (mixed(keys_a ^ mixed(keys_b)) if kind != ANCHOR else mixed(keys_a)) % np.uint64(dests)
    by_dest = np.argsort(dest, kind="stable")
    rows = []
    cuts = np.searchsorted(dest[by_dest], np.arange(dests + 1, dtype=np.uint64))
    for d in np.flatnonzero(np.diff(cuts)):
        some = by_dest[cuts[d] : cuts[d + 1]]
        packed = keys_a[some].tobytes() + keys_b[some].tobytes() + marks[some].tobytes()
        rows.append((owner, int(d), kind, packed))
    place = np.empty(len(first), dtype=np.int64)
    place[by_dest] = np.arange(len(first))
    where = np.empty(len(a), dtype=np.int64)
    where[order] = place[group]
    return rows, where, counts


def answered(asks: DataFrame, partitions: int) -> DataFrame:
    """owner, replies: for each owner its answers, as (kind, dest, bits).

    TWICE: the pair (for anchors: a) occurs more than once. VARIED: the anchor has several b. CHOSEN: of all owners
    that ask, this one is to stand for the pair.
    """

    def reply(batches: Batches) -> Batches:
        heads: list[tuple[int, int, int, int]] = []
        parts: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for row in rows_of([batch]):
                n = len(row["keys"]) // 17
                heads.append((row["owner"], row["dest"], row["kind"], n))
                parts[0].append(np.frombuffer(row["keys"], dtype="<u8", count=n))
                parts[1].append(np.frombuffer(row["keys"], dtype="<u8", count=n, offset=8 * n))
                parts[2].append(np.frombuffer(row["keys"], dtype=np.uint8, count=n, offset=16 * n))
        if not heads:
            return
        a, b, marks = (np.concatenate(p) for p in parts)
        kinds = np.repeat(np.array([h[2] for h in heads], dtype=np.uint8), [h[3] for h in heads])
        bits = np.zeros(len(a), dtype=np.uint8)
        for kind in np.unique(kinds):
            own = np.flatnonzero(kinds == kind)
            order = own[np.lexsort((b[own], a[own]))]
            x, y = a[order], b[order]
            new = np.append(True, x[1:] != x[:-1])
            if kind != ANCHOR:
                new |= np.append(True, y[1:] != y[:-1])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            twice = (np.bincount(group) > 1) | (np.bitwise_or.reduceat(marks[order], first) & TWICE > 0)
            own_bits = np.where(twice, TWICE, 0).astype(np.uint8)[group]
            if kind == ANCHOR:
                varied = np.maximum.reduceat(y, first) != np.minimum.reduceat(y, first)
                varied |= np.bitwise_or.reduceat(marks[order], first) & VARIED > 0
                own_bits |= np.where(varied, VARIED, 0).astype(np.uint8)[group]
            else:
                own_bits[first] |= CHOSEN
            bits[order] = own_bits
        ends = np.cumsum([n for *_, n in heads])
        for low in range(0, len(heads), 1000):
            some = zip(heads[low : low + 1000], ends[low : low + 1000])
            yield batch_of(ANSWER, [(o, d, k, bits[end - n : end].tobytes()) for (o, d, k, n), end in some])

    answers = asks.repartition(partitions, "dest").mapInArrow(reply, ANSWER)
    return answers.groupBy("owner").agg(F.collect_list(F.struct("kind", "dest", "bits")).alias("replies"))


def reply_bits(replies: list[dict] | None, kind: int) -> np.ndarray:
    own = sorted((r for r in replies or [] if r["kind"] == kind), key=lambda r: r["dest"])
    return np.frombuffer(b"".join(r["bits"] for r in own), dtype=np.uint8)


def covered(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal runs out of half-open spans; spans that touch are one run."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, a[1:] > b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:] - 1, len(a) - 1)]


OPEN = "block long, spans binary, starts binary, counts binary, offsets binary, content binary"


def open_stretches(blocks: DataFrame, replies: DataFrame, dests: int) -> DataFrame:
    """Of each block: spans repeated throughout, and the open stretches with their bytes."""

    def split(batches: Batches) -> Batches:
        for row in rows_of(batches):
            data, ends = opened(row)
            first, count, gram, content, offset = all_stretches(data, ends)
            _, at_anchor, _ = asked(0, ANCHOR, gram, content, dests)
            _, at_stretch, _ = asked(0, STRETCH, gram, content, dests)
            anchor = reply_bits(row["replies"], ANCHOR)[at_anchor] if len(first) else np.zeros(0, dtype=np.uint8)
            stretch = reply_bits(row["replies"], STRETCH)[at_stretch] if len(first) else np.zeros(0, dtype=np.uint8)
            twice = stretch & TWICE > 0
            # One of equal stretches stands for all, and within the block the first of them.
            _, once = np.unique(at_stretch, return_index=True)
            stands = np.zeros(len(first), dtype=bool)
            stands[once] = True
            stands &= stretch & CHOSEN > 0
            use = np.flatnonzero((anchor & VARIED > 0) & (~twice | stands))
            stop = first + count + LENGTH - 1
            a, b = covered(first[twice], stop[twice])
            # A stretch that is only looked at for others' sake has its own strings decided already.
            content_bytes = b"".join(data[s:e].tobytes() for s, e in zip(first[use], stop[use]))
            made = (
                row["block"],
                np.stack([a, b]).astype("<i8").tobytes(),
                first[use].astype("<i8").tobytes(),
                count[use].astype("<i8").tobytes(),
                offset[use].astype("<i8").tobytes(),
                zstandard.compress(content_bytes, 1),
            )
            yield batch_of(OPEN, [made])

    joined = blocks.join(replies, blocks["block"] == replies["owner"], "left").select("block", "lengths", "texts", "replies")
    return stored(joined.mapInArrow(split, OPEN), "repeats-open")


def stretch_list(row: dict) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, count, offset of the anchor, bytes) of the open stretches of a row."""
    starts, counts, offsets = (np.frombuffer(row[c], dtype="<i8").tolist() for c in ("starts", "counts", "offsets"))
    content = zstandard.decompress(row["content"])
    at = 0
    for start, count, offset in zip(starts, counts, offsets):
        yield start, count, offset, content[at : at + count + LENGTH - 1]
        at += count + LENGTH - 1


END = b"\x00"


def ordered(first: bytes, second: bytes, mark: bytes) -> bytes:
    """A string that sorts by its first part, a shorter one before those it begins, and then by the second."""
    if END in first or b"\x01" in first:
        first = first.replace(b"\x01", b"\x01\x02").replace(END, b"\x01\x01")
    return mark + first + END + second


def parted(string: bytes) -> tuple[bytes, bytes]:
    first, second = string[1:].split(END, 1)
    if b"\x01" in first:
        first = first.replace(b"\x01\x01", END).replace(b"\x01\x02", b"\x01")
    return first, second


def sides(content: bytes, offset: int) -> tuple[bytes, bytes]:
    """The suffix from the anchor on with the reversed prefix before it, and the other way round; a first byte tells which."""
    right, left = content[offset:], content[:offset][::-1]
    return ordered(right, left, b"R"), ordered(left, right, b"L")


def splitters(opens: DataFrame, ranges: int) -> list[bytes]:
    """Strings that cut the sorted order into about equal ranges, from a sample of bounded size."""

    def some(batches: Batches) -> Batches:
        for row in rows_of(batches):
            own = list(stretch_list(row))
            step = max(1, len(own) // SAMPLE_OF_BLOCK)
            picked = [side for _, _, offset, content in own[::step] for side in sides(content, offset)]
            yield batch_of("s binary", [(side,) for side in picked])

    sample = opens.select("starts", "counts", "offsets", "content").mapInArrow(some, "s binary")
    bounded = stored(sample.orderBy(F.xxhash64("s"), "s").limit(SPLITTERS), "repeats-sample")
    picked = sorted(r["s"] for r in bounded.collect())
    return sorted({bytes(picked[len(picked) * i // ranges]) for i in range(1, ranges)}) if picked else []


SHARED = "common int, first array<int>, second array<int>"


def neighbours(opens: DataFrame, cuts: list[bytes], partitions: int) -> DataFrame:
    """Of each different string of ``sides`` what it shares with its neighbours in the sorted order.

    key; common: the most bytes that its first part shares with that of another string, or all, if that is not known;
    first, second: how many bytes of either part one neighbour shares, and the other.
    """

    def runs(batches: Batches) -> Batches:
        seen: dict[bytes, bool] = {}
        for row in rows_of(batches):
            for _, _, offset, content in stretch_list(row):
                for side in sides(content, offset):
                    seen[side] = side in seen
        strings = sorted(seen)
        bounds = [0, *np.searchsorted(np.array(strings, dtype=object), np.array(cuts, dtype=object)).tolist(), len(strings)] if cuts and strings else [0, len(strings)]
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if low < high:
                own = strings[low:high]
                yield batch_of("range int, run binary", [(k, front_coded(own, [seen[s] for s in own]))])

    def merge(batches: Batches) -> Batches:
        held: dict[int, list[bytes]] = {}
        for row in rows_of(batches):
            held.setdefault(row["range"], []).append(row["run"])
        for own in held.values():
            out: list[tuple] = []
            last, met, at_edge = None, [], True

            def done(edge: bool) -> tuple:
                whole = len(last[1][0]) if edge else max([f for f, _ in met], default=0)
                return xxhash.xxh3_128_digest(last[0]), whole, [f for f, _ in met], [s for _, s in met]

            for string, common, repeated in merged(own):
                if last is not None and common == len(last[0]) == len(string):
                    met.append((len(last[1][0]), len(last[1][1])))
                    continue
                now = (string, parted(string))
                shares = None
                if last is not None:
                    (f, s), (g, t) = last[1], now[1]
                    # Where the first parts hold no escaped byte, their order's common prefix is their own.
                    plain = len(string) == len(g) + len(t) + 2 and len(last[0]) == len(f) + len(s) + 2
                    # Not even the mark is shared where the two orders meet.
                    shares = (min(common - 1, len(f), len(g)) if plain else shared(f, g), shared(s, t)) if common else (0, 0)
                    met.append(shares)
                    out.append(done(at_edge))
                    at_edge = False
                last, met = now, [shares] if shares else []
                if repeated:
                    met.append((len(now[1][0]), len(now[1][1])))
                if len(out) >= 50_000:
                    yield batch_of(f"key binary, {SHARED}", out)
                    out = []
            out.append(done(True))
            yield batch_of(f"key binary, {SHARED}", out)

    sorted_runs = opens.select("starts", "counts", "offsets", "content").mapInArrow(runs, "range int, run binary")
    return sorted_runs.repartition(partitions, "range").mapInArrow(merge, f"key binary, {SHARED}")


def with_neighbours(opens: DataFrame, found: DataFrame) -> DataFrame:
    """The open rows with ``shared``: for each of their strings in order, right and left in turn, what ``neighbours`` found."""

    def keys(batches: Batches) -> Batches:
        for row in rows_of(batches):
            made = [
                (row["block"], 2 * i + k, xxhash.xxh3_128_digest(side))
                for i, (_, _, offset, content) in enumerate(stretch_list(row))
                for k, side in enumerate(sides(content, offset))
            ]
            yield batch_of("owner long, place int, key binary", made)

    wanted = opens.select("block", "starts", "counts", "offsets", "content").mapInArrow(
        keys, "owner long, place int, key binary"
    )
    per_block = (
        wanted.join(found, "key")
        .groupBy("owner")
        .agg(F.sort_array(F.collect_list(F.struct("place", "common", "first", "second"))).alias("shared"))
    )
    joined = opens.join(per_block, opens["block"] == per_block["owner"]).drop("owner")
    return stored(joined, "repeats-common")


def judged(row: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Starts of the strings that a neighbour repeats; of each stretch its anchor's hash, the bounds of the strings
    that may occur elsewhere (as bytes before the anchor), and 1 if some of these are not yet known to."""
    decided, anchors, bounds, unsure = [np.zeros(0, dtype=np.int64)], [], [], []
    both = row["shared"]
    for i, (start, count, offset, content) in enumerate(stretch_list(row)):
        on_right, on_left = both[2 * i], both[2 * i + 1]
        # Of a string that starts o bytes before the anchor, o and LENGTH - o bytes are compared.
        low, high = max(offset - count + 1, LENGTH - on_right["common"], 0), min(offset, on_left["common"])
        repeated = np.zeros(max(high - low + 1, 0), dtype=bool)  # by o - low
        for right, left in [*zip(on_right["first"], on_right["second"]), *zip(on_left["second"], on_left["first"])]:
            repeated[max(LENGTH - right - low, 0) : max(min(left, high) - low + 1, 0)] = True
        decided.append(start + offset - low - np.flatnonzero(repeated))
        anchors.append(xxhash.xxh3_64_intdigest(content[offset : offset + GRAM]))
        bounds.append((low, high))
        unsure.append(int(not repeated.all()))
    return np.concatenate(decided), np.array(anchors, dtype=np.uint64), bounds, np.array(unsure, dtype=np.uint64)


def string_keys(row: dict, dests: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of strings that a neighbour repeats; start and two hashes of the strings still to be compared.

    A string that no neighbour decides may equal one that its own neighbours decide, so all stretches of an anchor
    take part once one of them, in any text, has a string left.
    """
    sure, anchors, bounds, unsure = judged(row)
    _, where, _ = asked(0, ANCHOR, anchors, unsure, dests)
    mixed_anchor = reply_bits(row["open"], ANCHOR)[where] & VARIED > 0 if len(anchors) else np.zeros(0, dtype=bool)
    starts, hashes = [], ([], [])
    up, down = powers(4096)
    for (start, _, offset, content), (low, high), takes_part in zip(stretch_list(row), bounds, mixed_anchor | (unsure > 0)):
        if not takes_part or low > high:
            continue
        data = np.frombuffer(content, dtype=np.uint8)
        first = np.arange(offset - high, offset - low + 1)
        starts.append(first + start)
        for k, salted in enumerate((data.astype(np.uint64) * BASE + np.uint64(17), mixed(data.astype(np.uint64) + np.uint64(99)))):
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(salted * up[: len(data)], out=total[1:])
            hashes[k].append(mixed((total[first + LENGTH] - total[first]) * down[first]))
    if not starts:
        empty = np.zeros(0, dtype=np.uint64)
        return sure, np.zeros(0, dtype=np.int64), empty, empty
    return sure, np.concatenate(starts), np.concatenate(hashes[0]), np.concatenate(hashes[1])


def asking(frame: DataFrame, questions: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    def ask(batches: Batches) -> Batches:
        for row in rows_of(batches):
            yield batch_of(ASK, list(questions(row)))

    return frame.mapInArrow(ask, ASK)


REMOVED = "block long, spans binary"


def repeated_spans(blocks: DataFrame) -> DataFrame:
    """block, spans: the maximal runs of bytes to be removed, as positions within the block."""
    spark = blocks.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dests = 4 * partitions

    def about_stretches(row: dict) -> Iterator[tuple]:
        data, ends = opened(row)
        _, _, gram, content, _ = all_stretches(data, ends)
        for kind in (ANCHOR, STRETCH):
            yield from asked(row["block"], kind, gram, content, dests)[0]

    replies = answered(asking(blocks.select("block", "lengths", "texts"), about_stretches), partitions)
    opens = open_stretches(blocks, replies, dests)
    cuts = splitters(opens, dests)
    ready = with_neighbours(opens.filter(F.length("starts") > 0), neighbours(opens, cuts, partitions))

    def about_anchors(row: dict) -> Iterator[tuple]:
        _, anchors, _, unsure = judged(row)
        return iter(asked(row["block"], ANCHOR, anchors, unsure, dests)[0])

    anchor_replies = answered(asking(ready, about_anchors), partitions).select(
        F.col("owner").alias("of"), F.col("replies").alias("open")
    )
    known = ready.join(anchor_replies, ready["block"] == anchor_replies["of"], "left").drop("of")

    def about_strings(row: dict) -> Iterator[tuple]:
        _, _, x, y = string_keys(row, dests)
        return iter(asked(row["block"], STRING, x, y, dests)[0])

    string_replies = answered(asking(known, about_strings), partitions)

    def decide(batches: Batches) -> Batches:
        for row in rows_of(batches):
            sure, starts, x, y = string_keys(row, dests)
            _, where, _ = asked(0, STRING, x, y, dests)
            if len(starts):
                starts = starts[reply_bits(row["replies"], STRING)[where] & TWICE > 0]
            starts = np.concatenate([sure, starts])
            spans = np.stack(covered(starts, starts + LENGTH)).astype("<i8")
            yield batch_of(REMOVED, [(row["block"], spans.tobytes())])

    decided = known.join(string_replies, known["block"] == string_replies["owner"], "left").drop("owner")
    fine = decided.mapInArrow(decide, REMOVED)
    return opens.select("block", "spans").unionByName(fine).groupBy("block").agg(F.collect_list("spans").alias("spans"))


def applied(docs: DataFrame, finish: Callable[[bytes, list[tuple[int, int]]], tuple], columns: str) -> DataFrame:
    """``doc_id`` and what ``finish`` makes of each text's bytes and its removed runs."""
    blocks = blocks_of(docs)
    spans = repeated_spans(blocks)

    def rows(batches: Batches) -> Batches:
        for row in rows_of(batches):
            data, ends = opened(row)
            whole = data.tobytes()
            pairs = [np.frombuffer(s, dtype="<i8").reshape(2, -1) for s in row["spans"] or []]
            both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
            a, b = covered(both[0], both[1])
            begins = np.append(0, ends[:-1]).astype(np.int64)
            # Runs that touch across the border of two texts are cut there again.
            inner = begins[1:]
            cut = inner[(np.searchsorted(a, inner, side="left") - np.searchsorted(b, inner, side="right")) > 0]
            a, b = np.sort(np.append(a, cut)), np.sort(np.append(b, cut))
            low, high = np.searchsorted(a, begins, side="left"), np.searchsorted(a, ends, side="left")
            ids = np.frombuffer(row["ids"], dtype="<i8").tolist()
            known = np.frombuffer(row["known"], dtype=np.uint8).tolist()
            made = []
            for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
                own = [(s - begin, e - begin) for s, e in zip(a[low[i] : high[i]].tolist(), b[low[i] : high[i]].tolist())]
                made.append((ids[i] if known[i] else None, *finish(whole[begin:end], own if end > begin else [])))
            yield batch_of(f"doc_id long, {columns}", made)

    joined = blocks.join(spans.withColumnRenamed("block", "b"), F.col("block") == F.col("b"), "left").drop("b")
    return joined.mapInArrow(rows, f"doc_id long, {columns}")


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, stop in runs:
        parts.append(text[at:start])
        at = stop
    return b"".join([*parts, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and kept: what is left of each text, as bytes (a cut may fall inside a character)."""
    return applied(docs, lambda text, runs: (kept_bytes(text, runs),), "kept binary")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    def finish(text: bytes, runs: list[tuple[int, int]]) -> tuple:
        removed = sum(b - a for a, b in runs)
        return len(text), removed, len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest()

    columns = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return applied(table(spark, sf_dir, "documents"), finish, columns)
