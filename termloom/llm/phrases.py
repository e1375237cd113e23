"""Phrase collocations by stripes: each word keys an associative counter of what follows it.

A task cuts a block of texts into pieces and words and counts, for each language and word x of the block, how often x
occurs and how often it goes on with y, and with y z. That is the stripe of x: x itself and its continuations, with their counts. A
stripe is dealt by its next word into ``SHARES`` parts, so that no word, however frequent, has its counts in one place, and the parts go by
hash into buckets, whose number follows the size of the input. A row holds what a block has for a bucket. After the shuffle the parts of
all blocks are merged elementwise, a bucket at a time, in bounded steps. The merged stripes hold everything the score needs: the total of a
prefix (x, or x y), its extensions, and the largest extension, which decides whether a shorter phrase is subsumed. What a phrase
is subsumed by on its left comes from the stripe of another word, by a join of the few frequent continuations.

A phrase counted less than the least count cannot be a candidate or a part of one, so it goes once the counts are
merged, and never before. Scores are whole numbers made of decimals of 38 digits.

Cases: a null text is empty, a null language ``und``. Repeated rows count each time. Texts of any length are taken whole; a long one
may be cut between pieces on the way. Ties
follow the order by phrase in UTF-8 bytes; cuts with equal scores go to the shortest first part. An empty table gives no
rows. Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import small_batches, stored, table
from termloom.llm.wordcut import byte_set, flat, numbered, sliced, words_in

LEAST_COUNT = 10
SUBSUMED_PERCENT = 50
TOP = 2_000
MARKS = byte_set(".,;:!?", range(0x0A, 0x0E))
MARK_BYTES = [bytes([b]) for b in np.flatnonzero(MARKS)]
OUTSIDE = MARKS | byte_set("\x20\x09")
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 4 << 20  # of text whose counts meet in one bucket
MERGE_ENTRIES = 500_000  # are held before they are added up
SHARES = 64
RANK_SPREAD = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def cut_at_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same pieces in texts of about ``BLOCK_BYTES`` at most: no phrase goes over a mark, so a text may be cut after one."""
    for batch in batches:
        if (pc.max(pc.binary_length(batch.column("text"))).as_py() or 0) <= BLOCK_BYTES:
            yield batch
            continue
        langs, texts = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data, at = (text or "").encode(), 0
            while len(data) - at > BLOCK_BYTES:
                ends = [data.rfind(mark, at, at + BLOCK_BYTES) for mark in MARK_BYTES]
                end = max(ends)
                if end < 0:  # a piece longer than that stays whole
                    end = min((e for mark in MARK_BYTES if (e := data.find(mark, at)) >= 0), default=len(data))
                langs.append(lang)
                texts.append(data[at : end + 1].decode())
                at = end + 1
            langs.append(lang)
            texts.append(data[at:].decode())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], names=["lang", "text"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in order, in tables that end with the row that reaches ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for batch in sliced(cut_at_marks(batches), BLOCK_BYTES):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Counted:
    """The words of a block: a number for each (language, word), and whether the next word is in the same piece."""

    def __init__(self, block: pa.Table):
        data, offsets = flat(block.column("text").combine_chunks())
        data = LOWER[data]
        words = words_in(data, offsets, OUTSIDE)
        ids, self.vocabulary = numbered(words)
        langs = pc.fill_null(block.column("lang").combine_chunks(), "und").dictionary_encode()
        self.langs = langs.dictionary
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text]
        size = max(len(self.vocabulary), 1)
        keys, self.token, self.times = np.unique(lang * size + ids, return_inverse=True, return_counts=True)
        self.lang_of, self.word_of = keys // size, keys % size
        marks = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(MARKS[data], out=marks[1:])
        piece = marks[words.starts]
        self.joined = (words.text[1:] == words.text[:-1]) & (piece[1:] == piece[:-1])

    def pairs(self) -> tuple[np.ndarray, ...]:
        """first, second and count of the different pairs; pair, third and count of the different triples."""
        n, token, joined = max(len(self.times), 1), self.token, self.joined
        at = np.flatnonzero(joined)
        codes, number, count = np.unique(token[at] * n + token[at + 1], return_inverse=True, return_counts=True)
        of_place = np.full(len(joined), -1, dtype=np.int64)
        of_place[at] = number
        at = np.flatnonzero(joined[:-1] & joined[1:])
        triples, times = np.unique(of_place[at] * n + token[at + 2], return_counts=True)
        return codes // n, codes % n, count, triples // n, triples % n, times

    def stripes(self, buckets: int) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
        """language, bucket, phrases and counts; the empty phrase counts all words of a language."""
        x, y, xy_times, xy, z, xyz_times = self.pairs()
        word = lambda tokens: self.vocabulary.take(pa.array(self.word_of[tokens]))
        blank = pa.scalar(b" ", pa.large_binary())
        first = word(np.arange(len(self.times)))
        pair = pc.binary_join_element_wise(word(x), word(y), blank)
        phrases = pa.concat_arrays([first, pair, pc.binary_join_element_wise(pair.take(pa.array(xy)), word(z), blank)])
        counts = np.concatenate([self.times, xy_times, xyz_times])
        hashes = np.array([zlib.crc32(w) for w in self.vocabulary.to_pylist()], dtype=np.uint64)[self.word_of]
        share = hashes % np.uint64(SHARES) * SPREAD
        bucket = np.concatenate([hashes, hashes[x] + share[y], hashes[x[xy]] + share[y[xy]]]) % np.uint64(buckets)
        lang = np.concatenate([self.lang_of, self.lang_of[x], self.lang_of[x[xy]]])
        code = lang * buckets + bucket.astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, counts, phrases = code[order], counts[order], phrases.take(pa.array(order))
        edges = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)).tolist()
        names = self.langs.to_pylist()
        for low, high in zip(edges, edges[1:]):
            yield names[code[low] // buckets], int(code[low] % buckets), phrases.slice(low, high - low), counts[low:high]
        totals = np.bincount(self.lang_of, weights=self.times, minlength=len(names)).astype(np.int64)
        for name, total in zip(names, totals):
            yield name, 0, pa.array([b""], pa.large_binary()), np.array([total])


def packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    data, offsets = flat(phrases)
    lengths = np.diff(offsets).astype("<u4")
    whole = np.array([len(counts)], dtype="<u8").tobytes() + counts.astype("<i8").tobytes() + lengths.tobytes() + data.tobytes()
    return zstandard.compress(whole, 1)


def unpacked(content: bytes) -> tuple[pa.Array, np.ndarray]:
    whole = zstandard.decompress(content)
    n = int(np.frombuffer(whole, dtype="<u8", count=1)[0])
    counts = np.frombuffer(whole, dtype="<i8", count=n, offset=8)
    offsets = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.frombuffer(whole, dtype="<u4", count=n, offset=8 + 8 * n), out=offsets[1:])
    data = pa.py_buffer(whole).slice(8 + 12 * n)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), data]), counts


def added(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """The parts of some stripes as one, each phrase once."""
    coded = pa.concat_arrays([phrases for phrases, _ in parts]).dictionary_encode()
    order = coded.indices.to_numpy(zero_copy_only=False)
    total = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(total, order, np.concatenate([counts for _, counts in parts]))
    return coded.dictionary, total


def stripes(docs: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, stripes: what each block has for a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            held = [(lang, bucket, packed(phrases, counts)) for lang, bucket, phrases, counts in Counted(block).stripes(buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in held], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.binary()))],
                names=["lang", "bucket", "stripes"],
            )

    return docs.select("lang", "text").mapInArrow(rows, "lang string, bucket int, stripes binary")


def merged(parts: DataFrame, buckets: int, least: int = LEAST_COUNT) -> DataFrame:
    """lang, phrase, n: the stripes of all blocks added up, without what is rarer than ``least``.

    There are as many tasks as buckets, so that a task's part does not grow with the input.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def result() -> pa.RecordBatch:
            phrases, counts = added(held)
            frequent = (counts >= least) | (pc.binary_length(phrases).to_numpy(zero_copy_only=False) == 0)
            phrases = phrases.filter(pa.array(frequent)).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(phrases), pa.string()), phrases, pa.array(counts[frequent])],
                names=["lang", "phrase", "n"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column("lang")[i].as_py(), batch.column("bucket")[i].as_py()
                if now != key:
                    if held:
                        yield result()
                    key, held, size = now, [], 0
                one = unpacked(batch.column("stripes")[i].as_py())
                held.append(one)
                size += len(one[1])
                if size >= MERGE_ENTRIES and len(held) > 1:
                    held = [added(held)]
                    size = 0  # the next step again waits for so many new ones
        if held:
            yield result()

    together = parts.repartition(buckets, "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return together.mapInArrow(rows, "lang string, phrase string, n long")


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, percent: int = SUBSUMED_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a, l, r, score of every phrase of two or three words that no longer one subsumes; lang, n of all words."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    buckets = 1 + size // BUCKET_BYTES
    found = stored(merged(stripes(docs, buckets), buckets, least), "phrases")
    totals = found.filter(F.col("phrase") == "").select("lang", F.col("n"))
    words = F.split("phrase", " ", 2)
    counted = found.filter(F.col("phrase") != "").select(
        "lang", F.get(words, 0).alias("word"), F.get(words, 1).alias("following"), "phrase", F.col("n").alias("a")
    )
    longer = counted.filter(F.col("following").isNotNull())
    ahead = F.split("following", " ")
    next_word, last_word = F.get(ahead, 0), F.get(ahead, 1)
    cuts = longer.select(
        "lang",
        "phrase",
        "a",
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.lit(1).alias("k"), F.col("word").alias("left"), F.col("following").alias("right")),
                    F.when(
                        last_word.isNotNull(),
                        F.struct(F.lit(2).alias("k"), F.concat_ws(" ", F.col("word"), next_word).alias("left"), last_word.alias("right")),
                    ),
                )
            )
        ),
    )
    part = lambda side, name: counted.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = both.withColumn(
        "score",
        F.expr(
            "(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
        ),
    )
    best = exact.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("best")
    )
    # The largest count among the longer candidates that hold a phrase: those that it begins and those that it ends.
    held = longer.filter(last_word.isNotNull()).select(
        "lang",
        F.explode(F.array(F.concat_ws(" ", F.col("word"), next_word), F.col("following"))).alias("phrase"),
        "a",
    )
    largest = held.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    alone = best.join(largest, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("best.a"))
    )
    return alone.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score"), totals


def top_phrases(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, ranked from 1, with the number of all its words.

    A language is first ranked in ``RANK_SPREAD`` shares, so that one task orders no more than their heads.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SPREAD))).orderBy(*order)
    heads = phrases.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return heads.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= top).join(totals, "lang")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = top_phrases(*collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) lengths)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST_COUNT}),
s AS (SELECT lang, k, phrase, a, cut, string_split(phrase, ' ') AS ws FROM c, (SELECT unnest([1, 2]) AS cut) cuts WHERE cut < k),
o AS (SELECT s.lang, s.k, s.phrase, s.a, cut, l.a AS l, r.a AS r,
        ((1000000::HUGEINT * s.a * s.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM s JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(ws[:cut], ' ')
      JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, n.n, b.score FROM b JOIN n USING (lang)
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= {SUBSUMED_PERCENT} * b.a
        AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM q QUALIFY rank <= {TOP}
"""
