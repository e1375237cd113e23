"""Exact top-k search by histogram selection.

All scores are whole numbers. Queries come in blocks of at most ``BLOCK`` rows, which go to every task; for each block the
candidates are scored by matrix products, again in each round:

1. The range of the scores is known from the largest components. A round splits each query's open range into
   ``BINS`` bins and adds up, over all partitions, how many scores fall into each. The bin with the k-th
   largest score becomes the open range of the next round, until it is one value wide: the k-th score is found.
   A partition reports only bins that can still matter: none below its own k-th score, since k scores of its own already lie above.
2. A last round keeps scores above the k-th, of which there are less than k, and of those equal to it the smallest ids
   that a partition has, at most k. The final choice orders at most k + k x partitions rows a query.

So no partition and no task ever holds more than its block of scores, however many scores tie.

Cases: vectors that are null, or hold null or non-finite components, and rows without id take no part. Rows are told
apart by their id: a query does not meet rows of its own id (of several vectors with a query's id the least asks), other
repeated rows count each. Vectors of unequal length
do not meet. An empty vector scores 0 with the others of its kind. Fewer than k candidates: all of them. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import stored, table
from termloom.session import shared_folder

K = 5
SCALE = 256
EVERY = 50
BLOCK = 2048  # queries held by a task at once
TILE = 4096  # candidates scored at once
BINS = 256
EXACT = 1 << 53  # whole numbers that doubles hold exactly


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the whole-number vectors, floor(scale x component)."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(as_double, lambda x: F.floor(x * SCALE).cast("long")).alias("v"),
    )


class Block:
    """Queries of one block, as matrices by vector length."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.ids = np.array(ids, dtype=np.int64)
        lengths = np.array([len(v) for v in vectors])
        self.parts = {
            int(n): (own := np.flatnonzero(lengths == n), np.array([vectors[i] for i in own], dtype=np.int64).reshape(len(own), n))
            for n in np.unique(lengths)
        }

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries' places, candidates' ids, scores) by tiles; a query's own rows score below all others (masked)."""
        for batch in batches:
            lists = batch.column("v")
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values)
            ids = np.asarray(batch.column("vec_id"))
            lengths = np.diff(offsets)
            for n, (places, queries) in self.parts.items():
                rows = np.flatnonzero(lengths == n)
                for at in range(0, len(rows), TILE):
                    some = rows[at : at + TILE]
                    own = values[offsets[some][:, None] + np.arange(n)] if n else np.zeros((len(some), 0), dtype=np.int64)
                    bound = float(np.abs(own).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(n, 1)
                    if bound < EXACT:
                        scores = (queries.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
                    else:
                        scores = queries @ own.T
                    yield places, ids[some], scores


def per_row_top(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, in no order."""
    return scores if scores.shape[1] <= k else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


NONE = np.iinfo(np.int64).min


def histograms(rows: DataFrame, block: Block, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """query, bin, n: how many scores fall into each bin of [low, low + BINS x width), for a query's k highest bins with any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(block.ids), BINS + 1), dtype=np.int64)
        best = np.full((len(block.ids), k), NONE)
        for places, ids, scores in block.scored(batches):
            other = block.ids[places][:, None] != ids[None, :]
            kept = np.where(other, scores, NONE)
            best[places] = per_row_top(np.concatenate([best[places], kept], axis=1), k)
            bins = np.minimum((scores - low[places][:, None]) // width[places][:, None], BINS)
            hit = other & (bins >= 0)
            flat = np.broadcast_to(places[:, None], bins.shape)[hit] * (BINS + 1) + bins[hit]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        kth = best.min(axis=1)
        floor = np.where(kth == NONE, 0, np.clip((kth - low) // width, 0, BINS))
        counts[np.arange(BINS + 1)[None, :] < floor[:, None]] = 0
        query, which = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(which, pa.int64()), pa.array(counts[query, which], pa.int64())],
            names=["query", "bin", "n"],
        )

    # The bin of the k-th score is among the k highest that hold any score.
    counted = rows.mapInArrow(count, "query long, bin long, n long").filter(F.col("bin") < BINS)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bin").desc()))
    totals = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    return totals.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def kth_scores(rows: DataFrame, block: Block, low: int, high: int, k: int) -> np.ndarray:
    """The k-th largest score of each query of the block (the lowest possible score, if it has fewer)."""
    n = len(block.ids)
    width = 1
    while width * BINS < high - low + 1:
        width *= BINS  # powers of BINS, so that the bins of a round fill one bin of the round before exactly
    lows, widths = np.full(n, low), np.full(n, width)
    missing = np.full(n, k)  # how many of the k are still to be found at or below the open range
    while True:
        table_of = np.zeros((n, BINS + 1), dtype=np.int64)
        for row in histograms(rows, block, lows, widths, k).collect():  # at most k rows for each query of the block
            table_of[row["query"], row["bin"]] = row["n"]
        from_top = np.cumsum(table_of[:, BINS - 1 :: -1], axis=1)
        reached = from_top >= missing[:, None]
        place = np.where(reached.any(axis=1), BINS - 1 - reached.argmax(axis=1), 0)
        above = np.where(place < BINS - 1, from_top[np.arange(n), np.maximum(BINS - 2 - place, 0)], 0)
        missing = missing - above
        lows = lows + place * widths
        if (widths == 1).all():
            return lows
        widths = widths // BINS


def finalists(rows: DataFrame, block: Block, kth: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: scores above the k-th, and the smallest ids of a partition among those equal to it."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, list[int]] = {}
        found: list[tuple[int, int, int]] = []
        for places, ids, scores in block.scored(batches):
            other = block.ids[places][:, None] != ids[None, :]
            for q, c in zip(*np.nonzero(other & (scores > kth[places][:, None]))):
                found.append((int(block.ids[places[q]]), int(ids[c]), int(scores[q, c])))
            equal = other & (scores == kth[places][:, None])
            for q in np.flatnonzero(equal.any(axis=1)):
                own = ids[equal[q]]
                own = np.partition(own, k - 1)[:k] if len(own) > k else own
                ties[int(places[q])] = sorted([*ties.get(int(places[q]), []), *own.tolist()])[:k]
        found += [(int(block.ids[q]), c, int(kth[q])) for q, own in ties.items() for c in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"]
        )

    return rows.mapInArrow(pick, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    ``is_query`` is a condition on ``vec_id``. The vectors are written once as whole numbers; each block then reads them
    as often as its ranges need narrowing (three times for scores below 2^24) and once more.
    """
    rows = stored(usable(vectors), "topk-vectors")
    spark = vectors.sparkSession
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Blocks by ranges of ids: the ids' order is cut into runs of at most BLOCK.
    numbered = queries.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    packed = stored(numbered, "topk-queries")
    largest = rows.select(
        F.max(F.size("v")).alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    ).first()
    high = int(largest["n"] or 0) * int(largest["most"] or 0) ** 2
    schema, folder = "query_id long, vec_id long, score long", shared_folder(spark, "topk-finalists")
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in blocks(packed):  # all blocks' finalists go to one folder, so that the plan does not grow with them
        kth = kth_scores(rows, block, -high, high, k)
        finalists(rows, block, kth, k).write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks(queries: DataFrame) -> Iterator[Block]:
    """The queries in blocks; the driver holds one partition of them and one block at a time."""
    ids: list[int] = []
    vectors: list[list[int]] = []
    for row in queries.toLocalIterator():
        ids.append(row["vec_id"])
        vectors.append(row["v"])
        if len(ids) == BLOCK:
            yield Block(ids, vectors)
            ids, vectors = [], []
    if ids:
        yield Block(ids, vectors)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP5_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
