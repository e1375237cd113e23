"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Texts are summed per group of equal texts. A group with more than 1/1,024 of the corpus in some
dimension is a unit of its own; there are at most 3 x 1,024 of those. All others are dealt by
their hash into 8,192 bundles, the remaining units. So the placement works on a table of bounded size whatever the
corpus, which is the only thing that reaches the driver: units go, the largest first, to the shard where the dot
product of the unit with the shard's residual capacity (both as shares of the corpus, bytes weighing
fourfold) is highest.

A group that fits no shard, such as a third of the corpus, is cut into equal pieces of at most a quarter of a shard
by a hash of its rows; each piece is a unit. All other groups stay whole.

The law held is ``bytes``: sizes near equal. Cases: a null text has no bytes and no words and is a group of its own;
an empty table gives no rows. Repeated rows stay in their group and get slots of their own. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import stored, table, word_count

LARGE_SHARE = 1 / 1024
BUNDLES = 8192
PIECE_OF_SHARD = 1 / 4
DIMENSIONS = ["bytes", "tokens", "rows"]
EMPHASIS = np.array([4.0, 1.0, 1.0])  # of the dimensions in the dot product; the law asks for near equal bytes


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit. ``units``: shares of the corpus in each dimension, one row a unit."""
    residual = np.full((shards, units.shape[1]), 1.0 / shards)
    where = np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((np.arange(len(units)), -units.max(axis=1))):
        scores = residual @ (EMPHASIS * units[i])
        # Near ties: the shard with most room in its tightest dimension.
        best = np.flatnonzero(scores >= scores.max() - 1e-15)
        where[i] = best[np.argmax(residual[best].min(axis=1))]
        residual[where[i]] -= units[i]
    return where


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the group's key, and the three weights of each row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) + 1).cast("long").alias("bytes"),
        word_count(F.col("text")).alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.sha2(text, 256)).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )


def units_of(rows: DataFrame, shards: int) -> tuple[DataFrame, dict[str, int]]:
    """Rows with ``unit``: the key of a large group's piece, or the number of a bundle. And the pieces of each large group."""
    sums = [F.sum(d).alias(d) for d in DIMENSIONS]
    groups = rows.groupBy("group").agg(*sums)
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    whole = {d: max(total[d] or 0, 1) for d in DIMENSIONS}
    share = F.greatest(*[F.col(d) / whole[d] for d in DIMENSIONS])
    # At most 3 / LARGE_SHARE groups can hold so large a share.
    large = {r["group"]: r["share"] for r in groups.select("group", share.alias("share")).filter(share > LARGE_SHARE).collect()}
    piece = PIECE_OF_SHARD / shards
    pieces = {g: int(-(-s // piece)) if s > 1 / shards else 1 for g, s in large.items()}
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(BUNDLES)).cast("string"))
    if not pieces:
        return rows.withColumn("unit", bundle), pieces
    spark = rows.sparkSession
    table_of = spark.createDataFrame(list(pieces.items()), "group string, pieces int")
    own_piece = F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces"))
    joined = rows.join(F.broadcast(table_of), "group", "left")
    unit = F.when(F.col("pieces").isNull(), bundle).otherwise(F.concat("group", F.lit(":"), own_piece.cast("string")))
    return joined.withColumn("unit", unit).drop("pieces"), pieces


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot of each row.

    The rows, without their texts, are written to the shared folder once with their group and row number, so
    that all later steps see the same rows. Slots count a shard's rows in the order of the input's splits: each
    split's rows are numbered within the split, and the splits' counts, one row each, are summed up.
    """
    rows = stored(described(docs), "shard-rows")
    with_unit, _ = units_of(rows, shards)
    # At most BUNDLES + 3 / LARGE_SHARE + shards / PIECE_OF_SHARD x 3 rows.
    weights = with_unit.groupBy("unit").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).orderBy("unit").collect()
    matrix = np.array([[w[d] for d in DIMENSIONS] for w in weights], dtype=float).reshape(len(weights), len(DIMENSIONS))
    where = place(matrix / np.maximum(matrix.sum(axis=0), 1), shards)
    plan = docs.sparkSession.createDataFrame(
        [(w["unit"], int(s)) for w, s in zip(weights, where)], "unit string, shard int"
    )
    split = F.shiftright("row", 33)
    placed = (
        with_unit.join(F.broadcast(plan), "unit")
        .select("doc_id", F.col("bytes").alias("size"), "text_crc32", "group", "shard", "row", split.alias("split"))
    )
    counts = placed.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "split").orderBy("row"))
    return (
        placed.withColumn("place", within)
        .join(starts, ["shard", "split"])
        .select("doc_id", "size", "text_crc32", "group", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
    )


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
