"""A log of changes over many batches: replayed, rolled back, or folded into one difference.

An entry is a row of a snapshot difference with the number and the time of its batch. Entries are counted, not
paired: a row that one batch brings and a later one takes away cancels out. So any run of batches costs one aggregation that is
linear in its entries, and no snapshot between them is needed.
"""

from __future__ import annotations

import os
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .clean import run_stamp
from .versions import paired_changes

NUMBER, TIME = "change_number", "changed_at"


def append_changes(diff: DataFrame, log: str, number: int, at: datetime | Column | None = None) -> None:
    """Writes a snapshot difference as batch ``number``; writing a batch again replaces it."""
    entries = diff.withColumn(TIME, run_stamp(at))
    entries.write.mode("overwrite").parquet(os.path.join(log, f"{NUMBER}={int(number)}"))


def read_changes(spark: SparkSession, log: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """The entries of the batches after one number and up to another; only their folders are read."""
    entries = spark.read.option("basePath", log).parquet(log).withColumn(NUMBER, F.col(NUMBER).cast("bigint"))
    if after is not None:
        entries = entries.filter(F.col(NUMBER) > after)
    return entries if upto is None else entries.filter(F.col(NUMBER) <= upto)


def _columns(log: DataFrame) -> list[str]:
    return log.schema["before"].dataType.fieldNames()


def _counted(log: DataFrame, come: int = 1) -> DataFrame:
    """The rows of all entries, each with how many more of it there are after them."""
    columns = _columns(log)
    sides = [
        log.filter(F.col(side).isNotNull()).select(
            *[F.col(f"{side}.{c}").alias(c) for c in columns], (F.col("copies") * sign).alias("_n")
        )
        for side, sign in (("before", -come), ("after", come))
    ]
    return reduce(DataFrame.unionByName, sides)


def _with(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    columns = [c for c in changes.columns if c != "_n"]
    total = (
        snapshot.select(*columns, F.lit(1).cast("bigint").alias("_n"))
        .unionByName(changes)
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .filter("_n > 0")
    )
    return total.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).drop("_copy")


def replayed(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """The snapshot after the batches of the log, given the one before them."""
    return _with(snapshot, _counted(log))


def rolled_back(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """The snapshot before the batches of the log, given the one after them."""
    return _with(snapshot, _counted(log, -1))


def folded(log: DataFrame, key: str) -> DataFrame:
    """All batches of the log as one difference: that of the snapshots before the first and after the last."""
    return paired_changes(_counted(log), _columns(log), key)
