"""Left joins that hold up when a key carries a large share of the rows.

Two shapes occur in the dictionary jobs:

* the right side has one row per key (pre-aggregated, or de-duplicated):
  ``join_unique``. Spark's own skew handling may split a hot left key here,
  because a left join lets it cut the left side. Null keys, which never match,
  are spread so that they do not all land in one task.
* the right side has many rows per key: ``join_fanout``. In a left join Spark
  cannot cut the right side, so hot keys are salted on both sides. In an inner
  join Spark can cut both, but only past its run-time thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content_spread
from ..session import stored

HOT_ROWS = 2_000_000  # rows of one key that one task may hold
HOT_PAIRS = 50_000_000  # joined rows of one key that one task may make
NULL_SPREAD = 4_096


def join_unique(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """``left``, ``left_semi`` or ``left_anti`` join with a right side of one row per key.

    Null keys of the left side get stand-in keys by input partition, which
    decide only where the row goes: the join condition still asks for a key.
    The right side keeps its key alone, so that an aggregate by that key is
    not shuffled a second time. Whether a small right side is broadcast is
    left to Spark, which knows its size at run time.
    """
    right = right.filter(F.col(on).isNotNull()).withColumnRenamed(on, "_right_key")
    kind = left.schema[on].dataType
    stand_in = -1 - F.spark_partition_id() % NULL_SPREAD
    if isinstance(kind, T.StringType):
        stand_in = F.concat(F.lit("\0"), stand_in.cast("string"))
    keyed = left.withColumn("_left_key", F.coalesce(F.col(on), stand_in.cast(kind)))
    same = (F.col("_left_key") == F.col("_right_key")) & F.col(on).isNotNull()
    return keyed.join(right, same, how).drop("_left_key", "_right_key")


def key_counts(df: DataFrame, on: str, weight: str | None = None) -> DataFrame:
    """Rows per non-null key as ``(on, rows)``; ``weight`` names a ready count."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(on).isNotNull()).groupBy(on).agg(rows.cast("bigint").alias("rows"))


def hot_fans(
    left_counts: DataFrame,
    right_counts: DataFrame,
    on: str,
    hot_rows: int = HOT_ROWS,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``(on, _left_fan, _right_fan)`` of every key with too many rows or pairs for one task.

    Each side is cut so that no piece has more than ``hot_rows`` rows. Where the
    pieces still meet in more than ``hot_pairs`` pairs, the larger side is cut
    further, down to single rows, and then the other.
    """
    none = F.lit(0).cast("bigint")
    both = (
        left_counts.select(on, F.col("rows").alias("_l"), none.alias("_r"))
        .unionAll(right_counts.select(on, none.alias("_l"), F.col("rows").alias("_r")))
        .groupBy(on)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    left, right = F.col("_l"), F.col("_r")
    pairs = left.cast("double") * right
    tasks = lambda rows: F.greatest(F.ceil(rows / hot_rows), F.lit(1)).cast("int")
    squares = F.ceil(pairs / hot_pairs)
    cut = lambda rows, other: F.least(rows, F.ceil(squares / other)).cast("int")
    large, small = F.greatest(left, right), F.least(left, right)
    hot = both.filter((left > hot_rows) | (right > hot_rows) | (pairs > hot_pairs))
    fans = hot.select(
        on,
        (left >= right).alias("_left_large"),
        F.greatest(tasks(large), cut(large, tasks(small))).alias("_large"),
        small.alias("_small_rows"),
        squares.alias("_squares"),
        tasks(small).alias("_small"),
    )
    rest = F.least(F.col("_small_rows"), F.ceil(F.col("_squares") / F.col("_large"))).cast("int")
    small_fan = F.greatest("_small", rest)
    return fans.select(
        on,
        F.when(F.col("_left_large"), F.col("_large")).otherwise(small_fan).alias("_left_fan"),
        F.when(F.col("_left_large"), small_fan).otherwise(F.col("_large")).alias("_right_fan"),
    )


def join_fanout(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "left",
    *,
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``left`` or ``inner`` join with any number of matches, salted for hot keys.

    A hot key is cut into ``left fan x right fan`` pieces. Each left row goes
    to one left piece and is copied to every right piece, and the other way
    round, so that each pair meets once. A left copy that meets nothing in its
    piece is dropped when the key is cut on the right: such a key has matches.

    The hot keys are found first, by a job that counts the keys of both sides,
    and written to the shared folder. Their true size is then known when the
    join is planned, so Spark broadcasts them if they are few and joins them
    like any table if not; there is no limit on their number.
    """
    fans = stored(
        hot_fans(
            left_counts if left_counts is not None else key_counts(left, on),
            right_counts if right_counts is not None else key_counts(right, on),
            on, hot_rows, hot_pairs,
        ),
        "hot-keys",
    )
    left_fan, right_fan = F.coalesce("_left_fan", F.lit(1)), F.coalesce("_right_fan", F.lit(1))

    def pieces(fan):
        return F.explode(F.sequence(F.lit(0), fan - 1))

    left_piece = (
        F.when(F.col(on).isNull(), content_spread(left.columns, NULL_SPREAD))
        .when(left_fan > 1, content_spread(left.columns, left_fan))
        .otherwise(0)
    )
    right_piece = F.when(right_fan > 1, content_spread(right.columns, right_fan)).otherwise(0)
    salted_left = join_unique(left, fans, on).select(
        *left.columns, left_piece.alias("_lp"), (right_fan > 1).alias("_cut"), pieces(right_fan).alias("_rp")
    )
    salted_right = join_unique(right.filter(F.col(on).isNotNull()), fans, on).select(
        *right.columns, right_piece.alias("_rp"), pieces(left_fan).alias("_lp"), F.lit(True).alias("_met")
    )
    joined = salted_left.join(salted_right, [on, "_lp", "_rp"], how)
    if how == "left":
        joined = joined.filter(~(F.col("_cut") & F.col("_met").isNull()))
    return joined.drop("_lp", "_rp", "_cut", "_met")
