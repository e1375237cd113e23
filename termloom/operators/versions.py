"""Newest rows, snapshot differences and validity intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import latest_first
from ..session import stored
from .joins import join_unique


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key.

    Written as a maximum, not as a numbered window: a maximum is taken before
    the shuffle too, so a key with very many rows sends one row per task.
    """
    newest = df.groupBy(*keys).agg(F.max(latest_first(df.columns, order)).alias("_row"))
    return newest.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def newest_with_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; a row without a key is nobody's version and stays."""
    keyed = latest_per_key(df.filter(F.col(key).isNotNull()), [key], order)
    return keyed.unionByName(df.filter(F.col(key).isNull()))


def dedup_concepts(concepts: DataFrame, code: str, order: list[str]) -> DataFrame:
    """One row per trimmed code; rows whose code is null or blank are kept as they are."""
    coded = F.coalesce(F.trim(code) != "", F.lit(False))
    return latest_per_key(concepts.filter(coded).withColumn(code, F.trim(code)), [code], order).unionByName(
        concepts.filter(~coded)
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """What changed between two snapshots, duplicates included.

    Equal rows cancel out first, counted as a multiset. A key left with exactly
    one row on each side is an ``update`` with the names of the changed columns;
    every other row left over is a ``delete`` or an ``insert`` with the number
    of its copies. Null keys are never paired.

    Columns: key, ``change``, ``copies``, ``changed_columns``, ``before``, ``after``.
    """
    columns = [c for c in old.columns if c not in ignore]
    if set(columns) - set(new.columns):
        raise ValueError("the new snapshot lacks columns of the old one")
    rows = (
        old.select(*columns, F.lit(-1).cast("bigint").alias("_n"))
        .unionByName(new.select(*columns, F.lit(1).cast("bigint").alias("_n")))
    )
    return paired_changes(rows, columns, key)


def paired_changes(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The difference that rows counted with ``_n`` make, negative ones having gone: see ``snapshot_diff``."""
    row = F.struct(*columns)
    # Written down: all that follows reads it, and most of it only the keys.
    left_over = stored(rows.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0), "left-over")
    gone, come = F.col("_n") < 0, F.col("_n") > 0

    paired = stored(
        left_over.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum(F.when(gone, -F.col("_n")).otherwise(0)).alias("_gone"), F.sum(F.when(come, F.col("_n")).otherwise(0)).alias("_come"))
        .filter((F.col("_gone") == 1) & (F.col("_come") == 1))
        .select(key),
        "paired-keys",
    )
    # Such a key has one row on each side. Joined, and not grouped, so that who reads few columns of a side moves only these.
    side = lambda which, name: join_unique(left_over.filter(which), paired, key, "left_semi").select(key, row.alias(name))
    pairs = side(gone, "before").join(side(come, "after"), key)
    differs = [
        F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c))
        for c in columns if c != key
    ]
    updates = pairs.select(
        key,
        F.lit("update").alias("change"),
        F.lit(1).cast("bigint").alias("copies"),
        F.array_compact(F.array(*differs)).alias("changed_columns"),
        "before",
        "after",
    )
    singles = join_unique(left_over, paired, key, "left_anti").select(
        key,
        F.when(gone, "delete").otherwise("insert").alias("change"),
        F.abs("_n").alias("copies"),
        F.array().cast("array<string>").alias("changed_columns"),
        F.when(gone, row).alias("before"),
        F.when(come, row).alias("after"),
    )
    return updates.unionByName(singles)


def _undo(diff: DataFrame) -> DataFrame:
    """The difference in the other direction."""
    turned = F.when(F.col("change") == "insert", "delete").when(F.col("change") == "delete", "insert")
    return diff.withColumns(
        {"change": turned.otherwise(F.col("change")), "before": F.col("after"), "after": F.col("before")}
    )


def apply_diff(old: DataFrame, diff: DataFrame) -> DataFrame:
    """The snapshot that ``snapshot_diff`` compared with: its ``before`` rows leave, its ``after`` rows come.

    Rows are counted, not paired, so copies and rows without a key are right
    too. A ``before`` row that the snapshot lacks is an error of the caller and
    leaves the count of that row at zero. Columns are those of the difference.
    """
    columns = diff.schema["before"].dataType.fieldNames()

    def side(name: str, sign: int) -> DataFrame:
        rows = diff.filter(F.col(name).isNotNull())
        return rows.select(*[F.col(f"{name}.{c}").alias(c) for c in columns], (F.col("copies") * sign).alias("_n"))

    counted = (
        old.select(*columns, F.lit(1).cast("bigint").alias("_n"))
        .unionByName(side("before", -1))
        .unionByName(side("after", 1))
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .filter("_n > 0")
    )
    return counted.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*columns)


def revert_diff(new: DataFrame, diff: DataFrame) -> DataFrame:
    """The snapshot before the changes: ``apply_diff`` backwards."""
    return apply_diff(new, _undo(diff))


def history(versions: DataFrame, key: str, ts: str, deleted: str | None = None) -> DataFrame:
    """Validity interval of every version: ``valid_from``, ``valid_to``, ``is_current``.

    ``valid_to`` is the start of the key's next version, null for the newest.
    Of versions with one key and time, ordered by all columns, all but the last
    get an interval of no length. A row without a key has no later version.
    ``deleted`` names a boolean column of end marks: they end the version before
    them and are not versions themselves.

    A window over a whole key would put a busy key into one task. The rows are
    therefore cut into ranges by (key, time), whose bounds come from the data;
    the next version is looked up within each range, and only the first time of
    each range of a key is ordered along the whole key.
    """
    order = [ts, *[c for c in versions.columns if c not in (key, ts)]]
    keyed = versions.filter(F.col(key).isNotNull())
    # Written down, since the bounds of the ranges are sampled anew in each run.
    ranged = stored(
        keyed.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "history"
    )
    in_range = Window.partitionBy(key, "_range")
    versions_of = ranged.withColumn("_next", F.lead(ts).over(in_range.orderBy(*order))).withColumn(
        "_start", F.min(ts).over(in_range)
    )
    starts = versions_of.groupBy(key, "_range").agg(F.min("_start").alias("_start"))
    along_key = Window.partitionBy(key).orderBy("_range")
    following = starts.select(
        F.col(key).alias("_key"), F.col("_range").alias("_of"), F.lead("_start").over(along_key).alias("_after")
    )
    same = (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_of"))
    joined = versions_of.join(following, same)
    ended = joined.withColumn("_next", F.coalesce("_next", "_after")).drop("_key", "_of", "_after", "_range", "_start")
    free = versions.filter(F.col(key).isNull()).withColumn("_next", F.lit(None).cast(versions.schema[ts].dataType))
    rows = ended.unionByName(free)
    if deleted:
        rows = rows.filter(~F.coalesce(deleted, F.lit(False)))
    return (
        rows.withColumn("valid_from", F.col(ts))
        .withColumnRenamed("_next", "valid_to")
        .withColumn("is_current", F.col("valid_to").isNull())
    )


def as_of(
    versions: DataFrame, key: str, ts: str, at: datetime | Column, deleted: str | None = None
) -> DataFrame:
    """The version of each key that was valid at the given time; none where an end mark is the newest.

    Rows without a key are kept. Of versions with one time the largest row counts.
    """
    at = at if isinstance(at, Column) else F.lit(at)
    rows = newest_with_key(versions.filter(F.col(ts) <= at), key, [ts])
    return rows.filter(~F.coalesce(deleted, F.lit(False))) if deleted else rows


def as_of_many(
    versions: DataFrame, requests: DataFrame, key: str, ts: str, at: str, deleted: str | None = None
) -> DataFrame:
    """Each request (``key``, time ``at``) with the version of its key that was valid then.

    All columns of the request, then those of the version but its key and end mark; these are null where there
    is no version, or an end mark is the newest, or the request lacks a key or a time. Of versions with one time the largest row counts.

    Versions and requests are cut into ranges by (key, time) together. Within a range the last version is carried along;
    into a range only one version comes for each key, so a busy key is spread over many tasks.
    """
    columns = [c for c in versions.columns if c not in (key, deleted)]
    taken = set(requests.columns) & set(columns)
    if taken:
        raise ValueError(f"requests and versions share the columns {sorted(taken)}")
    mark = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    version = F.struct(F.col(ts), *[F.col(c) for c in columns if c != ts], mark.alias("_ended"))
    facts = versions.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(0).alias("_asks"), version.alias("_version")
    )
    usable = F.col(key).isNotNull() & F.col(at).isNotNull()
    asked = requests.filter(usable).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_asks"), F.struct(*requests.columns).alias("_request")
    )
    order = ["_at", "_asks", "_version"]
    ranged = stored(
        facts.unionByName(asked, allowMissingColumns=True)
        .repartitionByRange("_key", *order, F.xxhash64("_request"))
        .withColumn("_range", F.spark_partition_id()),
        "as-of",
    )
    in_range = Window.partitionBy("_key", "_range").orderBy(*order)
    along = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("_newest", F.last("_version", ignorenulls=True).over(along)).filter("_asks = 1")
    tails = ranged.groupBy("_key", "_range").agg(F.max("_version").alias("_tail"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        F.col("_key").alias("_k"), F.col("_range").alias("_of"), F.last("_tail", ignorenulls=True).over(before).alias("_carried")
    )
    found = seen.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_of"))).withColumn(
        "_valid", F.coalesce("_newest", "_carried")
    )
    valid = F.when(~F.col("_valid._ended"), F.col("_valid"))
    answered = found.select("_request.*", *[valid[c].alias(c) for c in columns])
    return answered.unionByName(requests.filter(~usable), allowMissingColumns=True)
