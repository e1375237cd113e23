"""Batches of inserts, updates and deletes applied to a bronze table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean_text, plain_number
from ..schemas import STAMP, Entity
from .clean import conform, run_stamp
from .joins import join_unique
from .versions import latest_per_key


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def form_values(changes: DataFrame, entity: Entity, names: tuple[str, ...]) -> DataFrame:
    """The named columns as typed values: text stripped, blank null, numbers parsed."""
    values = {}
    for name in names:
        if name not in changes.columns:
            continue
        if name in entity.numbers:
            values[name] = plain_number(F.col(name)) if _is_text(changes, name) else F.col(name).cast("double")
        else:
            values[name] = clean_text(F.col(name).cast("string"))
    return changes.withColumns(values)


def check_changes(changes: DataFrame, entity: Entity, inserting: bool = True) -> DataFrame:
    """Adds ``missing_fields``, ``bad_values`` and ``accepted``.

    Required fields and choice lists bind inserts only. A field counts as
    missing when it is null or empty; one of blanks only passes and is stored
    as null. A number text that is not a number is always a bad value.
    """
    def value(name: str) -> Column:
        return F.col(name).cast("string") if name in changes.columns else F.lit(None).cast("string")

    missing = [
        F.when(F.coalesce(value(name), F.lit("")) == "", F.lit(name))
        for name in (entity.required if inserting else ())
    ]
    bad = [
        F.when(F.coalesce(~value(name).isin("", *choices), F.lit(False)), F.lit(name))
        for name, choices in (entity.choices if inserting else {}).items()
    ]
    bad += [
        F.when(clean_text(F.col(name)).isNotNull() & plain_number(F.col(name)).isNull(), F.lit(name))
        for name in entity.numbers
        if name in changes.columns and _is_text(changes, name)
    ]

    def names(found: list[Column]) -> Column:
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    return changes.withColumns({"missing_fields": names(missing), "bad_values": names(bad)}).withColumn(
        "accepted", (F.size("missing_fields") == 0) & (F.size("bad_values") == 0)
    )


def accepted(changes: DataFrame, entity: Entity, inserting: bool = True) -> DataFrame:
    return check_changes(changes, entity, inserting).filter("accepted").drop(
        "missing_fields", "bad_values", "accepted"
    )


def rejected(changes: DataFrame, entity: Entity, inserting: bool = True) -> DataFrame:
    return check_changes(changes, entity, inserting).filter(~F.col("accepted")).drop("accepted")


def apply_inserts(
    table: DataFrame, changes: DataFrame, entity: Entity, run_ts: datetime | Column | None = None
) -> DataFrame:
    """Table plus the accepted rows. Only insertable columns are taken."""
    rows = form_values(accepted(changes, entity), entity, entity.insertable)
    rows = rows.select(*[c for c in entity.insertable if c in rows.columns]).withColumn(STAMP, run_stamp(run_ts))
    return table.unionByName(conform(rows, table.schema))


def apply_updates(
    table: DataFrame,
    changes: DataFrame,
    entity: Entity,
    sequence: str,
    run_ts: datetime | Column | None = None,
) -> DataFrame:
    """Every row with a changed key gets all updatable columns, null included.

    Of several changes with one key the one with the highest ``sequence``
    counts. Keys are compared exactly; only the change's key is stripped.
    A change must carry every updatable column.
    """
    absent = [c for c in entity.updatable if c not in changes.columns]
    if absent:
        raise ValueError(f"update lacks columns {absent}")
    named = (entity.key, *entity.updatable)
    values = form_values(accepted(changes, entity, inserting=False), entity, named)
    values = values.select(*named, F.col(sequence).alias("_seq")).filter(F.col(entity.key).isNotNull())
    newest = latest_per_key(values, [entity.key], ["_seq"]).select(
        entity.key, *[F.col(c).alias(f"_new_{c}") for c in entity.updatable], F.lit(True).alias("_hit")
    )
    hit = F.coalesce("_hit", F.lit(False))
    new_value = {c: F.col(f"_new_{c}") for c in entity.updatable}
    if STAMP in table.columns:
        new_value[STAMP] = run_stamp(run_ts)
    return join_unique(table, newest, entity.key).select(
        *[
            F.when(hit, new_value[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in new_value
            else F.col(f.name)
            for f in table.schema.fields
        ]
    )


def apply_deletes(table: DataFrame, keys: DataFrame, entity: Entity) -> DataFrame:
    """Table without any row of the given keys; a null or blank key deletes nothing."""
    doomed = keys.select(clean_text(F.col(entity.key)).alias(entity.key)).distinct()
    return join_unique(table, doomed, entity.key, "left_anti").select(*table.columns)
