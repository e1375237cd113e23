"""Frame-level cleaning steps shared by the batch and streaming ingests."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import header_name, null_tokens, parse_number
from ..schemas import STAMP, Entity


def normalise_headers(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    names = [(renames or {}).get(name, name) for name in map(header_name, df.columns)]
    twice = [name for name, n in Counter(names).items() if n > 1]
    if twice:
        raise ValueError(f"several sheet columns clean to the same name: {sorted(twice)}")
    return df.toDF(*names)


def column(name: str) -> Column:
    """Column by its exact name: cleaned headers may hold dots and other signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def nullify_tokens(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Null tokens become null in every text column not named in ``keep``."""
    return df.select(
        *[
            null_tokens(column(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) and f.name not in keep
            else column(f.name)
            for f in df.schema.fields
        ]
    )


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.filter(reduce(or_, [column(c).isNotNull() for c in df.columns]))


def drop_legend(df: DataFrame, entity: Entity) -> DataFrame:
    """Drop the explanatory line; rows with a null key stay."""
    if entity.key not in df.columns:
        return df
    return df.filter(~F.col(entity.key).eqNullSafe(entity.legend))


def parse_numbers(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Parse the named text columns to double; a missing one is a null column."""
    return df.withColumns(
        {
            name: parse_number(F.col(name)) if name in df.columns else F.lit(None).cast("double")
            for name in names
        }
    )


def run_stamp(run_ts: datetime | Column | None) -> Column:
    """The given run time, or the time of the query."""
    if run_ts is None:
        return F.current_timestamp()
    return run_ts if isinstance(run_ts, Column) else F.lit(run_ts)


def stamp(df: DataFrame, run_ts: datetime | Column | None = None) -> DataFrame:
    return df.withColumn(STAMP, run_stamp(run_ts))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: unknown ones dropped, missing ones null.

    Types may differ only where a table insert would accept them too; text is
    never turned into a number here.
    """
    return df.to(T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


def clean_sheet(raw: DataFrame, entity: Entity, run_ts: datetime | Column | None = None) -> DataFrame:
    """Raw text sheet to the rows of its bronze table. Batch and streaming alike."""
    df = normalise_headers(raw, entity.renames)
    df = drop_blank_rows(nullify_tokens(df))
    df = drop_legend(df, entity)
    df = parse_numbers(df, entity.numbers)
    return conform(stamp(df, run_ts), entity.schema)


def keyed_rows(df: DataFrame, key: str, legend: str) -> DataFrame:
    """Rows with a usable key: not null, not blank, not the legend sentence."""
    value = F.col(key)
    return df.filter(value.isNotNull() & (value != legend) & (F.trim(value) != ""))
