"""Averages that do not depend on the order in which rows are added.

Sums of doubles differ in the last digits from run to run, and a different last
digit can flip the fourth decimal of a rounded average. Values that a decimal
holds exactly are therefore added as decimals. Only values that do not fit are
added as doubles, apart from the others, and join the total at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(28,9)"
PARTS = ("count", "exact_sum", "rest_sum")


def mean_parts(value: Column, name: str) -> list[Column]:
    """Aggregates that ``add_parts`` can add up further and ``mean`` can finish."""
    value = F.when(~F.isnan(value), value)
    exact = value.try_cast(EXACT)
    fits = F.coalesce(exact.cast("double") == value, F.lit(False))
    return [
        F.count(value).alias(f"{name}_count"),
        F.sum(F.when(fits, exact)).alias(f"{name}_exact_sum"),
        F.sum(F.when(~fits, value)).alias(f"{name}_rest_sum"),
    ]


def add_parts(name: str, weight: Column | None = None) -> list[Column]:
    """Totals of earlier parts, each optionally counted ``weight`` times."""
    times = (lambda part: F.col(part) * weight) if weight is not None else F.col
    return [F.sum(times(f"{name}_{part}")).alias(f"{name}_{part}") for part in PARTS]


def mean(name: str, digits: int = 4) -> Column:
    """The rounded average, 0.0 when there was no value."""
    count = F.coalesce(F.col(f"{name}_count"), F.lit(0)).cast("double")
    exact = F.coalesce(F.col(f"{name}_exact_sum").cast("double"), F.lit(0.0))
    total = exact + F.coalesce(F.col(f"{name}_rest_sum"), F.lit(0.0))
    return F.coalesce(F.round(F.try_divide(total, count), digits), F.lit(0.0))
