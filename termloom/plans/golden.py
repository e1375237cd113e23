"""Silver to the two golden tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import yes_no
from ..functions.means import add_parts, mean, mean_parts
from ..operators.clean import conform, run_stamp
from ..schemas import (
    CODE, DOMAIN, FLAGS, GOLDEN_DEFAULTS, PRIORITY, PRIORITY_SUMMARY, QUALITY_REPORT, RULE_ID,
    SUBDOMAIN, THRESHOLDS, YES, YES_SPELLINGS,
)

TOTALS = dict(zip(FLAGS, ("total_datos_criticos", "total_datos_personales", "total_datos_sensibles")))
AVERAGES = dict(zip(THRESHOLDS, ("promedio_umbral_superior", "promedio_umbral_inferior")))


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({c: v for c, v in GOLDEN_DEFAULTS.items() if c in df.columns})


def standard_flags(df: DataFrame, spellings: Sequence[str] = YES_SPELLINGS) -> DataFrame:
    return df.withColumns({flag: yes_no(F.col(flag), spellings) for flag in FLAGS})


def golden_rows(df: DataFrame, spellings: Sequence[str] = YES_SPELLINGS) -> DataFrame:
    """Rows as the golden layer reads them: defaults filled, flags Sí or No."""
    return standard_flags(fill_defaults(df), spellings)


def _finish(df: DataFrame, run_ts: datetime | Column | None) -> DataFrame:
    averages = {column: mean(name) for name, column in AVERAGES.items()}
    stamped = df.withColumns(averages).withColumn("ultimo_procesamiento", run_stamp(run_ts))
    return conform(stamped, QUALITY_REPORT)


def report_from_codes(per_code: DataFrame, run_ts: datetime | Column | None) -> DataFrame:
    """Second step of the two-step report: rows per (domain, subdomain, code) to groups."""
    has_code = F.col(CODE).isNotNull()
    report = per_code.groupBy(DOMAIN, SUBDOMAIN).agg(
        F.count(CODE).alias("total_conceptos"),
        *[F.count_if(has_code & F.col(flag)).alias(total) for flag, total in TOTALS.items()],
        F.sum("rules").alias("total_reglas_calidad"),
        *[part for name in THRESHOLDS for part in add_parts(name)],
    )
    return _finish(report, run_ts)


def _flags_any() -> list[Column]:
    return [F.max(F.col(flag) == YES).alias(flag) for flag in FLAGS]


def quality_report(
    silver: DataFrame, run_ts: datetime | Column | None = None, distinct_rules: bool = False
) -> DataFrame:
    """Quality report by domain and subdomain, from the silver table.

    Rows are first brought down to one per (domain, subdomain, code). Distinct
    counts are then plain counts, where one aggregation with several of them
    would write every silver row five times.

    ``total_reglas_calidad`` counts silver rows with a rule, as repeated by the
    joins. ``distinct_rules=True`` counts the group's different rules instead.
    """
    rows = golden_rows(silver)
    per_code = rows.groupBy(DOMAIN, SUBDOMAIN, CODE).agg(
        *_flags_any(),
        F.count(RULE_ID).alias("rules"),
        *[part for name in THRESHOLDS for part in mean_parts(F.col(name), name)],
    )
    report = report_from_codes(per_code, run_ts)
    if not distinct_rules:
        return report
    different = rows.groupBy(DOMAIN, SUBDOMAIN).agg(F.count_distinct(RULE_ID).alias("total_reglas_calidad"))
    return conform(
        report.drop("total_reglas_calidad").join(different, [DOMAIN, SUBDOMAIN]), QUALITY_REPORT
    )


def quality_report_eager(coverage: DataFrame, run_ts: datetime | Column | None = None) -> DataFrame:
    """The same report without silver: sums of the joins' sizes instead of their rows."""
    times = F.col("fan_out")
    per_code = golden_rows(coverage).groupBy(DOMAIN, SUBDOMAIN, CODE).agg(
        *_flags_any(),
        F.sum(times * F.col("rule_rows")).alias("rules"),
        *[part for name in THRESHOLDS for part in add_parts(name, times)],
    )
    return report_from_codes(per_code, run_ts)


def priority_summary(rows: DataFrame, run_ts: datetime | Column | None = None) -> DataFrame:
    """Distinct concepts by domain and priority, from silver or from coverage."""
    summary = golden_rows(rows).groupBy(DOMAIN, PRIORITY).agg(
        F.count_distinct(CODE).alias("cantidad_conceptos")
    )
    return conform(summary.withColumn("ultimo_procesamiento", run_stamp(run_ts)), PRIORITY_SUMMARY)
