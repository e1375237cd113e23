"""Bronze tables to the wide silver table, and to its compact form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric_id
from ..functions.means import mean_parts
from ..operators.clean import conform, keyed_rows, run_stamp
from ..operators.joins import HOT_ROWS, join_fanout, join_unique, key_counts
from ..schemas import (
    CODE, CONCEPT_LEGEND, RULE_ID, RULE_LEGEND, SILVER, STAMP, TERM, THRESHOLDS, TRACE_LEGEND,
)

ID = "_id_num"
LINEAGE_COLUMNS = {
    "tabla_en_fuente_oficial": "tabla_en_fuente_oficial",
    "campo_en_fuente_oficial": "campo_en_fuente_oficial",
    "aplicativos": "aplicativo",
    "fuente_oficial": "fuente_oficial",
}
RULE_DETAILS = (RULE_ID, "descripcion_de_regla_de_calidad", "principio_de_calidad_asociado", *THRESHOLDS)


def usable_concepts(concepts: DataFrame) -> DataFrame:
    return keyed_rows(concepts, CODE, CONCEPT_LEGEND).withColumn(CODE, F.trim(CODE))


def usable_rules(rules: DataFrame) -> DataFrame:
    return keyed_rows(rules, RULE_ID, RULE_LEGEND).withColumn(TERM, F.trim(TERM))


def usable_trace(trace: DataFrame) -> DataFrame:
    return keyed_rows(trace, CODE, TRACE_LEGEND).withColumn(CODE, F.trim(CODE))


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn(ID, numeric_id(F.col(CODE)))


def all_concepts(concepts: DataFrame, custom: DataFrame, trim_terms: bool = False) -> DataFrame:
    """Sheet concepts and those entered by hand, duplicates kept.

    Hand-entered ones are neither filtered nor trimmed and have no numeric id,
    so they never meet a trace row.
    """
    sheet = with_id(usable_concepts(concepts)).withColumn("is_custom_concept", F.lit(False))
    by_hand = custom.withColumn("is_custom_concept", F.lit(True))
    union = sheet.unionByName(by_hand, allowMissingColumns=True).select(*sheet.columns)
    return union.withColumn(TERM, F.trim(TERM)) if trim_terms else union


def _trace_side(trace: DataFrame) -> DataFrame:
    return with_id(usable_trace(trace)).select(
        ID,
        *[F.col(c).alias(name) for c, name in LINEAGE_COLUMNS.items()],
        F.try_to_timestamp("fecha_de_actualizacion_en_el_diccionario_tecnico").alias(
            "fecha_actualizacion_diccionario"
        ),
        F.lit(True).alias("has_trace"),
    )


def _rule_side(rules: DataFrame) -> DataFrame:
    usable = usable_rules(rules)
    return usable.select(
        TERM,
        *[F.col(c).cast("double") if c in THRESHOLDS else F.col(c) for c in RULE_DETAILS],
    )


def join_trace(concepts: DataFrame, trace: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Concepts with each of their trace rows; ``has_trace`` marks a match."""
    return join_fanout(concepts, _trace_side(trace), ID, hot_rows=hot_rows).withColumn(
        "has_trace", F.coalesce("has_trace", F.lit(False))
    )


def join_trace_and_rules(
    concepts: DataFrame, trace: DataFrame, rules: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every (concept, trace row, rule) combination of the two left joins.

    The rules are attached first. The order does not change the result, but
    concepts have far fewer rules than trace rows, and so the join with the
    larger fan-out comes last and its rows are not shuffled again.
    """
    rule_side, trace_side = _rule_side(rules), _trace_side(trace)
    rules_per_term = key_counts(rule_side, TERM)
    rows_per_id = key_counts(
        join_unique(concepts.select(ID, TERM).filter(F.col(ID).isNotNull()), rules_per_term, TERM)
        .withColumn("_weight", F.coalesce("rows", F.lit(1))),
        ID,
        weight="_weight",
    )
    with_rules = join_fanout(concepts, rule_side, TERM, right_counts=rules_per_term, hot_rows=hot_rows)
    return join_fanout(with_rules, trace_side, ID, left_counts=rows_per_id, hot_rows=hot_rows).withColumn(
        "has_trace", F.coalesce("has_trace", F.lit(False))
    )


def silver(
    concepts: DataFrame,
    rules: DataFrame,
    trace: DataFrame,
    custom: DataFrame,
    run_ts: datetime | Column | None = None,
    trim_terms: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The silver table: one row per concept, trace row and rule."""
    wanted = {f.name for f in SILVER.fields} & set(concepts.columns) - {STAMP}
    base = all_concepts(concepts, custom, trim_terms).select(*sorted(wanted), "is_custom_concept", ID)
    wide = join_trace_and_rules(base, trace, rules, hot_rows).withColumn(STAMP, run_stamp(run_ts))
    return conform(wide, SILVER)


def coverage(
    concepts: DataFrame,
    rules: DataFrame,
    trace: DataFrame,
    custom: DataFrame,
    trim_terms: bool = False,
) -> DataFrame:
    """One row per concept row, with what silver would fan out kept as numbers.

    ``trace_rows`` and ``rule_rows`` count the matches, ``fan_out`` how often
    silver repeats the concept's rules. Threshold sums are those of the
    concept's rules once.
    """
    return coverage_of(all_concepts(concepts, custom, trim_terms), rules, trace)


def coverage_of(base: DataFrame, rules: DataFrame, trace: DataFrame) -> DataFrame:
    """``coverage`` of ``all_concepts`` rows.

    Trace and rules are aggregated to one row per key before they are joined, so neither join multiplies rows.
    """
    trace_per_id = (
        with_id(usable_trace(trace)).filter(F.col(ID).isNotNull())
        .groupBy(ID).agg(F.count(F.lit(1)).alias("trace_rows"))
    )
    parts = [p for name in THRESHOLDS for p in mean_parts(F.col(name), name)]
    rules_per_term = (
        _rule_side(rules).filter(F.col(TERM).isNotNull())
        .groupBy(TERM).agg(F.count(RULE_ID).alias("rule_rows"), *parts)
    )
    joined = join_unique(join_unique(base, trace_per_id, ID), rules_per_term, TERM)
    zero = F.lit(0).cast("bigint")
    return joined.withColumns(
        {
            "trace_rows": F.coalesce("trace_rows", zero),
            "rule_rows": F.coalesce("rule_rows", zero),
        }
    ).withColumn("fan_out", F.greatest("trace_rows", F.lit(1).cast("bigint")))
