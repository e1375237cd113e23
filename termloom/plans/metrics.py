"""Key figures of the dashboard and of the maintenance screens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_fanout
from ..operators.versions import newest_with_key
from ..schemas import (
    CODE, DOMAIN, FLAGS, NO_DOMAIN, NO_PRINCIPLE, PRIORITY, RULE_ID, STAMP, SUBDOMAIN, TERM,
    TOP_GROUPS, YES,
)
from .golden import golden_rows
from .silver import ID, usable_concepts, usable_rules, usable_trace, with_id

PRINCIPLE = "principio_de_calidad_asociado"
DEFINITION_FIELDS = ("concepto_de_negocio", TERM, "definicion_de_negocio")
LINEAGE_FIELDS = {
    "fuente_oficial": "sistema",
    "esquema": "esquema",
    "tabla_en_fuente_oficial": "tabla",
    "campo_en_fuente_oficial": "campo",
    "aplicativos": "aplicacion",
}


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- maintenance screens --------------------------------------------------


def kpi_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, total)`` for each named frame, in one job."""
    return stack(
        [df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("table"), "total")
         for name, df in tables.items()]
    )


def top_groups(df: DataFrame, column: str, empty: str, label: str, limit: int = TOP_GROUPS) -> DataFrame:
    """The largest groups; equal sizes are ordered by label."""
    groups = df.groupBy(F.coalesce(F.col(column), F.lit(empty)).alias(label)).agg(
        F.count(F.lit(1)).alias("total")
    )
    return groups.orderBy(F.desc("total"), F.asc(label)).limit(limit)


def top_domains(concepts: DataFrame, limit: int = TOP_GROUPS) -> DataFrame:
    return top_groups(concepts, DOMAIN, NO_DOMAIN, DOMAIN, limit)


def top_principles(rules: DataFrame, limit: int = TOP_GROUPS) -> DataFrame:
    return top_groups(rules, PRINCIPLE, NO_PRINCIPLE, "principio", limit)


def latest_records(df: DataFrame, order_by: str | None = STAMP, limit: int | None = None) -> DataFrame:
    """Newest first; ties are settled by the other columns.

    One ingest stamps all its rows alike, so ties are the rule. Without a limit
    the result is sorted in ranges over all columns, and over the input
    partition for equal rows, so that no range has to hold a whole ingest.
    """
    if order_by is None:
        return df if limit is None else df.limit(limit)
    order = [F.desc_nulls_last(order_by), *[F.asc_nulls_last(c) for c in df.columns if c != order_by]]
    if limit is not None:
        return df.orderBy(*order).limit(limit)
    return df.withColumn("_part", F.spark_partition_id()).orderBy(*order, "_part").drop("_part")


# --- dashboard --------------------------------------------------------------
# All take ``silver.coverage`` rows: one per concept row, not per joined row.


def _one_per_code(coverage: DataFrame, *by: str) -> DataFrame:
    """Per code (and group): is it critical, personal, ...; has it rules, trace, texts."""
    rows = golden_rows(coverage)
    complete = reduce(
        lambda a, b: a & b, [F.coalesce(F.trim(c) != "", F.lit(False)) for c in DEFINITION_FIELDS]
    )
    return (
        rows.filter(F.col(CODE).isNotNull())
        .groupBy(*by, CODE)
        .agg(
            *[F.max(F.col(flag) == YES).alias(flag) for flag in FLAGS],
            F.max(F.col("rule_rows") > 0).alias("has_rule"),
            F.max(F.col("trace_rows") > 0).alias("has_trace"),
            F.max(complete).alias("complete"),
        )
    )


def dashboard_totals(coverage: DataFrame) -> DataFrame:
    """``(metric, total)``: entities, domains, subdomains, critical, with rule, with trace."""
    entities = _one_per_code(coverage).agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if("dato_critico").alias("critical"),
        F.count_if("has_rule").alias("with_rule"),
        F.count_if("has_trace").alias("with_trace"),
    )
    pairs = coverage.select(DOMAIN, SUBDOMAIN).distinct()
    both = F.col(DOMAIN).isNotNull() & F.col(SUBDOMAIN).isNotNull()
    groups = pairs.agg(
        F.count_distinct(DOMAIN).alias("domains"), F.count_if(both).alias("subdomains")
    )
    return stack(
        [df.unpivot([], df.columns, "metric", "total") for df in (entities, groups)]
    )


def flags_by_domain(coverage: DataFrame) -> DataFrame:
    """``(domain, flag, n)``: distinct critical, personal and sensitive codes."""
    per_domain = _one_per_code(coverage, DOMAIN).groupBy(DOMAIN).agg(
        *[F.count_if(flag).alias(flag) for flag in FLAGS]
    )
    return per_domain.unpivot([DOMAIN], list(FLAGS), "flag", "n")


def priority_share(coverage: DataFrame) -> DataFrame:
    """Distinct codes per priority, and their share of all distinct codes."""
    rows = golden_rows(coverage).filter(F.col(CODE).isNotNull())
    everything = rows.agg(F.count_distinct(CODE).alias("n"))
    per_priority = rows.groupBy(PRIORITY).agg(F.count_distinct(CODE).alias("n"))
    return per_priority.withColumn("share", F.round(F.col("n") / everything.scalar(), 4))


def rules_by_principle(concepts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct rule ids per principle and domain, over the rules that concepts use.

    Both sides are made distinct before the join: copies of a term within a
    domain would otherwise multiply with the term's rules.
    """
    terms = golden_rows(concepts).filter(F.col(TERM).isNotNull()).select(TERM, DOMAIN).distinct()
    ids = usable_rules(rules).select(
        TERM, RULE_ID, F.coalesce(PRINCIPLE, F.lit(NO_PRINCIPLE)).alias("principio")
    ).distinct()
    return join_fanout(terms, ids, TERM, "inner").groupBy("principio", DOMAIN).agg(F.count_distinct(RULE_ID).alias("n"))


def completeness(coverage: DataFrame) -> DataFrame:
    """Per subdomain: how many codes have texts, a rule and trace, in percent, and how many lack them."""
    pillars = {"concepto": "complete", "regla": "has_rule", "trazabilidad": "has_trace"}
    groups = _one_per_code(coverage, SUBDOMAIN).groupBy(SUBDOMAIN).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(column).alias(f"_{name}") for name, column in pillars.items()],
    )
    return groups.select(
        SUBDOMAIN,
        "total",
        *[F.round(F.col(f"_{name}") * 100 / F.col("total"), 2).alias(f"pct_{name}") for name in pillars],
        *[(F.col("total") - F.col(f"_{name}")).alias(f"sin_{name}") for name in pillars],
    )


def last_update(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, last_update)`` for each named frame."""
    return stack(
        [df.agg(F.max(STAMP).alias("last_update")).select(F.lit(name).alias("table"), "last_update")
         for name, df in tables.items()]
    )


def newest_rows(df: DataFrame, key: str) -> DataFrame:
    """The newest row of each key of a bronze table; rows without a key stay."""
    return newest_with_key(df, key, [STAMP])


SOURCE_SPREAD = 64

# --- lineage ------------------------------------------------------------------


def _sources(trace: DataFrame) -> DataFrame:
    """Distinct (id, source) pairs, so that repeated trace rows do not fan out."""
    fields = [F.col(c).alias(name) for c, name in LINEAGE_FIELDS.items()]
    return with_id(usable_trace(trace)).filter(F.col(ID).isNotNull()).select(ID, *fields).distinct()


def lineage_of_codes(codes: DataFrame, trace: DataFrame) -> DataFrame:
    """Where the given codes come from: system, schema, table, field, application."""
    wanted = with_id(codes.select(F.trim(CODE).alias(CODE))).filter(F.col(ID).isNotNull()).distinct()
    return join_fanout(wanted, _sources(trace), ID, "inner").select(CODE, *LINEAGE_FIELDS.values())


def codes_of_sources(sources: DataFrame, trace: DataFrame, concepts: DataFrame) -> DataFrame:
    """Which concepts use the given source fields (columns ``tabla`` and ``campo``).

    A null field asks for rows whose field is empty. Each wanted pair is copied to ``SOURCE_SPREAD`` pieces, and
    a row goes to the piece of its id, so that a field that most ids share is looked up by as many tasks.
    """
    pair = lambda tabla, campo: F.xxhash64(tabla.isNull(), tabla, campo.isNull(), campo)
    wanted = sources.select(F.col("tabla").alias("_tabla"), F.col("campo").alias("_campo")).distinct()
    wanted = wanted.select(
        "*",
        pair(F.col("_tabla"), F.col("_campo")).alias("_pair"),
        F.explode(F.sequence(F.lit(0), F.lit(SOURCE_SPREAD - 1))).alias("_piece"),
    )
    fields = _sources(trace).select(ID, "tabla", "campo").distinct()
    fields = fields.withColumns(
        {"_p": pair(F.col("tabla"), F.col("campo")), "_own": F.pmod(F.xxhash64(ID), F.lit(SOURCE_SPREAD)).cast("int")}
    )
    same = (
        (F.col("_p") == F.col("_pair"))
        & (F.col("_own") == F.col("_piece"))
        & F.col("tabla").eqNullSafe(F.col("_tabla"))
        & F.col("campo").eqNullSafe(F.col("_campo"))
    )
    hits = fields.join(wanted, same, "left_semi").drop("_p", "_own")
    codes = with_id(usable_concepts(concepts).select(CODE)).filter(F.col(ID).isNotNull()).distinct()
    return join_fanout(hits, codes, ID, "inner").select("tabla", "campo", CODE)

