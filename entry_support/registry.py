"""The registered queries. Each takes ``(spark, sf_dir)`` and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import numeric_id
from termloom.operators import changelog, changes, clean, versions
from termloom.plans import golden, incremental, jobs, metrics, silver
from termloom.schemas import (
    CODE, CONCEPT, CONCEPTS, CUSTOM_CONCEPTS, DOMAIN, FLAGS, LINEAGE, PRIORITY, RULE, RULE_ID, RULES,
    LAYERS, REJECTED_TABLE, STAMP, SUBDOMAIN, TERM, THRESHOLDS, TRACE,
)
from termloom.session import shared_folder, stored
from termloom.sources.sheets import read_sheet
from termloom.sources.tables import Catalog, create_tables, read_table, write_table

from .mapping import spark_view

RUN_TS = datetime(2026, 1, 1)
AS_OF = datetime(2024, 1, 15)
LATEST = 50

Query = Callable[[SparkSession, str], DataFrame]


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the test tables have them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


class Bronze:
    """The mapped tables in the shape of the bronze contracts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.view = lru_cache(maxsize=None)(lambda view: spark_view(spark, sf_dir, view))

    @cached_property
    def concepts(self) -> DataFrame:
        return clean.conform(self.view("fx_concepts"), CONCEPTS)

    @cached_property
    def rules(self) -> DataFrame:
        return clean.conform(clean.parse_numbers(self.view("fx_rules"), THRESHOLDS), RULES)

    @cached_property
    def trace(self) -> DataFrame:
        return clean.conform(self.view("fx_trace"), TRACE)

    @cached_property
    def custom(self) -> DataFrame:
        return clean.conform(self.view("fx_custom"), CUSTOM_CONCEPTS)

    @cached_property
    def concept_rows(self) -> DataFrame:
        return silver.all_concepts(self.concepts, self.custom)

    @property
    def silver(self) -> DataFrame:
        return silver.silver(self.concepts, self.rules, self.trace, self.custom, run_ts=RUN_TS)

    @property
    def coverage(self) -> DataFrame:
        return silver.coverage(self.concepts, self.rules, self.trace, self.custom)


def _on_bronze(query: Callable[[Bronze], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain_times(query(Bronze(spark, sf_dir)))


# --- sheets and cleaning ------------------------------------------------------

# Headers as people type them in the sheets; cleaning turns them into columns. Those of the
# other columns are their words in capitals.
TYPED = {
    CODE: " Código de Entidad (del dato)",
    TERM: "TÉRMINO DE NEGOCIO",
    DOMAIN: "Nombre del  Dominio",
    "dato_critico": "Dato-Crítico?",
    "personal": "[Personal]",
    "definicion_de_negocio": "Definición/de Negocio",
    RULE_ID: "ID Regla de Calidad #",
    "principio_de_calidad_asociado": "Principio de Calidad (asociado)",
    "umbral_inferior": "Umbral - Inferior",
}
# Headers that only a rename turns into their column.
TYPED_IN_TRACE = {"aplicativos": "Aplicativo(s)", "sensible": "Sensble", "data_entry": "Data entry (SI/NO)"}
SHEET_ROWS = 250_000  # rows of one exported file
SHEETS = {"concepts": ("fx_concepts", CONCEPT), "rules": ("fx_rules", RULE), "trace": ("fx_trace", LINEAGE)}


def _typed(sheet: str) -> dict[str, str]:
    """Column -> header, for all columns but the stamp."""
    own = {**TYPED, **(TYPED_IN_TRACE if sheet == "trace" else {})}
    names = [c for c in SHEETS[sheet][1].schema.names if c != STAMP]
    return {c: own.get(c, c.replace("_", " ").upper()) for c in names}


def _export_sheet(spark: SparkSession, sf_dir: str, sheet: str) -> str:
    """Write a mapped view as the CSV export of a sheet, in packed files of bounded size; returns its folder."""
    view, headers = SHEETS[sheet][0], _typed(sheet)
    folder = shared_folder(spark, f"sheet-{sheet}")
    rows = spark_view(spark, sf_dir, view)
    # Blanks around values are data here, so the writer must keep them.
    rows.select(*[F.col(c).alias(h) for c, h in headers.items()]).write.options(
        header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
        compression="lz4", maxRecordsPerFile=SHEET_ROWS,
    ).csv(folder)
    return folder


def sheet_ingest(sheet: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = read_sheet(spark, _export_sheet(spark, sf_dir, sheet))
        return _plain_times(clean.clean_sheet(raw, SHEETS[sheet][1], RUN_TS))

    return query


def _new_tables(spark: SparkSession) -> Catalog:
    """Empty tables in schemas of their own, below the shared folder."""
    own = uuid.uuid4().hex[:12]
    catalog = Catalog(**{layer: f"{layer}_{own}" for layer in LAYERS})
    create_tables(spark, catalog, location=shared_folder(spark, "tables"))
    return catalog


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules sheet arriving as files, taken by a stream into the bronze table."""
    folder, catalog = _export_sheet(spark, sf_dir, "rules"), _new_tables(spark)
    jobs.ingest_stream(spark, folder, RULE, shared_folder(spark, "arrivals-checkpoint"), catalog, run_ts=RUN_TS)
    return _plain_times(read_table(spark, catalog, "bronze", RULE.table))


def sheet_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules sheet with a cell missing or too many in some rows: what the ingest keeps of these."""
    names = [c for c in RULES.names if c != STAMP]
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in names]
    full, short = F.concat_ws(",", *cells), F.concat_ws(",", *cells[:-1])
    line = F.when(F.col(RULE_ID).endswith("7"), short).when(F.col(RULE_ID).endswith("31"), F.concat(full, F.lit(",extra"))).otherwise(full)
    first_of_file = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = ",".join(f'"{h}"' for h in _typed("rules").values()) + "\n"
    folder, catalog = shared_folder(spark, "sheet-rejects"), _new_tables(spark)
    text = F.concat(F.when(first_of_file, F.lit(header)).otherwise(""), line)
    spark_view(spark, sf_dir, "fx_rules").select(text).write.text(folder)
    jobs.ingest_sheet(spark, folder, RULE, catalog, run_ts=RUN_TS)
    rejects = read_table(spark, catalog, "bronze", REJECTED_TABLE)
    return _plain_times(rejects.select("tabla", "motivo", "contenido", STAMP))


def _filled_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """Bronze tables with the sheets and the concepts entered by hand."""
    catalog = _new_tables(spark)
    for sheet, (_, entity) in SHEETS.items():
        jobs.ingest_sheet(spark, _export_sheet(spark, sf_dir, sheet), entity, catalog, run_ts=RUN_TS)
    write_table(spark_view(spark, sf_dir, "fx_custom"), catalog, "bronze", "app_custom_concepts")
    return catalog


def job_table(table: str) -> Query:
    """Sheets to bronze, bronze to silver, silver to golden, all as tables; returns a golden one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = _filled_tables(spark, sf_dir)
        jobs.build_silver(spark, catalog, RUN_TS)
        jobs.build_golden(spark, catalog, RUN_TS)
        return _plain_times(read_table(spark, catalog, "golden", table))

    return query


def job_dashboard(figure: str) -> Query:
    """One of the dashboard's figures, computed by its job over the tables."""
    return lambda spark, sf_dir: jobs.dashboard(spark, _filled_tables(spark, sf_dir))[figure]


def bronze_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.nullify_tokens(spark_view(spark, sf_dir, "fx_sheet"))


def bronze_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_blank_rows(bronze_null_tokens(spark, sf_dir))


def bronze_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark_view(spark, sf_dir, "fx_rules")
    return clean.parse_numbers(rules, THRESHOLDS).select(RULE_ID, *THRESHOLDS)


def bronze_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.stamp(bronze_blank_rows(spark, sf_dir), F.lit(RUN_TS))
    return _plain_times(clean.conform(rows, TRACE))


# --- silver -------------------------------------------------------------------


def silver_filter_keys(bronze: Bronze) -> DataFrame:
    kept = {
        "concepts": silver.usable_concepts(bronze.concepts).select(F.col(CODE).alias("clave"), TERM),
        "rules": silver.usable_rules(bronze.rules).select(F.col(RULE_ID).alias("clave"), TERM),
        "trace": silver.usable_trace(bronze.trace).select(
            F.col(CODE).alias("clave"), F.lit(None).cast("string").alias(TERM)
        ),
    }
    return metrics.stack([df.select(F.lit(name).alias("tabla"), "*") for name, df in kept.items()])


def silver_numeric_key(bronze: Bronze) -> DataFrame:
    both = [silver.usable_concepts(bronze.concepts), silver.usable_trace(bronze.trace)]
    return metrics.stack([df.select(CODE, numeric_id(F.col(CODE)).alias("id_num")) for df in both])


def silver_union_custom(bronze: Bronze) -> DataFrame:
    return bronze.concept_rows.select(
        CODE, "concepto_de_negocio", TERM, DOMAIN, SUBDOMAIN, *FLAGS, PRIORITY, "is_custom_concept",
        F.col(silver.ID).alias("id_num"),
    )


def silver_join_trace(bronze: Bronze) -> DataFrame:
    joined = silver.join_trace(bronze.concept_rows.select(CODE, silver.ID), bronze.trace)
    return joined.select(CODE, *silver.LINEAGE_COLUMNS.values(), "fecha_actualizacion_diccionario", "has_trace")


def silver_join_rules(bronze: Bronze) -> DataFrame:
    base = bronze.concept_rows.select(CODE, TERM, silver.ID)
    joined = silver.join_trace_and_rules(base, bronze.trace, bronze.rules)
    return joined.select(CODE, TERM, RULE_ID, *THRESHOLDS, "tabla_en_fuente_oficial", "has_trace")


# --- golden ---------------------------------------------------------------------


def golden_defaults(bronze: Bronze) -> DataFrame:
    return golden.fill_defaults(bronze.concept_rows).select(CODE, DOMAIN, SUBDOMAIN, PRIORITY, *FLAGS)


def golden_flags(bronze: Bronze) -> DataFrame:
    return golden.golden_rows(bronze.concept_rows).select(CODE, *FLAGS)


# --- maintenance ----------------------------------------------------------------


def _bronze_tables(bronze: Bronze) -> dict[str, DataFrame]:
    return {CONCEPT.table: bronze.concepts, RULE.table: bronze.rules, LINEAGE.table: bronze.trace}


def _inserted(bronze: Bronze) -> DataFrame:
    return changes.apply_inserts(bronze.concepts, bronze.view("fx_inserts"), CONCEPT, RUN_TS)


def _updated(bronze: Bronze) -> DataFrame:
    return changes.apply_updates(bronze.concepts, bronze.view("fx_updates"), CONCEPT, "seq", RUN_TS)


def change_insert_rules(bronze: Bronze) -> DataFrame:
    table = bronze.rules
    new = bronze.view("fx_rule_edits").withColumn(RULE_ID, F.concat(F.lit("NR"), F.col("seq").cast("string")))
    return changes.apply_inserts(table, new, RULE, RUN_TS)


def _new_trace(bronze: Bronze) -> DataFrame:
    return bronze.view("fx_inserts").select(
        CODE,
        F.col("concepto_de_negocio").alias("nombre_de_entidad_del_dato"),
        F.col(DOMAIN).alias("aplicativos"),
        F.lit(" ").alias("fuente_oficial"),
    )


def change_insert_trace(bronze: Bronze) -> DataFrame:
    return changes.apply_inserts(bronze.trace, _new_trace(bronze), LINEAGE, RUN_TS)


def change_validate_trace(bronze: Bronze) -> DataFrame:
    return changes.check_changes(_new_trace(bronze), LINEAGE).select(
        F.col(CODE).alias("clave"), "aplicativos", "accepted",
        *[F.array_join(c, ",").alias(c) for c in ("missing_fields", "bad_values")],
    )


def change_update_rules(bronze: Bronze) -> DataFrame:
    return changes.apply_updates(bronze.rules, bronze.view("fx_rule_edits"), RULE, "seq", RUN_TS)


def _concept_edits(bronze: Bronze) -> DataFrame:
    return bronze.view("fx_updates")


def _new_concepts(bronze: Bronze) -> DataFrame:
    return bronze.view("fx_inserts")


def _trace_edits(bronze: Bronze) -> DataFrame:
    return bronze.view("fx_updates").select(
        F.concat(F.lit("POL"), numeric_id(F.trim(CODE)).cast("string")).alias(CODE),
        F.col("concepto_de_negocio").alias("nombre_de_entidad_del_dato"),
        F.lit("APP").alias("aplicativos"),
        F.col(TERM).alias("fuente_oficial"),
        F.lit("T").alias("tabla_en_fuente_oficial"),
        F.lit(None).cast("string").alias("campo_en_fuente_oficial"),
        "data_owner",
        F.col(PRIORITY).alias("periodicidad_de_actualizacion"),
        "seq",
    )


def change_update_trace(bronze: Bronze) -> DataFrame:
    return changes.apply_updates(bronze.trace, _trace_edits(bronze), LINEAGE, "seq", RUN_TS)


def _supplier_number(bronze: Bronze) -> tuple[DataFrame, Column]:
    """One row per supplier and its number, null where the supplier has no code."""
    return bronze.view("fx_custom"), numeric_id(F.col(CODE)).cast("string")


def _deleted_concepts(bronze: Bronze) -> DataFrame:
    suppliers, number = _supplier_number(bronze)
    return suppliers.select(F.concat(F.lit(" CRM"), F.lpad(number, 9, "0")).alias(CODE))


def change_delete(bronze: Bronze) -> DataFrame:
    return changes.apply_deletes(bronze.concepts, _deleted_concepts(bronze), CONCEPT)


def _deleted_rules(bronze: Bronze) -> DataFrame:
    suppliers, number = _supplier_number(bronze)
    return suppliers.select(F.concat(F.lit("RC"), number).alias(RULE_ID))


def change_delete_rules(bronze: Bronze) -> DataFrame:
    return changes.apply_deletes(bronze.rules, _deleted_rules(bronze), RULE)


def _deleted_trace(bronze: Bronze) -> DataFrame:
    suppliers, number = _supplier_number(bronze)
    return suppliers.select(F.concat(F.lit("POL"), number).alias(CODE))


def change_delete_trace(bronze: Bronze) -> DataFrame:
    return changes.apply_deletes(bronze.trace, _deleted_trace(bronze), LINEAGE)


def _changed_table(entity, rows: str, **batches: str) -> Query:
    """A bronze table with the mapped rows, changed by a job that writes only the buckets it touches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bronze, catalog = Bronze(spark, sf_dir), _new_tables(spark)
        write_table(getattr(bronze, rows), catalog, "bronze", entity.table)
        made = {kind: globals()[name](bronze) for kind, name in batches.items()}
        jobs.change_bronze(spark, entity, catalog, run_ts=RUN_TS, **made)
        return _plain_times(read_table(spark, catalog, "bronze", entity.table))

    return query


def change_validate(bronze: Bronze) -> DataFrame:
    concepts = changes.check_changes(bronze.view("fx_inserts"), CONCEPT).select(
        F.lit(CONCEPT.table).alias("tabla"), F.col(CODE).alias("clave"), "missing_fields", "bad_values", "accepted"
    )
    rules = changes.check_changes(bronze.view("fx_rule_edits"), RULE).select(
        F.lit(RULE.table).alias("tabla"), F.col(RULE_ID).alias("clave"), "missing_fields", "bad_values", "accepted"
    )
    return concepts.unionByName(rules).withColumns(
        {c: F.array_join(c, ",") for c in ("missing_fields", "bad_values")}
    )


def change_values(bronze: Bronze) -> DataFrame:
    """Form values as they would be stored: stripped, blank to null, numbers parsed."""
    return changes.form_values(bronze.view("fx_rule_edits"), RULE, RULE.insertable).select(
        "seq", *[c for c in RULE.insertable if c != "data_owner"]
    )


# --- versions -------------------------------------------------------------------


def _after(bronze: Bronze) -> DataFrame:
    """Concepts after the update, delete and insert batches."""
    new = changes.apply_deletes(_updated(bronze), _deleted_concepts(bronze), CONCEPT)
    return changes.apply_inserts(new, bronze.view("fx_inserts"), CONCEPT, RUN_TS)


def _diff(bronze: Bronze) -> DataFrame:
    return versions.snapshot_diff(bronze.concepts, _after(bronze), CODE)


def _flat_diff(diff: DataFrame) -> DataFrame:
    both = [
        F.col(f"{side}.{c}").cast("timestamp_ntz" if c == STAMP else "string").alias(f"{side}_{c}")
        for c in CONCEPTS.names for side in ("before", "after")
    ]
    return diff.select(CODE, "change", "copies", F.array_join("changed_columns", ",").alias("changed_columns"), *both)


def snapshot_diff(bronze: Bronze) -> DataFrame:
    return _flat_diff(_diff(bronze))


def history(bronze: Bronze) -> DataFrame:
    return versions.history(bronze.view("fx_versions"), CODE, STAMP)


def history_as_of(bronze: Bronze) -> DataFrame:
    return versions.as_of(bronze.view("fx_versions"), CODE, STAMP, F.lit(AS_OF).cast("timestamp_ntz"))


def _marked_versions(bronze: Bronze) -> DataFrame:
    """The versions, some of them end marks."""
    return bronze.view("fx_versions").withColumn("fin", F.col("event_id") % 13 == 0)


def history_ended(bronze: Bronze) -> DataFrame:
    return versions.history(_marked_versions(bronze), CODE, STAMP, deleted="fin")


def history_as_of_many(bronze: Bronze) -> DataFrame:
    """For each version the one of its key that was valid some hours later; at none for ties."""
    asked = bronze.view("fx_versions").select(
        F.col("event_id").alias("peticion"),
        CODE,
        F.expr(f"{STAMP} + make_interval(0, 0, 0, 0, cast(event_id % 3 as int))").alias("momento"),
    )
    return versions.as_of_many(_marked_versions(bronze), asked, CODE, STAMP, "momento", deleted="fin")


def _steps(bronze: Bronze) -> list[DataFrame]:
    """Concepts before and after each of three batches."""
    edited = _updated(bronze)
    return [bronze.concepts, edited, changes.apply_deletes(edited, _deleted_concepts(bronze), CONCEPT), _after(bronze)]


def _written_log(bronze: Bronze) -> tuple[list[DataFrame], str]:
    steps, log = _steps(bronze), shared_folder(bronze.concepts.sparkSession, "change-log")
    for number, (old, new) in enumerate(zip(steps, steps[1:]), 1):
        changelog.append_changes(versions.snapshot_diff(old, new, CODE), log, number, RUN_TS)
    return steps, log


def log_replayed(bronze: Bronze) -> DataFrame:
    steps, log = _written_log(bronze)
    return changelog.replayed(steps[0], changelog.read_changes(steps[0].sparkSession, log))


def log_rolled_back(bronze: Bronze) -> DataFrame:
    """Back to the snapshot after the first batch."""
    steps, log = _written_log(bronze)
    return changelog.rolled_back(steps[-1], changelog.read_changes(steps[0].sparkSession, log, after=1))


def log_folded(bronze: Bronze) -> DataFrame:
    steps, log = _written_log(bronze)
    return _flat_diff(changelog.folded(changelog.read_changes(steps[0].sparkSession, log), CODE))


def _refreshed_state(bronze: Bronze) -> DataFrame:
    """The state of the golden tables, brought up to date with batches of changes to three tables."""
    trace = changes.apply_deletes(change_update_trace(bronze), _deleted_trace(bronze), LINEAGE)
    # Read several times; of the trace table only the first reads more than the codes.
    now = {"concepts": stored(_after(bronze), "concepts-now"), "rules": stored(change_update_rules(bronze), "rules-now"), "trace": trace}
    diffs = {
        name: versions.snapshot_diff(getattr(bronze, name), rows, key)
        for (name, rows), key in zip(now.items(), (CODE, RULE_ID, CODE))
    }
    state = stored(incremental.code_state(bronze.coverage), "state")
    return incremental.refreshed(state, custom=bronze.custom, diffs=diffs, **now)


def lineage_reverse(bronze: Bronze) -> DataFrame:
    """From every source field in the trace back to the concepts that use it."""
    fields = bronze.trace.select(
        F.col("tabla_en_fuente_oficial").alias("tabla"), F.col("campo_en_fuente_oficial").alias("campo")
    )
    return metrics.codes_of_sources(fields, bronze.trace, bronze.concepts)


QUERIES: dict[str, Query] = {
    "sheet_concepts": sheet_ingest("concepts"),
    "sheet_rules": sheet_ingest("rules"),
    "sheet_trace": sheet_ingest("trace"),
    "sheet_rejects": sheet_rejects,
    "bronze_null_tokens": bronze_null_tokens,
    "bronze_blank_rows": bronze_blank_rows,
    "bronze_thresholds": bronze_thresholds,
    "bronze_conform": bronze_conform,
    "silver_filter_keys": _on_bronze(silver_filter_keys),
    "silver_numeric_key": _on_bronze(silver_numeric_key),
    "silver_union_custom": _on_bronze(silver_union_custom),
    "silver_join_trace": _on_bronze(silver_join_trace),
    "silver_join_rules": _on_bronze(silver_join_rules),
    "silver_full": _on_bronze(lambda b: b.silver),
    "golden_defaults": _on_bronze(golden_defaults),
    "golden_flags": _on_bronze(golden_flags),
    "golden_quality_report": _on_bronze(lambda b: golden.quality_report(b.silver, RUN_TS)),
    "golden_quality_report_eager": _on_bronze(lambda b: golden.quality_report_eager(b.coverage, RUN_TS)),
    "golden_quality_report_distinct_rules": _on_bronze(
        lambda b: golden.quality_report(b.silver, RUN_TS, distinct_rules=True)
    ),
    "golden_priority": _on_bronze(lambda b: golden.priority_summary(b.silver, RUN_TS)),
    "kpi_counts": _on_bronze(lambda b: metrics.kpi_counts(_bronze_tables(b))),
    "top_domains": _on_bronze(lambda b: metrics.top_domains(b.concepts)),
    "top_principles": _on_bronze(lambda b: metrics.top_principles(b.rules)),
    "latest_records": _on_bronze(
        lambda b: metrics.latest_records(b.concepts, limit=LATEST)
    ),
    "latest_records_all": _on_bronze(lambda b: metrics.latest_records(b.concepts)),
    "change_insert": _on_bronze(lambda b: _inserted(b)),
    "change_insert_rules": _on_bronze(change_insert_rules),
    "change_insert_trace": _on_bronze(change_insert_trace),
    "change_update": _on_bronze(lambda b: _updated(b)),
    "change_update_rules": _on_bronze(change_update_rules),
    "change_update_trace": _on_bronze(change_update_trace),
    "change_delete": _on_bronze(change_delete),
    "change_delete_rules": _on_bronze(change_delete_rules),
    "change_delete_trace": _on_bronze(change_delete_trace),
    "change_update_table": _changed_table(CONCEPT, "concepts", updates="_concept_edits"),
    "change_update_table_trace": _changed_table(LINEAGE, "trace", updates="_trace_edits"),
    "change_delete_table_rules": _changed_table(RULE, "rules", deletes="_deleted_rules"),
    "change_batch_table": _changed_table(
        CONCEPT, "concepts", updates="_concept_edits", deletes="_deleted_concepts", inserts="_new_concepts"
    ),
    "change_validate": _on_bronze(change_validate),
    "change_validate_trace": _on_bronze(change_validate_trace),
    "change_values": _on_bronze(change_values),
    "dash_totals": _on_bronze(lambda b: metrics.dashboard_totals(b.coverage)),
    "dash_flags_by_domain": _on_bronze(lambda b: metrics.flags_by_domain(b.coverage)),
    "dash_priority_share": _on_bronze(lambda b: metrics.priority_share(b.concept_rows)),
    "dash_rules_by_principle": _on_bronze(lambda b: metrics.rules_by_principle(b.concept_rows, b.rules)),
    "dash_completeness": _on_bronze(lambda b: metrics.completeness(b.coverage)),
    "dash_last_update": _on_bronze(lambda b: metrics.last_update(_bronze_tables(b))),
    "newest_rows": _on_bronze(lambda b: metrics.newest_rows(b.concepts, CODE)),
    "lineage_forward": _on_bronze(lambda b: metrics.lineage_of_codes(b.concepts, b.trace)),
    "lineage_reverse": _on_bronze(lineage_reverse),
    "dedup_concepts": _on_bronze(
        lambda b: versions.dedup_concepts(b.concepts, CODE, [STAMP])
    ),
    "snapshot_diff": _on_bronze(snapshot_diff),
    "diff_applied": _on_bronze(lambda b: versions.apply_diff(b.concepts, _diff(b))),
    "diff_reverted": _on_bronze(lambda b: versions.revert_diff(_after(b), _diff(b))),
    "job_golden_report": job_table("reporte_calidad_conceptos"),
    "job_golden_priority": job_table("resumen_prioridad_dominio"),
    "job_dashboard_totals": job_dashboard("totals"),
    "job_dashboard_completeness": job_dashboard("completeness"),
    "history": _on_bronze(history),
    "history_as_of": _on_bronze(history_as_of),
    "history_ended": _on_bronze(history_ended),
    "history_as_of_many": _on_bronze(history_as_of_many),
    "log_replayed": _on_bronze(log_replayed),
    "log_rolled_back": _on_bronze(log_rolled_back),
    "log_folded": _on_bronze(log_folded),
    "golden_incremental": _on_bronze(lambda b: incremental.quality_report_of(_refreshed_state(b), RUN_TS)),
    "golden_incremental_priority": _on_bronze(lambda b: incremental.priority_summary_of(_refreshed_state(b), RUN_TS)),
    "stream_ingest": stream_ingest,
}
