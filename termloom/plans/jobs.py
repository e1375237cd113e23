"""The jobs a scheduler calls: sheets to bronze, bronze to silver, silver to golden."""

from __future__ import annotations

import uuid
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_text
from ..operators.changes import apply_deletes, apply_inserts, apply_updates
from ..operators.clean import clean_sheet
from ..schemas import REJECTED_TABLE, Entity
from ..session import stored, working_folders
from ..sources.records import first_headers, lines_of, read_records, sheet_and_rejects
from ..sources.sheets import read_sheet
from ..sources.tables import Catalog, TouchedBuckets, bucket_count, read_table, rewrite_table, write_table
from ..streaming.arrivals import append_to_bronze, arriving_rows, write_rejects
from .golden import priority_summary, quality_report
from . import metrics
from .silver import all_concepts, coverage, silver


class Ingested(NamedTuple):
    """Records of a sheet without its header, and what became of them; ``dropped`` were blank or the legend."""

    records: int
    loaded: int
    rejected: int
    dropped: int


def ingest_sheet(
    spark: SparkSession,
    path: str,
    entity: Entity,
    catalog: Catalog = Catalog(),
    fmt: str = "csv",
    mode: str = "overwrite",
    run_ts: datetime | None = None,
    multi_line: bool = True,
    headers: list[str] | None = None,
) -> Ingested | None:
    """A sheet folder into its bronze table. ``overwrite`` also replaces rows entered by hand.

    CSV is cut into records by many tasks, and malformed records go to the table of rejected rows. Other
    formats, and CSV with ``multi_line=False``, fail on a malformed row and are not counted.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    overwrite = mode == "overwrite"
    if fmt != "csv" or not multi_line:
        rows = clean_sheet(read_sheet(spark, path, fmt, headers, multi_line), entity, run_ts)
        write_table(rows, catalog, "bronze", entity.table, overwrite)
        return None
    with working_folders(spark):
        raw, rejects = read_records(spark, path, headers)
        records, rejected = raw.count(), rejects.count()
        loaded = Observation()
        rows = clean_sheet(raw, entity, run_ts).observe(loaded, F.count(F.lit(1)).alias("rows"))
        if rejected:
            write_rejects(rejects, entity, catalog, uuid.uuid4().hex, run_ts)
        write_table(rows, catalog, "bronze", entity.table, overwrite)
        taken = loaded.get["rows"]
    return Ingested(records + rejected, taken, rejected, records - taken)


def ingest_stream(
    spark: SparkSession,
    folder: str,
    entity: Entity,
    checkpoint: str,
    catalog: Catalog = Catalog(),
    fmt: str = "csv",
    run_ts: datetime | None = None,
    headers: list[str] | None = None,
    multi_line: bool = True,
    max_files_per_trigger: int | None = None,
) -> None:
    """All files not yet taken, into the bronze table, each once; returns when they are in.

    CSV is cut and its malformed records are kept as in ``ingest_sheet``.
    """
    if fmt == "csv" and multi_line:
        names = headers or first_headers(spark, folder)
        reader = spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

        def prepare(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
            raw, rejects = sheet_and_rejects(batch, names)
            return clean_sheet(raw, entity, run_ts), rejects

        query = append_to_bronze(lines_of(reader, folder), entity, catalog, checkpoint, prepare)
    else:
        rows = arriving_rows(spark, folder, entity, headers, fmt, run_ts, max_files_per_trigger, multi_line)
        query = append_to_bronze(rows, entity, catalog, checkpoint)
    query.awaitTermination()
    # The stream writes in a session of its own; this one may still know the old files.
    for table in (entity.table, REJECTED_TABLE):
        spark.catalog.refreshTable(catalog.table_name("bronze", table))


def build_silver(spark: SparkSession, catalog: Catalog = Catalog(), run_ts: datetime | None = None) -> None:
    bronze = {
        name: read_table(spark, catalog, "bronze", table)
        for name, table in {
            "concepts": "conceptos_negocio",
            "rules": "reglas_calidad",
            "trace": "trazabilidad",
            "custom": "app_custom_concepts",
        }.items()
    }
    with working_folders(spark):
        write_table(silver(**bronze, run_ts=run_ts), catalog, "silver", "conceptos_calidad_trazabilidad")


def build_golden(spark: SparkSession, catalog: Catalog = Catalog(), run_ts: datetime | None = None) -> None:
    rows = read_table(spark, catalog, "silver", "conceptos_calidad_trazabilidad")
    write_table(quality_report(rows, run_ts), catalog, "golden", "reporte_calidad_conceptos")
    write_table(priority_summary(rows, run_ts), catalog, "golden", "resumen_prioridad_dominio")


def dashboard(spark: SparkSession, catalog: Catalog = Catalog()) -> dict[str, DataFrame]:
    """The dashboard's figures over the bronze tables; what several of them need is computed once."""
    concepts, rules, trace, custom = (
        read_table(spark, catalog, "bronze", table)
        for table in ("conceptos_negocio", "reglas_calidad", "trazabilidad", "app_custom_concepts")
    )
    covered = stored(coverage(concepts, rules, trace, custom), "coverage")
    everything = all_concepts(concepts, custom)
    return {
        "totals": metrics.dashboard_totals(covered),
        "flags_by_domain": metrics.flags_by_domain(covered),
        "completeness": metrics.completeness(covered),
        "priority_share": metrics.priority_share(everything),
        "rules_by_principle": metrics.rules_by_principle(everything, rules),
    }


def change_bronze(
    spark: SparkSession,
    entity: Entity,
    catalog: Catalog = Catalog(),
    inserts: DataFrame | None = None,
    updates: DataFrame | None = None,
    deletes: DataFrame | None = None,
    sequence: str = "seq",
    run_ts: datetime | None = None,
) -> None:
    """Apply a batch to a bronze table: deletes, then updates, then inserts.

    Only the buckets of the batch's keys are read and written, once. The batch is written down first, so that the
    buckets and the changes come from the same rows. A table without buckets is rewritten whole.
    """
    table = read_table(spark, catalog, "bronze", entity.table)
    if deletes is None and updates is None:
        if inserts is not None:
            new = apply_inserts(table.limit(0), inserts, entity, run_ts)
            write_table(new, catalog, "bronze", entity.table, overwrite=False)
        return
    with working_folders(spark):
        deletes, updates, inserts = (
            None if batch is None else stored(batch, f"changes-{name}")
            for name, batch in (("deletes", deletes), ("updates", updates), ("inserts", inserts))
        )
        place = None
        if bucket_count(spark, catalog.table_name("bronze", entity.table)):
            keys = [
                batch.select(clean_text(F.col(entity.key).cast("string")))
                for batch in (deletes, updates, inserts)
                if batch is not None and entity.key in batch.columns
            ]
            place = TouchedBuckets(spark, catalog, entity.table, keys)
        rows = place.rows() if place else table
        if deletes is not None:
            rows = apply_deletes(rows, deletes, entity)
        if updates is not None:
            rows = apply_updates(rows, updates, entity, sequence, run_ts)
        if inserts is not None:
            rows = apply_inserts(rows, inserts, entity, run_ts)
        if place:
            place.replace(rows)
        else:
            rewrite_table(rows, catalog, "bronze", entity.table)
