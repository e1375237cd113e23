"""Incremental arrival of sheet files, each cleaned and in bronze once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean_sheet, stamp
from ..schemas import REJECTED_TABLE, Entity
from ..sources.sheets import stream_sheet
from ..sources.tables import Catalog, write_table


def arriving_rows(
    spark: SparkSession,
    folder: str,
    entity: Entity,
    headers: list[str] | None = None,
    fmt: str = "csv",
    run_ts: datetime | None = None,
    max_files_per_trigger: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Streaming frame of clean bronze rows. Headers default to those now in the folder."""
    raw = stream_sheet(spark, folder, headers, fmt, multi_line, max_files_per_trigger)
    return clean_sheet(raw, entity, run_ts)


def append_arrivals(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Start a run over all files not yet taken. Same checkpoint, same file: once only."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_to_bronze(
    stream: DataFrame,
    entity: Entity,
    catalog: Catalog,
    checkpoint: str,
    prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None,
) -> StreamingQuery:
    """The same into the entity's bronze table. ``prepare`` makes each batch's clean rows and its rejects.

    Each batch of files is a load of its own in the table, and in that of rejected rows, named by the stream and the
    batch's number. A batch that is run again, after a failure between its insert and its checkpoint, holds the same files
    and replaces its own load, so each row is in the table once.
    """
    def commit(batch: DataFrame, number: int) -> None:
        load = f"{_stream_id(batch.sparkSession, checkpoint)}-{number}"
        rows, rejects = prepare(batch) if prepare else (batch, None)
        if rejects is not None:
            write_rejects(rejects, entity, catalog, load)
        write_table(rows, catalog, "bronze", entity.table, load=load)

    return (
        stream.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_rejects(rejects: DataFrame, entity: Entity, catalog: Catalog, load: str, run_ts: datetime | None = None) -> None:
    """Rejected rows of a sheet into the table that keeps them, once for each load."""
    rows = stamp(rejects.select(F.lit(entity.table).alias("tabla"), "*"), run_ts)
    write_table(rows, catalog, "bronze", REJECTED_TABLE, load=f"{entity.table}-{load}")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What Spark calls the stream of a checkpoint, from its first start on."""
    return json.loads(spark.read.text(os.path.join(checkpoint, "metadata")).first().value)["id"]
