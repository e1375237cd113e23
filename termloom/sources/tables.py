"""The tables: creation, reading, writing by position, and rewriting only what a batch touches.

Bronze tables have two partition columns beside their contract, which ``read_table`` leaves out. ``_load`` names what brought a row:
``base``, or one batch of a stream, so that a batch written again replaces itself. ``_bucket`` is a hash of the
row's key, so that a batch of changes reads and writes the buckets of its keys and nothing else.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import conform
from ..schemas import KEYS, LAYERS, TABLES
from ..session import compiled_methods, smaller_tasks

LOAD, BUCKET = "_load", "_bucket"
BASE = "base"
BUCKETS = 64
BUCKET_PROPERTY = "termloom.buckets"
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Catalog:
    """Where the tables live; any part may be renamed per deployment."""

    name: str | None = None
    raw: str = "raw"
    bronze: str = "bronze"
    silver: str = "silver"
    golden: str = "golden"

    def schema_name(self, layer: str) -> str:
        return ".".join(f"`{part}`" for part in (self.name, getattr(self, layer)) if part)

    def table_name(self, layer: str, table: str) -> str:
        return f"{self.schema_name(layer)}.`{table}`"


def create_tables(
    spark: SparkSession,
    catalog: Catalog = Catalog(),
    fmt: str = "parquet",
    location: str | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Create the missing schemas and tables; existing ones are left alone.

    New schemas lie below ``location``, if given. ``buckets`` should grow with the tables, so that one is a few
    files: changes rewrite whole buckets.
    """
    for layer in LAYERS:
        where = f" LOCATION '{location}/{getattr(catalog, layer)}'" if location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {catalog.schema_name(layer)}{where}")
    for (layer, table), schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        layout = ""
        if layer == "bronze":
            columns += f", `{LOAD}` string, `{BUCKET}` int"
            layout = f" PARTITIONED BY (`{LOAD}`, `{BUCKET}`) TBLPROPERTIES ('{BUCKET_PROPERTY}' = '{buckets}')"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {catalog.table_name(layer, table)} ({columns}) USING {fmt}{layout}")


def read_table(spark: SparkSession, catalog: Catalog, layer: str, table: str) -> DataFrame:
    """The columns of the contract."""
    return spark.table(catalog.table_name(layer, table)).select(*TABLES[layer, table].names)


def bucket_count(spark: SparkSession, name: str) -> int | None:
    """How many buckets a table has; None for one without them."""
    if not {LOAD, BUCKET} <= set(spark.table(name).columns):
        return None
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return int(properties[BUCKET_PROPERTY])


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@contextmanager
def _overwriting(spark: SparkSession, mode: str) -> Iterator[None]:
    """Whether an overwriting insert replaces the partitions that it writes (dynamic) or the table (static)."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, mode)
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def _laid_out(rows: DataFrame, load: str | Column, key: str, buckets: int) -> DataFrame:
    """The rows with their partition columns, dealt so that a partition is few files and a large one several tasks.

    Files are in the order of the key. The write sorts by partition anyway, and rows of one key pack well side by side, in
    the files and in the shuffles of the jobs that read them.
    """
    one_load = isinstance(load, str)
    load = F.lit(load) if one_load else load
    dealt = rows.withColumns({LOAD: load, BUCKET: bucket_of(F.col(key), buckets)}).hint("rebalance", LOAD, BUCKET)
    # The write asks for no order by a constant, and would replace one that begins with it.
    return dealt.sortWithinPartitions(*([] if one_load else [LOAD]), BUCKET, key)


def write_table(
    df: DataFrame, catalog: Catalog, layer: str, table: str, overwrite: bool = True, load: str | None = None
) -> None:
    """Columns are put in the table's order first, since the insert goes by position.

    With ``load``, the rows replace those of an earlier write with that name, and nothing else: writing a batch
    again changes nothing. That needs a table with the layout of ``create_tables``.
    """
    spark, name = df.sparkSession, catalog.table_name(layer, table)
    rows = conform(df, TABLES[layer, table])
    buckets = bucket_count(spark, name)
    if buckets:
        rows = _laid_out(rows, _load_name(load or BASE), KEYS[table], buckets)
    elif load:
        raise ValueError(f"{name} has no loads")
    with compiled_methods(spark), _overwriting(spark, "dynamic" if load else "static"):
        rows.write.insertInto(name, overwrite=overwrite or load is not None)


def _load_name(load: str) -> str:
    if not re.fullmatch(r"[\w.-]+", load):
        raise ValueError(f"{load!r} is no name of a load")
    return load


def rewrite_table(df: DataFrame, catalog: Catalog, layer: str, table: str, fmt: str = "parquet") -> None:
    """Overwrite a table without buckets with rows computed from that same table.

    The rows are first written to a table of their own, because a file table
    cannot be read and overwritten in one query. If the second step is lost,
    the written table still holds the complete result.
    """
    spark = df.sparkSession
    staged = catalog.table_name(layer, f"{table}__{uuid.uuid4().hex[:12]}")
    conform(df, TABLES[layer, table]).write.format(fmt).saveAsTable(staged)
    write_table(spark.table(staged), catalog, layer, table)
    spark.sql(f"DROP TABLE {staged}")


class TouchedBuckets:
    """The rows of a table that a batch of changes can touch, and their replacement in one write.

    ``keys``: frames of one column with the keys of the batch. Which buckets they touch is a list of at most as many numbers
    as the table has buckets. ``replace`` writes new rows over these buckets; files of others are neither read nor written. Spark
    writes beside the old files and exchanges them at the end. A partition of which no row is left has no new files and is dropped
    after that; if the job is lost in between, the same batch of updates and deletes can be run again.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, table: str, keys: list[DataFrame]):
        self.spark, self.table, self.name = spark, table, catalog.table_name("bronze", table)
        self.buckets = bucket_count(spark, self.name)
        if self.buckets is None:
            raise ValueError(f"{self.name} has no buckets")
        found: set[int] = set()
        for some in keys:
            key = F.col(some.columns[0])
            found |= {r.b for r in some.filter(key.isNotNull()).select(bucket_of(key, self.buckets).alias("b")).distinct().collect()}
        self.touched = sorted(found)

    def rows(self) -> DataFrame:
        """The rows now in these buckets, with their load."""
        rows = self.spark.table(self.name).filter(F.col(BUCKET).isin(self.touched))
        return rows.select(*TABLES["bronze", self.table].names, LOAD)

    def _files(self) -> set[str]:
        return set(self.spark.table(self.name).filter(F.col(BUCKET).isin(self.touched)).inputFiles())

    def replace(self, rows: DataFrame) -> None:
        """``rows``: what ``rows()`` became; a null load is ``base``. Every key must be in a touched bucket."""
        if not self.touched:
            return
        before = self._files()
        placed = conform(rows, rows.sparkSession.table(self.name).schema)
        placed = _laid_out(placed, F.coalesce(LOAD, F.lit(BASE)), KEYS[self.table], self.buckets)
        with compiled_methods(self.spark), smaller_tasks(self.spark), _overwriting(self.spark, "dynamic"):
            placed.write.insertInto(self.name, overwrite=True)
        kept = {re.search(rf"/{LOAD}=([^/]+)/{BUCKET}=(\d+)/", path).groups() for path in before & self._files()}
        for load, bucket in sorted(kept):
            self.spark.sql(
                f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (`{LOAD}` = '{load}', `{BUCKET}` = {bucket})"
            )
