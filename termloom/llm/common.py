"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import session

# What stands between words: the blank and the control characters 09 to 0D.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(stem: str, columns: list[str]) -> str:
    """The stem, lengthened until no column has that name in any case of letters."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# Rows hold whole texts, so batches that count rows must be small.
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 512}
ROW_GROUP_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets at most a few hundred rows at a time pass through Spark's columnar reader and to Python, in this session.

    The defaults are 4,096 and 10,000 rows, however long these are. Lower settings stay.
    """
    for name, rows in SMALL_BATCHES.items():
        if int(spark.conf.get(name)) > rows:
            spark.conf.set(name, str(rows))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back, so that what follows never computes it again.

    Row groups are small, since writers and readers hold a whole one.
    """
    return session.stored(df, purpose, **{"parquet.block.size": ROW_GROUP_BYTES})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python holds few texts at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def per_text(
    docs: DataFrame,
    compute: Callable[[list[str]], list[tuple]],
    columns: str,
    at_once: int = 256,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """``doc_id`` and the columns that ``compute`` makes of each text of a batch (null: empty), in Arrow batches.

    ``columns`` lists names and types (``long``, ``string``, ``binary``). ``doc_id`` passes as it is.
    ``compute`` gets ``at_once`` texts at a time. ``after`` is called at the end of each task.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pair.split() for pair in columns.split(",")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source, at_once):
            rows = compute([text or "" for text in batch.column("text").to_pylist()])
            made = [pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *made], names=["doc_id", *[name for name, _ in fields]]
            )
        if after:
            after()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, f"doc_id long, {columns}")
