"""Exported dictionary sheets: folders of CSV, JSON or Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import column
from ..session import stored


def text_schema(headers: list[str]) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType()) for h in headers])


REJECT = "_reject"


def _csv_options(multi_line: bool, mode: str) -> dict[str, str]:
    # The header of every file is compared with the schema: a file with other
    # or differently ordered columns fails instead of being read by position.
    # All columns are parsed, since only then are missing and surplus cells seen.
    return {
        "header": "true",
        "enforceSchema": "false",
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "mode": mode,
        "columnPruning": "false",
        "columnNameOfCorruptRecord": REJECT,
    }


def _headers(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> list[str]:
    if fmt == "json":
        raise ValueError("a JSON sheet has no header line: give its headers")
    options = _csv_options(multi_line, "PERMISSIVE") if fmt == "csv" else {}
    return spark.read.options(**options).format(fmt).load(path).columns


def read_sheet(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    headers: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """All columns as text, headers untouched. A row with missing or surplus cells fails the read.

    CSV cells may hold line breaks, so a CSV file is read by one task; large
    exports should be Parquet, or CSV with ``multi_line=False`` if no cell has
    any. Parquet keeps its own types until they are cast here. JSON needs headers.
    """
    return _as_text(_reader(spark.read, spark, path, fmt, headers, multi_line, "FAILFAST").format(fmt).load(path))


def read_sheet_rows(
    spark: SparkSession, path: str, headers: list[str] | None = None, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows of a CSV sheet, and the others as text in the column ``_reject``.

    The files are parsed once, into the shared folder.
    """
    reader = _reader(spark.read, spark, path, "csv", headers, multi_line, "PERMISSIVE", rejects=True)
    parsed = reader.csv(path)
    names = [c for c in parsed.columns if c != REJECT]
    # Positions for names: Parquet allows fewer signs in them than a sheet.
    plain = parsed.toDF(*[f"c{i}" if c != REJECT else REJECT for i, c in enumerate(parsed.columns)])
    rows = stored(plain, "sheet")
    good = rows.filter(F.col(REJECT).isNull()).drop(REJECT).toDF(*names)
    return good, rows.filter(F.col(REJECT).isNotNull()).select(REJECT)


def _reader(reader, spark, path, fmt, headers, multi_line, mode, rejects=False):
    if fmt == "csv":
        reader = reader.options(**_csv_options(multi_line, mode))
    if fmt != "parquet":
        schema = text_schema(headers or _headers(spark, path, fmt, multi_line))
        reader = reader.schema(schema.add(REJECT, "string") if rejects else schema)
    return reader


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[column(c).cast("string").alias(c) for c in df.columns])


def stream_sheet(
    spark: SparkSession,
    path: str,
    headers: list[str] | None = None,
    fmt: str = "csv",
    multi_line: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same files as a stream: each new file is read once.

    Without headers, those of the files now present count (for Parquet, their
    types too); an empty folder then is an error.
    """
    reader = _reader(spark.readStream, spark, path, fmt, headers, multi_line, "FAILFAST")
    if fmt == "parquet":
        reader = reader.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _as_text(reader.format(fmt).load(path))
