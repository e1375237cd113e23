"""CSV sheets with line breaks inside of cells, cut into records by many tasks.

A quote opens or closes a cell, so a line begins a record if the quotes before it in its file are even in
number. Each byte range of a file counts its quotes; a sum over the ranges, one row for each, tells
every range whether it begins inside of a cell, at which line, and in which record. Ranges then cut their records side by side,
and only ranges with line breaks in cells are shuffled for that.
Only the lines of records with line breaks are brought together, a record at a time.

A cell that holds a quote must itself be quoted, its quotes doubled, as exports do. A quote that is never closed
would swallow the rest of its file: that record is reported with its first line alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import column
from ..session import stored

OPEN_QUOTE = "quote never closed"
OTHER_CELLS = "number of cells differs from the header"
_CELLS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_reject"}


def lines_of(reader, path: str) -> DataFrame:
    """file, block (where the byte range begins) and line of text files; for batch readers and stream readers."""
    return reader.format("text").option("lineSep", "\n").load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def _known_blocks(marked: DataFrame) -> DataFrame:
    """One row for each byte range: where its first line stands, and what the ranges before it carry over.

    Only lines that change between inside and outside of a cell are ordered within their range.
    """
    sizes = marked.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.min("_at").alias("_from"),
        F.when(F.col("block") == 0, F.min_by(F.col("line").endswith("\r"), "_at")).alias("_cr"),
    )
    turns = marked.filter("_odd = 1").select("file", "block", "_at").withColumn(
        "_before", (F.row_number().over(Window.partitionBy("file", "block").orderBy("_at")) - 1) % 2
    )
    turns = turns.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("_turns"),
        F.max(F.when(F.col("_before") == 0, F.col("_at"))).alias("_turn_even"),
        F.max(F.when(F.col("_before") == 1, F.col("_at"))).alias("_turn_odd"),
    )
    blocks = sizes.join(turns, ["file", "block"], "left").withColumn("_turns", F.coalesce("_turns", F.lit(0)))
    nr = lambda at: F.col(at) - F.col("_from") + 1
    # Behind the last turn all lines are on the side where it left them.
    behind = lambda side: F.when(F.col("_turns") % 2 == side, F.col("_lines"))
    turned = F.coalesce(F.greatest(nr("_turn_even"), nr("_turn_odd")), F.lit(0)) == F.col("_lines")
    last = {
        name: F.greatest(nr(at), F.when(~turned, behind(side)))
        for side, (name, at) in enumerate((("_last_even", "_turn_even"), ("_last_odd", "_turn_odd")))
    }
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.withColumns(last).select(
        "file",
        "block",
        "_lines",
        "_from",
        "_turns",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_above"),
        (F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2).alias("_open"),
        (F.sum("_turns").over(whole) % 2 == 1).alias("_file_open"),
        "_last_even",
        "_last_odd",
        F.max("_cr").over(whole).alias("_cr"),
    )
    start = F.col("_above") + F.when(F.col("_open") == 0, F.col("_last_even")).otherwise(F.col("_last_odd"))
    return known.withColumn("_last", start).select(
        "file",
        "block",
        "_lines",
        "_from",
        "_turns",
        "_above",
        "_open",
        "_cr",
        F.last("_last", ignorenulls=True).over(before).alias("_carried"),
        F.when(F.col("_file_open"), F.max("_last").over(whole)).alias("_unclosed"),
    )


def cut_records(lines: DataFrame) -> DataFrame:
    """file, line (number of the record's first line, from 1), record, closed.

    ``lines`` as ``lines_of`` gives them. Lines of a range without a line of odd quotes stay where they are read;
    those of other ranges are ordered within their range.
    """
    marked = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_odd", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))) % 2
    )
    # One row for each range, written down so that Spark knows how few they are and sends them to all tasks.
    blocks = stored(_known_blocks(marked), "ranges")
    nr = F.col("_at") - F.col("_from") + 1
    read_alike = F.coalesce((nr >= 1) & (nr <= F.col("_lines")), F.lit(False))
    placed = marked.join(blocks, ["file", "block"], "left").withColumn(
        "_number",
        F.when(read_alike, F.col("_above") + nr).otherwise(F.raise_error(F.lit("files or their ranges changed while they were read")).cast("bigint")),
    )
    closed = ~F.col("_first").eqNullSafe(F.col("_unclosed"))
    quiet = placed.filter(F.coalesce("_turns", F.lit(0)) == 0).withColumn("_starts", F.col("_open") == 0)
    quiet = quiet.withColumn("_first", F.when(F.col("_starts"), F.col("_number")).otherwise(F.col("_carried")))
    in_block = Window.partitionBy("file", "block").orderBy("_at")
    above = in_block.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turning = placed.filter("_turns > 0").withColumn(
        "_starts", (F.col("_open") + F.coalesce(F.sum("_odd").over(above), F.lit(0))) % 2 == 0
    )
    turning = turning.withColumn("_first", F.coalesce(F.max(F.when(F.col("_starts"), F.col("_number"))).over(so_far), "_carried"))
    numbered = quiet.unionByName(turning).withColumn("_closed", closed)
    alone = F.col("_starts") & (F.col("_odd") == 0) & F.col("_closed")
    short = numbered.filter(alone).select("file", F.col("_first").alias("line"), F.col("line").alias("record"), "_closed", "_cr")
    several = (
        numbered.filter(~alone)
        .groupBy("file", F.col("_first").alias("line"))
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_closed"), F.struct("_number", F.col("line"))))).alias("_rows"),
            F.min_by(F.col("line"), "_number").alias("_head"),
            F.first("_closed").alias("_closed"),
            F.first("_cr").alias("_cr"),
        )
        .select(
            "file",
            "line",
            F.when(F.col("_closed"), F.array_join(F.transform("_rows", lambda r: r["line"]), "\n")).otherwise(F.col("_head")).alias("record"),
            "_closed",
            "_cr",
        )
    )
    # Where the first line ends with a carriage return, that belongs to the line ends of the file.
    plain = F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    record = F.when(F.col("_cr"), plain).otherwise(F.col("record")).alias("record")
    return short.unionByName(several).select("file", "line", record, F.col("_closed").alias("closed"))


def parsed_records(records: DataFrame, width: int) -> DataFrame:
    """file, line, record, reason (null: well formed) and the cells c0, c1, ...; empty lines are no records."""
    names = [f"c{i}" for i in range(width)]
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in (*names, "_reject")), _CELLS)
    rows = records.filter(F.col("record") != "").withColumn("_cells", cells)
    reason = F.when(~F.col("closed"), OPEN_QUOTE).when(F.col("_cells._reject").isNotNull(), OTHER_CELLS)
    return rows.select("file", "line", "record", reason.alias("reason"), *[F.col(f"_cells.{n}").alias(n) for n in names])


def sheet_and_rejects(lines: DataFrame, headers: list[str]) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows under their headers, and the others as archivo, linea, motivo, contenido.

    The files are parsed once, into the shared folder. Each must begin with the given headers. Of a well-formed record
    the cells are enough; its text is not written.
    """
    parsed = parsed_records(cut_records(lines), len(headers))
    rows = stored(parsed.withColumn("record", F.when(F.col("reason").isNotNull(), F.col("record"))), "records")
    names = [f"c{i}" for i in range(len(headers))]
    head = F.array(*[F.coalesce(n, F.lit("")) for n in names])
    odd = rows.filter(F.col("line") == 1).filter(
        F.col("reason").isNotNull() | (head != F.array(*[F.lit(h) for h in headers]))
    )
    for other in odd.select("file").limit(1).collect():
        raise ValueError(f"{other.file} does not begin with the headers of the sheet")
    body = rows.filter(F.col("line") > 1)
    good = body.filter(F.col("reason").isNull()).select(*names).toDF(*headers)
    rejects = body.filter(F.col("reason").isNotNull()).select(
        F.col("file").alias("archivo"),
        F.col("line").alias("linea"),
        F.col("reason").alias("motivo"),
        F.col("record").alias("contenido"),
    )
    return good, rejects


def read_records(spark: SparkSession, path: str, headers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``sheet_and_rejects`` of the CSV files of a folder; headers default to those of a file there."""
    if headers is None:
        headers = first_headers(spark, path)
    good, rejects = sheet_and_rejects(lines_of(spark.read, path), headers)
    return good.select(*[column(c) for c in headers]), rejects


def first_headers(spark: SparkSession, path: str) -> list[str]:
    from .sheets import _headers

    return _headers(spark, path, "csv", True)
