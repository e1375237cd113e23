"""Column expressions. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NO, NULL_TOKENS, YES, YES_SPELLINGS

# What a form strips from both ends of a value: every Unicode blank.
_BLANKS = "".join(
    chr(code)
    for code in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                 *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def null_tokens(cell: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Null where the cell holds one of the "no value" texts."""
    longest = max((len(token.encode()) for token in tokens), default=0)
    return F.when((F.octet_length(cell) > longest) | ~cell.isin(*tokens), cell)


def plain_number(cell: Column) -> Column:
    """Double from a decimal text; anything else, NaN and infinity included, is null."""
    value = F.when(cell.rlike(_DECIMAL), F.trim(cell)).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def parse_number(cell: Column) -> Column:
    """Threshold text to double: comma is the decimal sign, ``%`` is dropped.

    ``'95%'`` is 95.0, not 0.95; ``'1.234,5'`` has two decimal signs, so null.
    """
    return plain_number(F.replace(F.replace(cell, F.lit(","), F.lit(".")), F.lit("%")))


def numeric_id(code: Column) -> Column:
    """Trailing digits of a code as bigint: CRM00001, CRM001 and 001 are all 1."""
    return F.regexp_extract(code, r"(\d+)$", 1).try_cast("bigint")


def has_yes(flag: Column, spellings: Sequence[str] = YES_SPELLINGS) -> Column:
    """True only for an accepted spelling of yes; false for null."""
    return F.coalesce(F.trim(flag).isin(*spellings), F.lit(False))


def yes_no(flag: Column, spellings: Sequence[str] = YES_SPELLINGS) -> Column:
    return F.when(has_yes(flag, spellings), YES).otherwise(NO)


def clean_text(value: Column) -> Column:
    """A form value: blanks stripped at both ends, null when nothing is left."""
    return F.nullif(F.btrim(value, F.lit(_BLANKS)), F.lit(""))


def latest_first(columns: Sequence[str], order: Sequence[str]) -> Column:
    """Struct whose maximum is the newest row: order columns first, then the rest.

    Comparing every column makes the choice the same on every run.
    """
    rest = [c for c in columns if c not in order]
    return F.struct(*[F.col(c) for c in (*order, *rest)])


def content_spread(columns: Sequence[str], buckets: Column | int) -> Column:
    """Bucket number of a row, the same when a lost task is run again.

    The row's content decides, plus the input partition, so that copies of one
    row do not all meet in one bucket.
    """
    buckets = F.lit(buckets) if isinstance(buckets, int) else buckets
    seed = F.xxhash64(*[F.col(c) for c in columns], F.spark_partition_id())
    return F.pmod(seed, buckets.cast("bigint")).cast("int")
