"""Secret scans: fixed patterns, and a randomness test battery over all token-like strings.

Every run of 20 or more characters of ``A-Za-z0-9+/_-`` is a candidate, with one or two ``=`` that end it as padding; any
other ``=`` parts runs, so that the name and the value of ``NAME=token`` are tested apart. Its encoding is the smallest
alphabet that holds all its characters. Three tests ask whether it looks like independent uniform
symbols of that alphabet (rules of marks, and words or numbers parted by marks, are no hypotheses): a chi-squared test of the symbol counts, a runs test about the middle of the
alphabet, and a lag-one serial correlation test. A candidate that fails one of them (Holm, 0.1 %)
is not random. For the others the chi-squared statistic is held against ordinary text, whose symbol
frequencies depart from uniform by a stated effect: the statistic is then noncentral with a centre that
grows with the length, so a short token is never called random for want of evidence.

The p-values of that second test are counted over the whole corpus, per encoding and length band, and
Benjamini-Hochberg control is applied within each band, so that masses of short tokens cannot loosen the
limit for long ones or the reverse. p-values are rounded up to tenths of a power of ten, which
keeps the counts to a bounded table (encodings x bands x 400 steps) and the control on the safe side.

Cases: a null text is an empty text. Repeated rows give equal results. Only ``doc_id`` and ``text`` are read.
Texts are scanned whole in one pass each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import parts, per_text, table

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# An equals sign only ends a candidate, as padding: NAME=token is two runs.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
# Rules and slugs: marks alone, or words and numbers that marks part.
PLAIN = re.compile(r"[+/_-]++|[+/_-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)[+/_-]++)+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)?")
KINDS = ("assign", "access", "hex", "random")


class Encoding(NamedTuple):
    """Symbols, and by how much ordinary text of these symbols departs from uniform (sum of (p - 1/k)^2 k)."""

    name: str
    symbols: str
    effect: float


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"
# Smallest first. Decimal strings are ordinary numbers and are never reported.
ENCODINGS = (
    Encoding("hex", DIGITS + "abcdef", 1.0),
    Encoding("HEX", DIGITS + "ABCDEF", 1.0),
    Encoding("base32", UPPER + "234567", 1.0),
    Encoding("base36", DIGITS + LOWER, 1.5),
    Encoding("BASE36", DIGITS + UPPER, 1.5),
    Encoding("base62", DIGITS + UPPER + LOWER, 2.0),
    Encoding("base64", UPPER + LOWER + DIGITS + "+/", 2.0),
    Encoding("base64url", UPPER + LOWER + DIGITS + "-_", 2.0),
)
CODES = [{c: i for i, c in enumerate(e.symbols)} for e in ENCODINGS]
BANDS = (20, 28, 40, 64, 128)  # lower ends of the length bands
BATTERY_LEVEL = 0.001
FALSE_DISCOVERY = 0.01
STEPS = 400  # of a tenth of a power of ten


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(token: str) -> int | None:
    core = token.rstrip("=")
    own = set(core)
    if not own or own <= set(DIGITS) or PLAIN.fullmatch(core):
        return None
    return next((i for i, codes in enumerate(CODES) if own <= codes.keys()), None)


def battery(codes: np.ndarray, k: int) -> tuple[float, list[float]]:
    """The chi-squared statistic, and the p-values of the three tests under independent uniform symbols."""
    n = len(codes)
    counts = np.bincount(codes, minlength=k)
    chi = float((counts.astype(float) ** 2).sum() * k / n - n)
    # Wilson-Hilferty: the cube root of chi-squared over its mean is near normal.
    spread = 2 / (9 * (k - 1))
    p_chi = normal_tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    high = codes >= (k + 1) // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    x = codes - codes.mean()
    square = float((x * x).sum())
    r = float((x[1:] * x[:-1]).sum()) / square if square else 1.0
    p_serial = 2 * normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return chi, [min(1.0, p) for p in (p_chi, p_runs, p_serial)]


def ordinary_step(chi: float, n: int, k: int, effect: float) -> int:
    """How improbable so small a statistic is for ordinary text: -10 log10 p, rounded down.

    Uses Sankaran's normal form of the noncentral chi-squared distribution.
    """
    dof, centre = k - 1, n * effect
    mean, two, three = dof + centre, dof + 2 * centre, dof + 3 * centre
    h = 1 - 2 * mean * three / (3 * two * two)
    p = two / (mean * mean)
    m = (h - 1) * (1 - 3 * h)
    z = ((max(chi, 0.0) / mean) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (
        h * math.sqrt(2 * p) * (1 + 0.5 * m * p)
    )
    below = normal_tail(-z)
    return STEPS if below <= 10 ** (-STEPS / 10) else max(0, int(-10 * math.log10(below)))


def test_token(token: str) -> tuple[int, int, int] | None:
    """(encoding, band, step) of a token that the battery lets pass as random, else None."""
    which = encoding_of(token)
    if which is None:
        return None
    core = token.rstrip("=")
    n = len(core)
    if n < BANDS[0]:
        return None
    codes = np.fromiter((CODES[which][c] for c in core), dtype=np.int64, count=n)
    k = len(ENCODINGS[which].symbols)
    chi, p_values = battery(codes, k)
    if any(p * (3 - i) < BATTERY_LEVEL for i, p in enumerate(sorted(p_values))):
        return None
    band = sum(n >= low for low in BANDS) - 1
    return which, band, ordinary_step(chi, n, k, ENCODINGS[which].effect)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int, tuple[int, int, int] | None]]:
    for m in CANDIDATE.finditer(text):
        yield m.start(), m.end(), test_token(m[0])


def tally(docs: DataFrame) -> DataFrame:
    """encoding, band, step, n: candidates of the corpus that passed or failed the battery.

    Those that failed it count as step 0: they are among the hypotheses tested.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}  # at most encodings x bands x steps entries
        for batch in parts(batches):
            for text in batch.column("text").to_pylist():
                for start, end, tested in candidates(text or ""):
                    if tested is None:
                        which = encoding_of(text[start:end])
                        if which is None:
                            continue
                        n = len(text[start:end].rstrip("="))
                        tested = (which, max(0, sum(n >= low for low in BANDS) - 1), 0)
                    seen[tested] = seen.get(tested, 0) + 1
        columns = list(zip(*[(*k, n) for k, n in seen.items()])) or [(), (), (), ()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["encoding", "band", "step", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "encoding int, band int, step int, n long")
    return rows.groupBy("encoding", "band", "step").agg(F.sum("n").alias("n"))


def thresholds(docs: DataFrame, level: float = FALSE_DISCOVERY) -> dict[tuple[int, int], int]:
    """The lowest reported step per (encoding, band): Benjamini-Hochberg over the tallied p-values.

    The table collected has at most encodings x bands x steps rows, whatever the corpus.
    """
    strata: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row in tally(docs).collect():
        strata.setdefault((row["encoding"], row["band"]), []).append((row["step"], row["n"]))
    lowest = {}
    for key, steps in strata.items():
        tests, rank = sum(n for _, n in steps), 0
        for step, n in sorted(steps, reverse=True):
            rank += n
            if 10 ** (-step / 10) <= level * rank / tests:
                lowest[key] = step
    return lowest


def all_spans(text: str, lowest: dict[tuple[int, int], int]) -> tuple[list, list]:
    """Spans of the patterns, and these with the random tokens that no pattern touches."""
    base = base_spans(text)
    found = list(base)
    # Of the patterns' spans that begin before a token ends, the furthest end tells whether one reaches into it.
    begins, furthest = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for start, end, tested in candidates(text):
        if tested is None or tested[2] < lowest.get(tested[:2], STEPS + 1):
            continue
        before = bisect_left(begins, end)
        if not before or furthest[before - 1] <= start:
            found.append((start, 3, end))
    return base, sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, lowest: dict[tuple[int, int], int]) -> DataFrame:
    """One row per document with its counts and spans."""

    def rows(texts: list[str]) -> list[tuple]:
        out = []
        for text in texts:
            base, found = all_spans(text, lowest)
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            out.append((*(kinds.count(k) for k in range(3)), digest, written(found), len(found) - len(base)))
        return out

    columns = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return per_text(docs, rows, columns)


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows with every secret in their texts replaced by the mask; null texts stay null."""
    lowest = thresholds(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if not text:
                return text
            parts, at = [], 0
            for start, _, end in all_spans(text, lowest)[1]:
                if start >= at:
                    parts += [text[at:start], mask]
                at = max(at, end)
            return "".join([*parts, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", clean(docs["text"]))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, thresholds(docs))
