"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Each rule bounds a ratio of two counts of a text in percent. The counts are whole numbers and the
comparison multiplies them out, so no verdict depends on rounding. The measures of a text are one
expression; no row is shuffled and no user function runs.

Cases: a null text has no words, fails the base rules and is not kept. Repeated rows are judged
alike. Other columns pass through untouched whatever their names. Stop words are asked for only where ``lang`` is one of the
languages that the list covers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import column, free_name, let, table, words_of

SYMBOLS = "#*$%&|<>"
STOP_GAP = r"[\x20\x09-\x0D.,;:!?]+"
WINDOW = 5
# The most frequent function words of the four languages of the documents.
STOP_WORDS = (
    "the and of to in that is with for as was on by be it are or at from this "
    "le la les de des et un une que qui dans pour est du en sur "
    "der die das und nicht ist von mit ein eine den zu im für sich auf dem "
    "el los las y se con por del para su es al no una lo"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))
SPOKEN = ("en", "fr", "de", "es")  # the values of ``lang`` whose function words are in the list


class Rule(NamedTuple):
    """``low`` <= 100 * part / whole <= ``high``, asked only of texts whose ``whole`` is ``least`` or more.

    ``spoken``: asked only of texts in a language whose stop words are known.
    """

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None
    least: int = 1
    spoken: bool = False


# Production thresholds, in percent of the whole.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1_500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_bangs", "n_words", None, 30),
    Rule("echoed_words", "n_echoes", "n_words", None, 25),
    Rule("stop_words", "n_stop_words", "n_words", 4, None, 40, spoken=True),
    Rule("stop_words_short", "n_stop_words", "n_words", 1, None, 15, spoken=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40, 4),
)
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows of five that occur at least twice.

    Windows are told apart by a 64-bit hash of their words' 64-bit hashes. Only a text in which
    some window repeats has its windows sorted, to find them.
    """
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def repeats(ordered: Column) -> Column:
        hits = F.filter(
            ordered,
            lambda w, k: F.get(ordered, k - 1)["h"].eqNullSafe(w["h"]) | F.get(ordered, k + 1)["h"].eqNullSafe(w["h"]),
        )
        return F.sort_array(F.transform(hits, lambda w: w["i"]))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(ordered, repeats),
            F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
            lambda acc, at: F.struct(
                (acc["total"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("total"), at.alias("last")
            ),
            lambda acc: acc["total"].cast("long"),
        )

    return let(
        windows,
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(
            covered(found)
        ),
    )


def measures(text: Column) -> Column:
    """Struct of all counts that the rules may name.

    Stop words are looked for among the lower-cased runs between gaps and the marks ``.,;:!?``.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.filter(F.split(F.lower(whole), STOP_GAP), lambda w: w.isin(*STOP_WORDS))

    def counted(words: Column, bare: Column, own: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            F.regexp_count(bare, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.length(bare) - F.length(F.replace(bare, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
            F.size(own).cast("long").alias("n_lines"),
            (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
            F.size(stops).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w, i: F.get(words, i - 1).eqNullSafe(w))).cast("long").alias("n_echoes"),
            let(F.transform(words, lambda w: F.xxhash64(w)), _repeated_words).alias("n_repeat_words"),
        )

    return let(
        words_of(text),
        lambda words: let(F.array_join(words, ""), lambda bare: let(lines, lambda own: counted(words, bare, own))),
    )


def passes(measured: Column, spoken: Column, rules=RULES) -> Column:
    """One boolean expression out of the table of rules."""
    verdict = F.lit(True)
    for rule in rules:
        part, whole = measured[rule.part] * 100, measured[rule.whole]
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (part >= whole * rule.low)
        if rule.high is not None:
            holds = holds & (part <= whole * rule.high)
        if rule.spoken:
            holds = holds | ~spoken
        verdict = verdict & ((whole < rule.least) | holds)
    return verdict


def base_fails(measured: Column) -> Column:
    return (measured["n_words"] < MIN_WORDS) | (
        measured["n_repeat_words"] * 100 > measured["n_words"] * MAX_REPEATED_PERCENT
    )


def judged(docs: DataFrame, into: str, rules=RULES) -> DataFrame:
    """The rows with a struct column ``into``: all measures, ``base_failed`` and ``kept``.

    Without a column ``lang``, or where it is null, the language is not known.
    """
    spoken = F.coalesce(F.col("lang").isin(*SPOKEN), F.lit(False)) if "lang" in docs.columns else F.lit(False)
    verdicts = lambda m: F.struct(
        *[m[name].alias(name) for name in MEASURES],
        base_fails(m).alias("base_failed"),
        (~base_fails(m) & passes(m, spoken, rules)).alias("kept"),
    )
    return docs.withColumn(into, let(measures(docs["text"]), verdicts))


MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_bangs",
    "n_lines",
    "n_dup_lines",
    "n_stop_words",
    "n_echoes",
    "n_repeat_words",
)


def kept_rows(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that pass, with their own columns."""
    verdict = free_name("__verdict", docs.columns)
    return judged(docs, verdict, rules).filter(F.col(verdict)["kept"]).select(*[column(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    v = F.col("verdict")
    return judged(docs, "verdict").select(
        "doc_id",
        *[v[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        v["base_failed"].alias("base_failed"),
        v["kept"].alias("kept"),
        *[v[n].alias(n) for n in ("n_bangs", "n_lines", "n_stop_words", "n_echoes")],
    )


def rule_sql(rule: Rule) -> str:
    parts = []
    if rule.low is not None:
        parts.append(f"{rule.part} * 100 >= {rule.whole} * {rule.low}")
    if rule.high is not None:
        parts.append(f"{rule.part} * 100 <= {rule.whole} * {rule.high}")
    unknown = "NOT spoken OR " if rule.spoken else ""
    return f"({unknown}{rule.whole} < {rule.least} OR ({' AND '.join(parts)}))"


_SPOKEN = ", ".join(f"'{lang}'" for lang in SPOKEN)
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang IN ({_SPOKEN}), false) AS spoken FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i
      FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
g AS (SELECT r, i, word,
        list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS gram FROM w),
f AS (SELECT r, i, word, coalesce(word = lag(word) OVER (PARTITION BY r ORDER BY i), false)::INT AS echo, (len(gram) = {WINDOW} AND count(*) OVER (PARTITION BY r, gram) > 1)::INT AS hit FROM g),
c AS (SELECT r, word, echo, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS covered
      FROM f),
a AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
        sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        sum(length(regexp_replace(word, '[^!]', '', 'g')))::BIGINT AS n_bangs,
        sum(covered)::BIGINT AS n_repeat_words, sum(echo)::BIGINT AS n_echoes FROM c GROUP BY r),
s AS (SELECT r, count(*) AS n_stop_words
      FROM (SELECT r, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D.,;:!?]+')) AS run FROM d)
      WHERE run IN ({_STOPS}) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, spoken, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        coalesce(n_symbols, 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bangs, 0) AS n_bangs,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_echoes, 0) AS n_echoes
      FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {' AND '.join(rule_sql(r) for r in RULES)}) AS kept, n_bangs, n_lines, n_stop_words, n_echoes
FROM b
"""
