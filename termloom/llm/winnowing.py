"""Benchmark decontamination by winnowing.

Texts become words. A window is a number of neighbouring words of a benchmark item, ten, or all of an item with
fewer. For windows of t words every stretch of k = t / 2 words is hashed, and of each t words in a row the least hash (the last of
equals) is kept as their fingerprint. Which one that is depends on the t words alone, so a stretch of t words or more that a document shares
with an item has a fingerprint of both, at the same place in both. Documents and items are joined on their fingerprints, and each
hit is extended to both sides, word by word, as far as a window can reach. What agrees on t words or more is a
hit; words are compared, not hashes.

The documents are scanned once. A bit set of the items' fingerprints, of at most ``MOST_BITS`` bits however many
there are, keeps nearly all other fingerprints from leaving the scan; it lets more pass as the benchmark grows, and never loses one.
What passes is written with its words around it, a small table, and joined. The items' side of this join is broadcast if its
measured size is below ``BROADCAST_BYTES``; else both sides are shuffled, and Spark splits what is skewed.

Only DataFrame functions are used. Item windows of other lengths than ten exist only where items are shorter; each length
that occurs is a family of fingerprints of its own, ten at most.

Cases: a null or empty text has no words; such an item has no window, such a document no hit. Long texts are taken whole. Repeated documents give
equal rows, repeated items count once for each different ``item_id``; an item without id makes hits and is not listed. An empty table
of items leaves all documents clean, an empty table of documents gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import let, stored, table

WINDOW = 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_BITS = 1 << 20
BITS_EACH = 64
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.length(whole)
    lowered = F.when(plain, F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))
    return F.filter(F.split(lowered, OTHERS), lambda w: w != "")


def gram_words(t: int) -> int:
    return max(1, t // 2)


def _places(first: Column | int, n: Column) -> Column:
    """``first`` and the numbers after it, ``n`` of them."""
    return F.when(n > 0, F.sequence(F.lit(first), F.lit(first) + n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, hashes: Column, t: int, passes=None) -> Column:
    """Array of (t, fp, place, before, around) for each stretch of words that is some window's fingerprint.

    ``around``: the words that windows with this fingerprint can hold; ``before`` of them lie ahead of the
    stretch. ``passes`` may tell which hashes are of interest.
    """
    k = gram_words(t)
    reach = t - k
    n = F.size(hashes)

    def of_grams(grams: Column) -> Column:
        within = lambda p: [F.get(grams, p + o) for o in range(reach + 1)]

        def least(p: Column) -> Column:
            return F.least(*within(p)) if reach else F.get(grams, p)

        def last_place(p: Column, fp: Column) -> Column:
            at = F.lit(0)
            for o in range(1, reach + 1):
                at = F.when(F.get(grams, p + o) == fp, F.lit(o)).otherwise(at)
            return p + at

        minima = F.transform(_places(0, n - t + 1), least)
        chosen = F.transform(
            minima,
            lambda fp, p: F.when(
                F.lit(True) if passes is None else passes(fp), F.struct(last_place(p, fp).alias("place"), fp.alias("fp"))
            ),
        )
        # Windows with one fingerprint lie side by side.
        return let(
            F.array_compact(chosen),
            lambda c: F.filter(c, lambda one, i: ~F.get(c, i - 1)["place"].eqNullSafe(one["place"])),
        )

    def described(one: Column) -> Column:
        low = F.greatest(one["place"] - reach, F.lit(0))
        return F.struct(
            F.lit(t).alias("t"),
            one["fp"].alias("fp"),
            one["place"].alias("place"),
            (one["place"] - low).alias("before"),
            F.slice(words, low + 1, F.least(one["place"] + t, n) - low).alias("around"),
        )

    grams = F.transform(
        _places(0, n - k + 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)], F.lit(t))
    )
    return F.transform(let(grams, of_grams), described)


def all_fingerprints(words: Column, sizes: list[int], passes=None) -> Column:
    """``fingerprints`` of several sizes of windows."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.flatten(F.array(*[fingerprints(words, h, t, passes) for t in sizes])))


def item_prints(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """t, fp, before, around and the ids of the items that have these words, stored; and the sizes of windows."""
    cut = stored(
        items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(
            F.size("words") > 0
        ),
        "items",
    )
    size = F.least(F.size("words"), F.lit(window))
    sizes = sorted(r.t for r in cut.select(size.alias("t")).distinct().collect())  # no more than ``window``
    prints = [
        cut.filter(size == t).select("item", F.inline(all_fingerprints(F.col("words"), [t]))) for t in sizes
    ] or [cut.select("item", F.inline(all_fingerprints(F.col("words"), [window])))]
    rows = reduce(DataFrame.unionByName, prints)
    together = rows.groupBy("t", "fp", "before", "around").agg(F.collect_set("item").alias("items"))
    return stored(together, "item-prints"), sizes


def bit_set(prints: DataFrame):
    """A test whether a hash may be among the fingerprints, and their bytes. Its size is bounded, not its share of ones."""
    size = prints.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(
            F.aggregate("around", F.lit(0), lambda acc, w: acc + F.octet_length(w) + 16)
            + F.aggregate("items", F.lit(0), lambda acc, i: acc + F.octet_length(i) + 16)
            + 64
        ).alias("bytes"),
    ).first()
    bits = 64
    while bits < min(MOST_BITS, size.n * BITS_EACH):
        bits *= 2
    at = F.pmod("fp", F.lit(bits))
    held = (
        prints.select(F.floor(at / 64).cast("int").alias("block"), (at % 64).cast("int").alias("bit"))
        .distinct()
        .groupBy("block")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("mask"))
        .collect()  # at most MOST_BITS / 64 rows
    )
    masks = [0] * (bits // 64)
    for row in held:
        masks[row.block] = row.mask
    known = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")  # folded to a literal

    def passes(fp: Column) -> Column:
        at = F.pmod(fp, F.lit(bits))
        return F.getbit(F.get(known, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return passes, size.bytes or 0


def _agreeing(a: Column, from_a: Column, b: Column, from_b: Column, step: int, most: Column) -> Column:
    """How many words of ``a`` and ``b`` agree in a row, from the given places on, in steps of 1 or -1."""
    return F.aggregate(
        _places(0, most),
        F.lit(0),
        lambda acc, j: F.when(
            (acc == j) & F.get(a, from_a + j * step).eqNullSafe(F.get(b, from_b + j * step)), acc + 1
        ).otherwise(acc),
    )


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items (ids, sorted as strings)."""
    prints, sizes = item_prints(items, window)
    passes, print_bytes = bit_set(prints)
    found = lambda w: all_fingerprints(w, sizes, passes) if sizes else F.array().cast(HITS)
    scanned = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("hits"))).alias("_"),
        ).select("row", "doc_id", "_.n_words", F.col("_.hits").cast(HITS).alias("hits")),
        "document-prints",
    )
    hits = scanned.select("row", F.inline("hits"))
    theirs = prints.select("t", "fp", F.col("before").alias("their_before"), F.col("around").alias("theirs"), "items")
    if print_bytes <= BROADCAST_BYTES:
        theirs = F.broadcast(theirs)
    met = hits.join(theirs, ["t", "fp"])
    left = _agreeing(
        F.col("around"), F.col("before") - 1, F.col("theirs"), F.col("their_before") - 1, -1, F.least("before", "their_before")
    )
    right = _agreeing(
        F.col("around"), F.col("before"), F.col("theirs"), F.col("their_before"), 1,
        F.least(F.size("around") - F.col("before"), F.size("theirs") - F.col("their_before")),
    )
    spans = (
        met.withColumns({"left": left, "right": right})
        # An agreement begins at the fingerprint, so one on t words holds a window on both sides.
        .filter((F.col("right") > 0) & (F.col("left") + F.col("right") >= F.col("t")))
        .select("row", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"), "items")
    )
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("last")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(s["end"] - F.greatest(s["start"], acc["last"]), F.lit(0))).alias("total"),
            F.greatest(s["end"], acc["last"]).alias("last"),
        ),
        lambda acc: acc["total"],
    )
    by_row = spans.groupBy("row").agg(
        covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    none = F.array().cast("array<string>")
    return scanned.select("row", "doc_id", "n_words").join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


HITS = "array<struct<t:int,fp:bigint,place:int,before:int,around:array<string>>>"


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_CUT = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CUT} AS ws FROM documents),
b AS (SELECT item_id, {_CUT} AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, t, array_to_string(ws[i:i + t - 1], ' ') AS win
      FROM (SELECT item_id, ws, t, unnest(range(1, len(ws) - t + 2)) AS i
            FROM (SELECT *, least(len(ws), {WINDOW}) AS t FROM b WHERE len(ws) > 0))),
x AS (SELECT r, i, t, array_to_string(ws[i:i + t - 1], ' ') AS win
      FROM (SELECT r, ws, t, unnest(range(1, len(ws) - t + 2)) AS i FROM d, (SELECT DISTINCT t FROM v) sizes WHERE len(ws) >= t)),
h AS (SELECT r, i, t, item_id FROM x JOIN v USING (t, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + t)) AS p FROM (SELECT DISTINCT r, i, t FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
