"""Mixing sources to target weights by Pareto order sampling.

A source's target in words comes from its weight, capped at a multiple of its own words. Its documents
then get expected copies: in proportion to a preference (a small whole number of the document, so that probabilities are
unequal), at most ``MOST_COPIES``, summing to the target. Whole copies are certain. What is left of each
expectation is the inclusion probability p of one more copy: documents are ranked by the random odds u / (1 - u) over
the inclusion odds p / (1 - p), and those of lowest rank are taken up to the number of words that the probabilities
come to. u is a hash of the document, so reruns agree.

The cut in each source's order is found by digits: the rank, as a number of 50 bits (20 of the rank itself, then
hashes that settle ties), is read ten bits at a time; per source at most 1,024 sums show in which digit the cut
falls. No source is ever sorted or gathered, whatever its size; rows of one last cell, about a 2^50th of a source, are ordered.
Up to the cut the words taken fall short by less than one document; the excluded document whose size is
nearest to the gap is added if that brings the source nearer to its target.

Cases: a null text has no words and is taken with 0; a null source is a source of its own, last in order; repeated
rows are separate documents, told apart by their place in the input; an empty table gives no rows. Only ``doc_id``,
``text`` and ``source`` are read. Sources are put in order as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import column, free_name, stored, table, word_count

# Production parameters.
WEIGHTS = (3, 1, 2)  # repeating, over the sources in order
SHARE = 1.5  # of all words
MOST_COPIES = 2
LONG_TEXT = 100  # words; such texts are preferred twice as much
SEED = 20_240
DIGIT_BITS, DIGITS = 10, 5


def preference(size: Column) -> Column:
    return F.when(size >= LONG_TEXT, 2).otherwise(1)


def measured(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, source, size, preference, u in (0, 1), tie (a hash of the document), row (a number of its own)."""
    unit = F.pmod(F.xxhash64("doc_id", "text", "source", F.lit(SEED)), F.lit(1 << 53))
    size = word_count(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        size.alias("size"),
        preference(size).alias("preference"),
        ((unit + 0.5) / float(1 << 53)).alias("u"),
        F.xxhash64("doc_id", "text", "source", F.lit(SEED + 1)).alias("tie"),
        row.alias("row"),
    )


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from source, source_size: one row each.

    Water level: min(cap x size, level x weight) summing to the share of all words. Sources are gone through by
    cap / weight; the level is the first that the source itself does not exceed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ranked = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    ranked = ranked.withColumn("reach", F.col("most") / F.col("weight"))
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    levels = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(by_reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            / F.sum("weight").over(by_reach.rowsBetween(0, Window.unboundedFollowing))
        ).alias("candidate"),
        F.row_number().over(by_reach).alias("place"),
    )
    level = F.min(F.when(F.col("candidate") <= F.col("reach"), F.struct("place", "candidate"))).over(everything)["candidate"]
    return levels.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("most").cast("double"))
        .otherwise(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .alias("target"),
    )


def expected_copies(classes: DataFrame, of_source: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """source, preference, copies, target, source_size: min(cap, c x preference), with c such that the source meets its target."""
    high_first = Window.partitionBy("source").orderBy(F.col("preference").desc())
    joined = classes.join(of_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = F.coalesce(F.sum("words").over(high_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    rest = F.sum(F.col("words") * F.col("preference")).over(high_first.rowsBetween(0, Window.unboundedFollowing))
    scaled = joined.withColumn("c", F.when(rest > 0, F.greatest(F.lit(0.0), (F.col("target") - full) / rest)).otherwise(0.0))
    fits = F.when(F.col("c") * F.col("preference") <= cap, F.struct((-F.col("preference")).alias("p"), "c"))
    scale = F.min(fits).over(Window.partitionBy("source"))["c"]
    return scaled.select(
        "source",
        "preference",
        "target",
        "source_size",
        F.least(F.lit(float(cap)), F.coalesce(scale * F.col("preference"), F.lit(float(cap)))).alias("copies"),
    )


def ranked(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows with their whole copies, the probability of one more, and the 50-bit rank."""
    c = copies.withColumnsRenamed({"source": "s", "preference": "p"})
    joined = rows.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("preference") == F.col("p"))).drop("s", "p")
    whole = F.floor("copies")
    odds = joined.withColumns({"whole": whole, "chance": F.col("copies") - whole})
    u, p = F.col("u"), F.col("chance")
    # The quotient q of the odds as q / (1 + q), which lies in (0, 1) and keeps the order.
    position = (u * (1 - p)) / (u * (1 - p) + (1 - u) * p)
    top = F.least(F.floor(position * (1 << 20)), F.lit((1 << 20) - 1)).cast("long")
    rank = (
        F.shiftleft(top, 30)
        + F.shiftleft(F.pmod("tie", F.lit(1 << 10)), 20)
        + F.pmod(F.xxhash64("row", "tie"), F.lit(1 << 20))
    )
    return odds.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), rank))


def cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, cut, need: the rank at which a source's words reach ``wanted``, and the words still free at that rank.

    A source whose rows all fit has a cut beyond every rank.
    """
    at = wanted.select("source", F.lit(0).cast("long").alias("cut"), F.col("wanted").alias("need"))
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        own = rows.filter("rank IS NOT NULL").select("source", "size", F.shiftright("rank", shift).alias("prefix"))
        edge = at.select(F.col("source").alias("s"), "cut", "need")
        inside = own.join(
            edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("prefix", DIGIT_BITS) == F.col("cut"))
        )
        # ``need`` is the same for all rows of a source.
        sums = inside.groupBy("source", "prefix").agg(F.sum("size").alias("words"), F.max("need").alias("need"))
        along = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        cum = sums.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
        over = F.col("before") + F.col("words") > F.col("need")
        found = cum.groupBy("source").agg(
            F.min(F.when(over, F.struct("prefix", (F.col("need") - F.col("before")).alias("need")))).alias("edge"),
        )
        # No digit passes the need only at the first level: then all rows fit.
        at = stored(
            found.select(
                "source",
                F.coalesce(F.col("edge.prefix"), F.lit(1 << DIGIT_BITS)).alias("cut"),
                F.coalesce(F.col("edge.need"), F.lit(0.0)).alias("need"),
            )
            if digit == 0
            else found.select("source", F.col("edge.prefix").alias("cut"), F.col("edge.need").alias("need")).unionByName(
                at.filter(F.col("cut") >= F.lit(1 << DIGIT_BITS * digit)).withColumn("cut", F.shiftleft("cut", DIGIT_BITS))
            ),
            "mix-cut",
        )
    return at


def mixed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and row of every row.

    ``row``: a whole number that names each row of ``docs``; by default its place in the input.
    """
    rows = stored(measured(docs, F.monotonically_increasing_id() if row is None else row), "mix-rows")
    classes = rows.groupBy("source", "preference").agg(F.sum("size").alias("words"))
    of_source = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    copies = stored(expected_copies(classes, of_source), "mix-copies")
    order = stored(ranked(rows, copies), "mix-ranks")
    wanted = order.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("wanted")
    )
    at = cuts(order, wanted)
    edge = at.select(F.col("source").alias("s"), "cut", "need")
    marked = order.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    cell = Window.partitionBy("source").orderBy("rank", "u", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.filter("rank = cut").withColumn("more", (F.sum("size").over(cell) <= F.col("need")).cast("long"))
    rest = marked.filter("rank IS NULL OR cut IS NULL OR rank <> cut").withColumn(
        "more", F.coalesce((F.col("rank") < F.col("cut")).cast("long"), F.lit(0))
    )
    chosen = stored(last.unionByName(rest).drop("cut", "need"), "mix-chosen")
    gaps = chosen.groupBy("source").agg(
        (F.max("target") - F.sum((F.col("whole") + F.col("more")) * F.col("size"))).alias("gap")
    )
    gap = gaps.select(F.col("source").alias("s"), "gap")
    spare = chosen.filter("rank IS NOT NULL AND more = 0").join(gap, F.col("source").eqNullSafe(F.col("s")))
    off = F.abs(F.col("size") - F.col("gap"))
    fill = (
        spare.filter(off < F.abs(F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "rank", "u", "row")).alias("best"))
        .select(F.col("best.row").alias("row"), F.lit(1).alias("fill"))
    )
    total = F.col("whole") + F.col("more") + F.coalesce(F.col("fill"), F.lit(0))
    return chosen.join(fill, "row", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (total * F.col("size")).cast("long").alias("taken"),
        total.cast("int").alias("copies"),
        "row",
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with their own columns."""
    number = free_name("__row", docs.columns)
    of, copies = (free_name(stem, [*docs.columns, number]) for stem in ("__of", "__copies"))
    # The numbers are written with the rows, so that they cannot change between here and the join.
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "mix-documents")
    counts = mixed(rows, F.col(number)).filter("copies > 0").select(F.col("row").alias(of), F.col("copies").alias(copies))
    taken = rows.join(counts, F.col(number) == F.col(of))
    again = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return taken.withColumn(number, again).select(*[column(c) for c in docs.columns])


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
