import random

import pytest
from pyspark.sql import functions as F

from rows import bag
from termloom.operators.joins import hot_fans, join_fanout, join_unique, key_counts


@pytest.fixture(scope="module")
def sides(spark):
    """A third of each side in one key; null keys; keys on one side only; equal copies."""
    rng = random.Random(7)
    keys = [None] * 5 + [*range(20)]
    left = [(5 if i % 3 == 0 else rng.choice(keys), f"l{i % 40}") for i in range(150)]
    right = [(5 if i % 3 == 0 else rng.choice([*keys[8:], 99, None]), f"r{i % 3}") for i in range(180)]
    return (
        spark.createDataFrame(left, "k int, l string").repartition(5),
        spark.createDataFrame(right, "k int, r string").repartition(6),
    )


@pytest.mark.parametrize("hot_rows, hot_pairs", [(1, 10**9), (4, 10**9), (10**9, 7), (20, 50), (10**9, 10**9), (3, 1)])
def test_fanout_equals_plain_join(sides, hot_rows, hot_pairs):
    left, right = sides
    for how in ("left", "inner"):
        salted = join_fanout(left, right, "k", how, hot_rows=hot_rows, hot_pairs=hot_pairs)
        assert bag(salted) == bag(left.join(right, "k", how))


def test_fanout_with_hot_left_key_that_has_no_match(spark, sides):
    left, right = sides
    right = right.filter("k <> 5")
    assert bag(join_fanout(left, right, "k", hot_rows=3)) == bag(left.join(right, "k", "left"))


def test_fanout_with_empty_sides(sides):
    left, right = sides
    assert bag(join_fanout(left, right.limit(0), "k")) == bag(left.join(right.limit(0), "k", "left"))
    assert join_fanout(left.limit(0), right, "k").count() == 0


def test_wrong_counts_only_cost_time(sides):
    """Counts steer the salting; stale ones of the left side must not change rows."""
    left, right = sides
    stale = left.select("k").distinct().withColumn("rows", F.lit(50).cast("bigint"))
    assert bag(join_fanout(left, right, "k", left_counts=stale, hot_rows=7)) == bag(left.join(right, "k", "left"))


def test_hot_key_is_cut_into_pieces(sides):
    left, right = sides
    fans = {r["k"]: r for r in hot_fans(key_counts(left, "k"), key_counts(right, "k"), "k", 20, 10**9).collect()}
    assert set(fans) == {5}
    assert fans[5]["_left_fan"] >= 3 and fans[5]["_right_fan"] >= 3


def test_key_warm_on_both_sides_is_cut_by_pairs(spark, no_broadcast):
    """No side is large, but their pairs are: the largest task makes a bounded share of them."""
    both = spark.range(100).selectExpr("if(id < 60, 1, id) as k", "id as v")
    left, right = both.withColumnRenamed("v", "l"), both.withColumnRenamed("v", "r")
    joined = join_fanout(left, right, "k", "inner", hot_rows=1000, hot_pairs=100)
    assert bag(joined) == bag(left.join(right, "k"))
    fan = hot_fans(key_counts(left, "k"), key_counts(right, "k"), "k", 1000, 100).collect()
    assert [(r["k"], r["_left_fan"] * r["_right_fan"] >= 36) for r in fan] == [(1, True)]
    per_piece = joined.filter("k = 1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_piece < 60 * 60 * 0.7
    # Very many pairs: the larger side is cut down to single rows, then the other.
    fan = hot_fans(key_counts(left, "k"), key_counts(right, "k"), "k", 1000, 1).first()
    assert (fan["_left_fan"], fan["_right_fan"]) == (60, 60)


def test_all_hot_keys_are_cut(spark):
    rows = spark.range(20_000).selectExpr("id % 5000 as k")
    counts = key_counts(rows, "k")
    fans = hot_fans(counts, counts, "k", 3, 10**9)
    assert fans.count() == 5000 and fans.filter("_left_fan < 2 or _right_fan < 2").count() == 0


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_hot_rows_spread_over_tasks(sides, no_broadcast):
    """With broadcast off, the joined rows of the hot key come from several partitions."""
    left, right = sides
    joined = join_fanout(left, right, "k", hot_rows=10)
    assert joined.filter("k = 5").select(F.spark_partition_id()).distinct().count() > 1
    assert joined.filter("k is null").select(F.spark_partition_id()).distinct().count() > 1
    plain = left.join(right, "k", "left")
    assert plain.filter("k = 5").select(F.spark_partition_id()).distinct().count() == 1
    assert bag(joined) == bag(plain)


@pytest.mark.parametrize("key", ["k", "cast(k as string) as k"])
def test_null_keys_spread_in_unique_join(sides, no_broadcast, key, capsys):
    left, right = (df.selectExpr(key, *df.columns[1:]) for df in sides)
    one_each = right.groupBy("k").agg(F.max("r").alias("r"))
    joined = join_unique(left, one_each, "k")
    assert joined.filter("k is null").select(F.spark_partition_id()).distinct().count() > 1
    assert bag(joined) == bag(left.join(one_each, "k", "left"))
    assert bag(join_unique(left, one_each, "k", "left_anti")) == bag(left.join(one_each, "k", "left_anti"))
    joined.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [_left_key" in plan and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_join_unique(sides, how):
    left, right = sides
    one_each = right.groupBy("k").agg(F.max("r").alias("r"))
    assert bag(join_unique(left, one_each, "k", how)) == bag(left.join(one_each, "k", how))
