import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rows import bag
from termloom.operators.versions import (
    apply_diff, as_of, dedup_concepts, history, latest_per_key, newest_with_key, revert_diff, snapshot_diff,
)


def snapshot(spark, rng, n=60):
    rows = [(rng.choice([None, "a", "b", "c", "d", "e", "f"]), rng.choice([None, "x", "y"]), rng.randint(0, 2)) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, v string, n int")


def replay(old, diff):
    """The old snapshot with the difference applied, as a multiset."""
    out = bag(old)
    for r in diff.collect():
        for struct, sign in ((r.before, -1), (r.after, 1)):
            if struct is not None:
                out[tuple(struct[c] for c in sorted(old.columns))] += sign * r.copies
    assert min(out.values(), default=0) >= 0
    return +out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diff_turns_old_into_new(spark, seed):
    rng = random.Random(seed)
    old, new = snapshot(spark, rng), snapshot(spark, rng, 40)
    diff = snapshot_diff(old, new, "k")
    assert replay(old, diff) == bag(new)
    assert bag(apply_diff(old, diff)) == bag(new) and bag(revert_diff(new, diff)) == bag(old)
    assert snapshot_diff(old, old.repartition(3), "k").count() == 0


def test_diff_kinds(frame):
    old = frame("k v w", ("same", "1", "1"), ("upd", "1", None), ("gone", "1", "1"), ("dup", "1", "1"), ("dup", "2", "1"), (None, "1", "1"))
    new = frame("k v w", ("same", "1", "1"), ("upd", "2", "z"), ("come", "1", "1"), ("come", "1", "1"), ("dup", "1", "1"), ("dup", "3", "1"), (None, "2", "1"))
    rows = {(r.k, r.change): (r.copies, r.changed_columns) for r in snapshot_diff(old, new, "k").collect()}
    assert rows == {
        ("upd", "update"): (1, ["v", "w"]), ("gone", "delete"): (1, []), ("come", "insert"): (2, []),
        ("dup", "update"): (1, ["v"]), (None, "delete"): (1, []), (None, "insert"): (1, []),
    }
    assert snapshot_diff(old, new, "k", ignore=("v",)).filter("k = 'upd'").first().changed_columns == ["w"]


def test_latest_and_dedup(frame):
    df = frame("k v ts", ("a", "1", 1), (" a ", "2", 2), ("a", "3", 2), ("b", "1", None), (None, "1", 1), (None, "2", 1), types="string string int")
    assert bag(latest_per_key(df.filter("k is not null"), ["k"], ["ts"])) == Counter({("a", 2, "3"): 1, (" a ", 2, "2"): 1, ("b", None, "1"): 1})
    assert bag(dedup_concepts(df, "k", ["ts"])) == Counter({("a", 2, "3"): 1, ("b", None, "1"): 1, (None, 1, "1"): 1, (None, 1, "2"): 1})


@pytest.fixture(scope="module")
def versions(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [
        ("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), start + timedelta(hours=rng.randint(0, 400)), i)
        for i in range(200)
    ]
    return spark.createDataFrame(rows, "k string, ts timestamp, v int").repartition(4)


def test_rows_without_a_code_are_kept(frame):
    df = frame("k v ts", ("a", "1", 1), (" a", "2", 2), ("  ", "1", 1), (" ", "1", 2), ("", "1", 1), (None, "1", 1), (None, "1", 1), types="string string int")
    assert bag(dedup_concepts(df, "k", ["ts"])) == Counter(
        {("a", 2, "2"): 1, ("  ", 1, "1"): 1, (" ", 2, "1"): 1, ("", 1, "1"): 1, (None, 1, "1"): 2}
    )
    assert newest_with_key(df, "k", ["ts"]).filter("k is null").count() == 2


def test_history_equals_window_over_whole_key(versions):
    tied = versions.unionByName(versions.filter("v % 5 = 0").withColumn("v", F.col("v") + 1000))
    along = Window.partitionBy("k").orderBy("ts", "v")
    plain = (
        tied.withColumn("valid_from", F.col("ts"))
        .withColumn("valid_to", F.when(F.col("k").isNotNull(), F.lead("ts").over(along)))
        .withColumn("is_current", F.col("valid_to").isNull())
    )
    assert bag(history(tied, "k", "ts")) == bag(plain)
    assert history(tied.limit(0), "k", "ts").count() == 0


def test_busy_key_is_cut_into_ranges(spark, versions):
    busy = spark.range(4000).selectExpr("if(id % 10 < 8, 'hot', 'b') as k", "timestamp_seconds(id div 3) as ts", "id as v")
    hot = history(busy, "k", "ts").filter("k = 'hot'")
    along = Window.partitionBy("k").orderBy("ts", "v")
    assert bag(hot.select("v", "valid_to")) == bag(
        busy.filter("k = 'hot'").withColumn("valid_to", F.lead("ts").over(along)).select("v", "valid_to")
    )


def test_end_marks(frame):
    df = frame("k ts gone", ("a", 1, False), ("a", 5, True), ("a", 7, False), ("b", 2, None), ("b", 3, True), types="string int boolean")
    got = {(r.k, r.valid_from, r.valid_to, r.is_current) for r in history(df, "k", "ts", deleted="gone").collect()}
    assert got == {("a", 1, 5, False), ("a", 7, None, True), ("b", 2, 3, False)}
    at = lambda t: {(r.k, r.ts) for r in as_of(df, "k", "ts", F.lit(t), deleted="gone").collect()}
    assert at(4) == {("a", 1)} and at(6) == set() and at(8) == {("a", 7)} and at(2) == {("a", 1), ("b", 2)}


def test_as_of_agrees_with_history(versions):
    at = datetime(2024, 1, 9, 5)
    valid = history(versions, "k", "ts").filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    assert bag(as_of(versions, "k", "ts", at).filter("k is not null")) == bag(valid.filter("k is not null").select("k", "ts", "v"))
    assert as_of(versions, "k", "ts", at).filter("k is null").count() == versions.filter((F.col("k").isNull()) & (F.col("ts") <= at)).count()


def test_rows_left_over_are_computed_once(frame):
    old = frame("k v", ("a", "1"), ("b", "1"), ("b", "2"), (None, "x"))
    new = frame("k v", ("a", "2"), ("b", "1"), ("b", "3"), (None, "y"))
    diff = snapshot_diff(old, new, "k")
    assert all("/left-over-" in path or "/paired-keys-" in path for path in diff.inputFiles()) and diff.inputFiles()
    found = {(r.k, r.change, r.before and r.before.v, r.after and r.after.v) for r in diff.collect()}
    assert found == {("a", "update", "1", "2"), ("b", "update", "2", "3"), (None, "delete", "x", None), (None, "insert", None, "y")}


def test_who_reads_keys_of_a_difference_reads_no_other_column(frame):
    old = frame("k v", ("a", "1"), ("b", "1"), ("c", "1"), ("c", "2"), (None, "x"))
    new = frame("k v", ("a", "2"), ("b", "1"), ("c", "3"), ("d", "1"))
    diff = snapshot_diff(old, new, "k")
    for side, keys in (("before", ["a", "c", "c", None]), ("after", ["a", "c", "d"])):
        narrow = diff.filter(F.col(side).isNotNull()).select(f"{side}.k")
        assert sorted([r.k for r in narrow.collect()], key=str) == sorted(keys, key=str)
        plan = narrow._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan
        assert "v:" not in narrow._jdf.queryExecution().sparkPlan().toString()
