"""Change logs, as-of joins, golden tables kept current, hot lineage fields and working folders."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from entry_support import mapping, registry
from rows import bag
from termloom.operators import changelog, changes
from termloom.operators.versions import as_of, as_of_many, snapshot_diff
from termloom.plans import incremental, metrics
from termloom.plans.golden import priority_summary, quality_report_eager
from termloom.plans.silver import coverage
from termloom.schemas import CODE, CONCEPTS, CUSTOM_CONCEPTS, DOMAIN, LINEAGE, PRIORITY, RULE_ID, RULES, SUBDOMAIN, TERM, TRACE
from termloom.operators.clean import conform
from termloom.session import shared_folder, stored, working_folders

RUN = datetime(2026, 1, 1)
T0 = datetime(2024, 1, 1)


def snapshots(frame, seed=1, n=5):
    """Snapshots with copies, rows without a key, and keys that come back."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice("xyz")) for _ in range(30)]
    out = [list(rows)]
    for _ in range(n - 1):
        rows = [r for r in rows if rng.random() < 0.7]
        rows = [(k, rng.choice("xyz")) if rng.random() < 0.3 else (k, v) for k, v in rows]
        rows += [(rng.choice(["a", "b", "e", None]), rng.choice("xyz")) for _ in range(rng.randint(0, 8))]
        out.append(list(rows))
    return [frame("k v", *rows) for rows in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_log_of_many_batches(spark, frame, seed):
    steps, log = snapshots(frame, seed), shared_folder(spark, "log")
    for number, (old, new) in enumerate(zip(steps, steps[1:]), 1):
        changelog.append_changes(snapshot_diff(old, new, "k"), log, number, T0)
    changelog.append_changes(snapshot_diff(steps[1], steps[2], "k"), log, 2, T0)  # a batch written again
    for low in range(len(steps)):
        for high in range(low + 1, len(steps)):
            part = changelog.read_changes(spark, log, after=low, upto=high)
            assert bag(changelog.replayed(steps[low], part)) == bag(steps[high])
            assert bag(changelog.rolled_back(steps[high], part)) == bag(steps[low])
    net, direct = changelog.folded(changelog.read_changes(spark, log), "k"), snapshot_diff(steps[0], steps[-1], "k")
    assert bag(net) == bag(direct)


def test_log_reads_only_the_folders_it_needs(spark, frame):
    steps, log = snapshots(frame), shared_folder(spark, "log")
    for number, (old, new) in enumerate(zip(steps, steps[1:]), 1):
        changelog.append_changes(snapshot_diff(old, new, "k"), log, number)
    plan = changelog.read_changes(spark, log, after=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(change_number" in plan


def asking(spark, keys, n_versions, n_requests, seed=5):
    rng = random.Random(seed)
    time = lambda: T0 + timedelta(hours=rng.randint(0, 40))
    versions = [(rng.choice(keys), time(), rng.randint(0, 3), rng.random() < 0.2) for _ in range(n_versions)]
    versions += [(None, T0, 1, False), (keys[0], None, 9, False), (keys[0], T0, None, None)]
    requests = [(i, rng.choice([*keys, "none", None]), rng.choice([time(), time(), None])) for i in range(n_requests)]
    requests += [(0, keys[0], T0), (0, keys[0], T0)]
    return (
        spark.createDataFrame(versions, "k string, ts timestamp, v int, gone boolean").repartition(3),
        spark.createDataFrame(requests, "id int, k string, at timestamp").repartition(2),
        versions,
        requests,
    )


def plain_answers(versions, requests, ends):
    out = []
    for i, k, at in requests:
        valid = [v for v in versions if k is not None and at is not None and v[0] == k and v[1] is not None and v[1] <= at]
        rank = lambda v: (v[1], -1 if v[2] is None else v[2], bool(v[3]) if ends else 0)
        best = max(valid, key=rank, default=None)
        if best is None or (ends and best[3]):
            out.append((i, k, at, None, None))
        else:
            out.append((i, k, at, best[1], best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("ends", [False, True])
@pytest.mark.parametrize("keys", [["a", "b", "c"], ["hot"]])
def test_as_of_many(spark, keys, ends):
    versions, requests, v, r = asking(spark, keys, 200, 150)
    source = versions if ends else versions.drop("gone")
    made = as_of_many(source, requests, "k", "ts", "at", "gone" if ends else None)
    assert made.columns == ["id", "k", "at", "ts", "v"]
    assert sorted((tuple(row) for row in made.collect()), key=str) == plain_answers(v, r, ends)


def test_as_of_many_agrees_with_as_of(spark):
    versions, _, _, _ = asking(spark, ["a", "b", "c"], 100, 1)
    at = T0 + timedelta(hours=20)
    keys = versions.select("k").distinct().filter("k is not null").withColumn("at", F.lit(at))
    many = as_of_many(versions, keys, "k", "ts", "at", "gone").filter("ts is not null").select("k", "ts", "v")
    assert bag(many) == bag(as_of(versions.filter("k is not null"), "k", "ts", at, "gone").select("k", "ts", "v"))


def test_as_of_many_of_empty_tables(spark):
    versions, requests, _, r = asking(spark, ["a"], 5, 5)
    assert as_of_many(versions, requests.limit(0), "k", "ts", "at").count() == 0
    assert as_of_many(versions.limit(0), requests, "k", "ts", "at").filter("ts is null").count() == len(r)
    with pytest.raises(ValueError):
        as_of_many(versions, requests.withColumn("v", F.lit(1)), "k", "ts", "at")


def dictionary(spark, seed):
    """Small tables: shared codes, ids and terms, copies, legend-free nulls, custom concepts."""
    rng = random.Random(seed)
    pick = rng.choice
    concepts = [
        (pick(["CRM1", "CRM2", "X2", "CRM3", "NOID", None, " "]), pick(["t1", "t2", None]), pick(["d1", "d2", None]), pick(["s1", None]), pick(["Alta", None]), pick(["SI", "no", None]))
        for _ in range(rng.randint(4, 14))
    ]
    rules = [(pick(["r1", "r2", "r3", None]), pick([" t1", "t2", "t3"]), pick([90.5, 10.0, None])) for _ in range(rng.randint(2, 8))]
    trace = [(pick(["POL1", "POL2", "P3", "Q", None]), pick("xy")) for _ in range(rng.randint(2, 9))]
    custom = [(pick(["C9", None]), pick(["t1", "t2"]), pick(["Baja", None])) for _ in range(rng.randint(0, 3))]
    make = lambda rows, columns, schema: conform(spark.createDataFrame(rows, columns), schema)
    return {
        "concepts": make(concepts, f"{CODE} string, {TERM} string, {DOMAIN} string, {SUBDOMAIN} string, {PRIORITY} string, dato_critico string", CONCEPTS),
        "rules": make(rules, f"{RULE_ID} string, {TERM} string, umbral_superior double", RULES),
        "trace": make(trace, f"{CODE} string, esquema string", TRACE),
        "custom": make(custom, f"{CODE} string, {TERM} string, {PRIORITY} string", CUSTOM_CONCEPTS),
    }


KEYS = {"concepts": CODE, "rules": RULE_ID, "trace": CODE, "custom": CODE}


@pytest.mark.parametrize("changed", [["concepts"], ["rules"], ["trace"], ["custom"], list(KEYS)])
@pytest.mark.parametrize("seed", [1, 2])
def test_golden_kept_current_equals_a_rebuild(spark, changed, seed):
    old, other = dictionary(spark, seed), dictionary(spark, seed + 50)
    new = {name: other[name] if name in changed else rows for name, rows in old.items()}
    diffs = {name: snapshot_diff(old[name], new[name], KEYS[name]) for name in changed}
    state = stored(incremental.code_state(coverage(**old)), "state")
    now = stored(incremental.refreshed(state, **new, diffs=diffs), "state")
    rebuilt = coverage(**new)
    assert bag(now) == bag(incremental.code_state(rebuilt))
    assert bag(incremental.quality_report_of(now, RUN)) == bag(quality_report_eager(rebuilt, RUN))
    assert bag(incremental.priority_summary_of(now, RUN)) == bag(priority_summary(rebuilt, RUN))


def test_touched_keys_and_their_concepts_are_computed_once(spark):
    old, other = dictionary(spark, 1), dictionary(spark, 51)
    diffs = {name: snapshot_diff(old[name], other[name], KEYS[name]) for name in KEYS}
    now = incremental.refreshed(stored(incremental.code_state(coverage(**old)), "state"), **other, diffs=diffs)
    assert {n for n in ("/touched-keys-", "/touched-concepts-") if any(n in path for path in now.inputFiles())} == {
        "/touched-keys-", "/touched-concepts-"
    }
    # The keys no longer depend on the differences.
    assert not any("/left-over-" in path or "/paired-keys-" in path for path in now.inputFiles())
    assert bag(now) == bag(incremental.code_state(coverage(**other)))


def test_the_query_reads_the_tables_after_the_batches_from_where_they_were_written(spark, tmp_path):
    day = datetime(2024, 1, 5)
    rows = {
        "part": [(i, f"part {i}", f"b{i % 2}", "SMALL" if i % 4 else "BIG", i % 7, 1.0) for i in range(12)],
        "customer": [(i, f"customer {i}", i % 12, 10.5 * i, "seg") for i in range(12)],
        "supplier": [(i, f"supplier {i}", i % 4, 1.0) for i in range(3)],
        "orders": [(i, i % 9, "OF"[i % 2], 5.25 * i, day, "1-URGENT") for i in range(30)],
        "lineitem": [(i, i % 12, i % 3, i % 5, 1.0, 1.0, 0.0, 0.0, "AN"[i % 2], "O", day) for i in range(40)],
    }
    for table, made in rows.items():
        spark.createDataFrame(made, mapping.TABLES[table]).write.parquet(str(tmp_path / f"{table}.parquet"))
    bronze = registry.Bronze(spark, str(tmp_path))
    state = registry._refreshed_state(bronze)
    assert not [path for path in state.inputFiles() if "/part.parquet/" in path or "/customer.parquet/" in path]
    trace = changes.apply_deletes(registry.change_update_trace(bronze), registry._deleted_trace(bronze), LINEAGE)
    rebuilt = coverage(registry._after(bronze), registry.change_update_rules(bronze), trace, bronze.custom)
    assert bag(state) == bag(incremental.code_state(rebuilt))


def test_no_change_and_unknown_tables(spark):
    tables = dictionary(spark, 1)
    state = incremental.code_state(coverage(**tables))
    assert incremental.refreshed(state, **tables, diffs={}) is state
    with pytest.raises(ValueError):
        incremental.refreshed(state, **tables, diffs={"silver": tables["rules"]})


def test_a_field_that_most_rows_share_is_looked_up_by_many_tasks(spark, frame, monkeypatch):
    rows = [(f"P{i}", "hot", "field") if i % 10 else (f"P{i}", f"t{i}", None) for i in range(4000)]
    trace = conform(frame(f"{CODE} tabla_en_fuente_oficial campo_en_fuente_oficial", *rows), TRACE)
    concepts = conform(frame(CODE, *[(f"C{i}",) for i in range(0, 4000, 3)]), CONCEPTS)
    wanted = frame("tabla campo", ("hot", "field"), ("t30", None), ("none", None))
    made = {(r.tabla, r.campo, r[CODE]) for r in metrics.codes_of_sources(wanted, trace, concepts).collect()}
    expected = {(t, f, f"C{p[1:]}") for p, t, f in rows if int(p[1:]) % 3 == 0 and (t, f) in {("hot", "field"), ("t30", None)}}
    assert made == expected

    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        monkeypatch.setattr(metrics, "join_fanout", lambda hits, codes, on, how: hits.withColumn(CODE, F.lit("x")))
        hits = metrics.codes_of_sources(wanted, trace, concepts)
        tasks = [r["count"] for r in hits.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 3601 and max(tasks) < 0.3 * sum(tasks)


def test_working_folders_are_removed(spark):
    kept = stored(spark.range(3), "kept")
    with pytest.raises(RuntimeError), working_folders(spark):
        stored(spark.range(3), "work")
        found = [shared_folder(spark, "named")]
        raise RuntimeError
    root = os.path.dirname(found[0])
    assert not [n for n in os.listdir(root) if n.startswith("work-")] and kept.count() == 3
