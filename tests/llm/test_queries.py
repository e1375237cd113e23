"""The registered queries against their SQL, and the pipeline stage by stage."""

import os
from collections import Counter
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from termloom.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for path in glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[key](spark, SF_DIR)
    cursor = con.execute(ORACLE[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = Counter(tuple(row[names.index(n)] for n in order) for row in cursor.fetchall())
    assert Counter(tuple(r[n] for n in order) for r in df.collect()) == expected


def test_all_are_registered():
    found = entry.queries()
    assert "pipeline" in found and set(QUERIES) <= set(found)
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    from termloom.llm import quality, secrets
    from termloom.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        if name == "quality_rules":
            assert docs.count() < before and quality.judged(docs, "v").filter("not v.kept").count() == 0
        if name == "jaccard_join":
            from termloom.llm import jaccard

            near = jaccard.near_duplicates(docs)
            assert near.filter("n_links > 0 or class_id <> doc_id").count() == 0
        if name == "secret_scan":
            assert not [r for r in docs.collect() if secrets.base_spans(r.text or "")]
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    made = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(r.doc_id for r in made) == Counter({d: 0 for d, _ in texts}) + Counter(d for d, _ in texts.elements())
    assert all(r.round_trip == 1 for r in made)


def awkward(spark):
    import random

    import helpers

    rng = random.Random(2)
    stops = "the of and to in that is with for as was on"
    clean = [" ".join(rng.choice([rng.choice(stops.split()), "w%d" % rng.randint(0, 400)]) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(clean)]
    rows += [(None, clean[0], "en", None, 1), (None, clean[1] + " more", None, "a", 1), (90, None, "en", "a", 1), (91, "", "en", "a", 1)]
    rows += [(3, clean[3], "en", "b", 1), (95, 'token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa" ' + clean[4], "en", "a", 1)]
    more = "`__of` long, `__copies` string, `__row` long, `a.b` string, row string, rank int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {more}"
    docs = spark.createDataFrame([(*r, 7, "c", 8, "dot", "r", 9) for r in rows], schema).repartition(3)
    return docs, helpers.none(spark)


def test_pipeline_of_awkward_rows(spark):
    from termloom.llm.common import stored

    docs, none = awkward(spark)
    for docs_now in (docs, none):
        columns = docs_now.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_now = stored(stage(spark, docs_now, SF_DIR), f"test-{name}")
            assert docs_now.columns == columns
        made = corpus_pipeline.STAGES[-1][1](spark, docs_now, SF_DIR).collect()
        assert len(made) == docs_now.count() and all(r.round_trip == 1 for r in made)
        if columns == docs.columns:
            kept = docs_now.collect()
            assert {r.doc_id for r in kept} >= {5, 6, 7, 8} and 90 not in {r.doc_id for r in kept}
            assert {(r["__of"], r["__copies"], r["a.b"], r.rank) for r in kept} == {(7, "c", "dot", 9)}
        else:
            assert made == []


def test_rules_leave_other_languages_alone(spark):
    from termloom.llm import quality

    text = " ".join(f"słowo{i} nie{i} jest{i}" for i in range(30))
    rows = [(1, text, "pl"), (2, text, None), (3, text, "en"), (4, "a a a a a a a a a a a a a a a a", "pl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.kept_rows(docs).collect()} == {1, 2}
    assert {r.doc_id for r in quality.kept_rows(docs.drop("lang")).collect()} == {1, 2, 3}


def test_secrets_of_a_long_dense_text_take_seconds():
    import random
    import time

    from termloom.llm import secrets

    rng = random.Random(1)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    text = "\n".join(f"password={token(12)} other {token(40)}" for _ in range(16_000))
    lowest = {key: 0 for key in [(e, b) for e in range(12) for b in range(12)]}
    begun = time.time()
    base, found = secrets.all_spans(text, lowest)
    assert len(text) > 1_000_000 and len(base) == 16_000 and len(found) > 30_000 and time.time() - begun < 40
    plain = [(a, 3, b) for a, b, t in secrets.candidates(text[:20_000]) if t is not None]
    head = [s for s in base if s[0] < 20_000]
    expected = [c for c in plain if not any(a < c[2] and c[0] < b for a, _, b in head)]
    assert [s for s in secrets.all_spans(text[:20_000], lowest)[1] if s[1] == 3] == expected
