"""Bronze tables that are changed by the bucket, filled once by each batch of a stream, and keep what cannot be read."""

import os
from datetime import datetime
from glob import glob

import pytest
from pyspark.sql import functions as F

from rows import bag
from termloom.operators.changes import apply_deletes, apply_inserts, apply_updates
from termloom.plans import jobs
from termloom.schemas import CODE, CONCEPT, LAYERS, REJECTED_TABLE, RULE
from termloom.session import TASK_BYTES, shared_folder
from termloom.sources import tables
from termloom.sources.tables import BUCKET, Catalog, create_tables, read_table, write_table
from termloom.streaming import arrivals

RUN = datetime(2026, 1, 1)


@pytest.fixture
def catalog(spark, request):
    made = Catalog(**{layer: f"{layer}_{abs(hash(request.node.name))}" for layer in LAYERS})
    create_tables(spark, made, location=shared_folder(spark, "tables"), buckets=8)
    return made


def concepts(frame, n=60):
    rows = [(f"CRM{i:03}", f"c{i}", f"t{i}") for i in range(n)] + [(None, "none", "t"), (None, "none", "t"), ("CRM001", "again", "t")]
    return frame(f"{CODE} concepto_de_negocio termino_de_negocio", *rows)


def edits(frame, *codes):
    columns = [CODE, *CONCEPT.updatable, "seq"]
    return frame(
        " ".join(columns), *[(c, *["z"] * len(CONCEPT.updatable), 1) for c in codes],
        types=" ".join(["string"] * (len(columns) - 1) + ["int"]),
    )


def files(spark, catalog, table):
    where = spark.sql(f"DESCRIBE FORMATTED {catalog.table_name('bronze', table)}").filter("col_name = 'Location'").first().data_type
    found = glob(f"{where.removeprefix('file:')}/**/*.parquet", recursive=True)
    return {path: os.stat(path).st_mtime_ns for path in found}


def stored_rows(spark, catalog, entity=CONCEPT):
    return read_table(spark, catalog, "bronze", entity.table)


def test_changes_leave_other_buckets_alone(spark, catalog, frame):
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    base = stored_rows(spark, catalog).persist()
    base.count()
    before = files(spark, catalog, CONCEPT.table)
    updates, deletes = edits(frame, " CRM001 ", "CRM404"), frame(CODE, ("CRM007",), (None,), (" ",))
    jobs.change_bronze(spark, CONCEPT, catalog, updates=updates, deletes=deletes, run_ts=RUN)
    after = files(spark, catalog, CONCEPT.table)
    untouched = {p for p in before if after.get(p) == before[p]}
    gone = {p.split(f"{BUCKET}=")[1].split("/")[0] for p in before if p not in after}
    assert 0 < len(gone) <= 3 and len(untouched) >= len(before) - 3
    expected = apply_updates(apply_deletes(base, deletes, CONCEPT), updates, CONCEPT, "seq", RUN)
    assert bag(stored_rows(spark, catalog)) == bag(expected)
    base.unpersist()


def key_order(spark, catalog):
    found = files(spark, catalog, CONCEPT.table)
    return [[r[0] for r in spark.read.parquet(path).select(CODE).collect()] for path in found]


def test_files_are_in_the_order_of_the_key(spark, catalog, frame):
    mixed = concepts(frame, 600).withColumn("n", F.xxhash64("concepto_de_negocio")).orderBy("n").drop("n")
    write_table(mixed, catalog, "bronze", CONCEPT.table)
    base = bag(stored_rows(spark, catalog))
    written = key_order(spark, catalog)
    assert max(map(len, written)) > 20 and sum(map(len, written)) == 603
    assert all(keys == sorted(keys, key=lambda k: k or "") for keys in written)
    jobs.change_bronze(spark, CONCEPT, catalog, deletes=mixed.select(CODE).filter(f"{CODE} like '%7'"), run_ts=RUN)
    changed = key_order(spark, catalog)
    assert sum(map(len, changed)) == 543 and base > bag(stored_rows(spark, catalog))
    assert all(keys == sorted(keys, key=lambda k: k or "") for keys in changed)


def test_a_change_is_written_by_smaller_tasks(spark, catalog, frame, monkeypatch):
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    usual, seen, overwriting = spark.conf.get(TASK_BYTES), [], tables._overwriting

    def noted(session, mode):
        seen.append(session.conf.get(TASK_BYTES))
        return overwriting(session, mode)

    monkeypatch.setattr(tables, "_overwriting", noted)
    jobs.change_bronze(spark, CONCEPT, catalog, deletes=frame(CODE, ("CRM007",)), run_ts=RUN)
    assert seen == ["32m"] and spark.conf.get(TASK_BYTES) == usual and spark.conf.get(TASK_BYTES, None) is None
    spark.conf.set(TASK_BYTES, "5m")
    try:
        jobs.change_bronze(spark, CONCEPT, catalog, deletes=frame(CODE, ("CRM008",)), run_ts=RUN)
        assert seen == ["32m", "5m"] and spark.conf.get(TASK_BYTES) == "5m"
    finally:
        spark.conf.unset(TASK_BYTES)


def test_a_batch_of_all_kinds(spark, catalog, frame):
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    base = spark.createDataFrame(stored_rows(spark, catalog).collect(), CONCEPT.schema)
    updates, deletes = edits(frame, "CRM002", "CRM003"), frame(CODE, *[(f"CRM{i:03}",) for i in range(20, 60)])
    new = frame(f"{CODE} concepto_de_negocio termino_de_negocio", ("N1", "c", "t"), ("CRM021", "back", "t"), ("", "c", "t"))
    jobs.change_bronze(spark, CONCEPT, catalog, inserts=new, updates=updates, deletes=deletes, run_ts=RUN)
    expected = apply_inserts(apply_updates(apply_deletes(base, deletes, CONCEPT), updates, CONCEPT, "seq", RUN), new, CONCEPT, RUN)
    assert bag(stored_rows(spark, catalog)) == bag(expected)


def test_emptied_buckets_are_dropped(spark, catalog, frame):
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    everything = stored_rows(spark, catalog).select(CODE)
    jobs.change_bronze(spark, CONCEPT, catalog, deletes=everything, run_ts=RUN)
    assert {r[CODE] for r in stored_rows(spark, catalog).collect()} == {None}
    assert len({os.path.dirname(p) for p in files(spark, catalog, CONCEPT.table)}) == 1


def test_changes_without_keys_change_nothing(spark, catalog, frame):
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    before = files(spark, catalog, CONCEPT.table)
    jobs.change_bronze(spark, CONCEPT, catalog, deletes=frame(CODE, (None,), ("  ",)), run_ts=RUN)
    jobs.change_bronze(spark, CONCEPT, catalog, run_ts=RUN)
    assert files(spark, catalog, CONCEPT.table) == before


def test_one_write_for_a_batch(spark, catalog, frame, monkeypatch):
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    monkeypatch.setattr(jobs, "rewrite_table", None)
    jobs.change_bronze(spark, CONCEPT, catalog, deletes=frame(CODE, ("CRM007",)), run_ts=RUN)
    assert not [t.name for t in spark.catalog.listTables(catalog.bronze) if "__" in t.name]


def test_a_table_without_buckets_is_rewritten(spark, catalog, frame):
    name = catalog.table_name("bronze", CONCEPT.table)
    spark.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CONCEPT.schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet")
    write_table(concepts(frame), catalog, "bronze", CONCEPT.table)
    jobs.change_bronze(spark, CONCEPT, catalog, deletes=frame(CODE, ("CRM001",)), run_ts=RUN)
    assert stored_rows(spark, catalog).count() == 61


SHEET = 'ID regla de calidad,Término de negocio,Umbral superior\n{}1,A,95%\n{}2,"A\nB","90,5"\n{}3,A\n,,\n'
ODD = "{}4,A,1,2\n"


def sheet(folder, name, mark, more=""):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.csv").write_text((SHEET + more).replace("{}", mark), encoding="utf-8")
    return str(folder)


def kept_rejects(spark, catalog):
    return {(r.tabla, r.linea, r.contenido) for r in read_table(spark, catalog, "bronze", REJECTED_TABLE).collect()}


def test_rejects_are_kept_and_counts_add_up(spark, catalog, tmp_path):
    made = jobs.ingest_sheet(spark, sheet(tmp_path / "s", "one", "R", ODD), RULE, catalog, run_ts=RUN)
    assert made == jobs.Ingested(records=5, loaded=2, rejected=2, dropped=1)
    assert stored_rows(spark, catalog, RULE).count() == 2
    assert kept_rejects(spark, catalog) == {("reglas_calidad", 5, "R3,A"), ("reglas_calidad", 7, "R4,A,1,2")}


def take(spark, folder, catalog, checkpoint, **more):
    jobs.ingest_stream(spark, folder, RULE, checkpoint, catalog, run_ts=RUN, **more)
    return sorted(r.id_regla_de_calidad for r in stored_rows(spark, catalog, RULE).collect())


def test_stream_keeps_rejects_and_takes_files_once(spark, catalog, tmp_path):
    folder, checkpoint = sheet(tmp_path / "s", "one", "R", ODD), shared_folder(spark, "checkpoint")
    assert take(spark, folder, catalog, checkpoint) == ["R1", "R2"]
    assert take(spark, folder, catalog, checkpoint) == ["R1", "R2"]
    sheet(tmp_path / "s", "two", "S")
    assert take(spark, folder, catalog, checkpoint, max_files_per_trigger=1) == ["R1", "R2", "S1", "S2"]
    assert {c for _, _, c in kept_rejects(spark, catalog)} == {"R3,A", "R4,A,1,2", "S3,A"}


def test_a_batch_that_fails_after_its_insert_is_there_once(spark, catalog, tmp_path, monkeypatch):
    folder, checkpoint = sheet(tmp_path / "s", "one", "R", ODD), shared_folder(spark, "checkpoint")
    inserted = []

    def then_fail(df, where, layer, table, **more):
        write_table(df, where, layer, table, **more)
        inserted.append(table)
        if table == RULE.table and inserted.count(RULE.table) == 1:
            raise RuntimeError("lost before the checkpoint")

    monkeypatch.setattr(arrivals, "write_table", then_fail)
    with pytest.raises(Exception, match="lost before the checkpoint"):
        take(spark, folder, catalog, checkpoint)
    spark.catalog.refreshTable(catalog.table_name("bronze", RULE.table))
    assert stored_rows(spark, catalog, RULE).count() == 2
    assert take(spark, folder, catalog, checkpoint) == ["R1", "R2"]
    assert inserted.count(RULE.table) == 2 and len(kept_rejects(spark, catalog)) == 2


def test_changes_reach_rows_of_every_load(spark, catalog, tmp_path, frame):
    checkpoint = shared_folder(spark, "checkpoint")
    folder = sheet(tmp_path / "s", "one", "R")
    jobs.ingest_sheet(spark, folder, RULE, catalog, run_ts=RUN)
    take(spark, folder, catalog, checkpoint)
    jobs.change_bronze(spark, RULE, catalog, deletes=frame("id_regla_de_calidad", ("R1",)), run_ts=RUN)
    assert take(spark, folder, catalog, checkpoint) == ["R2", "R2"]
