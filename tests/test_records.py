import csv
import io
import random

import pytest

from pyspark.sql import functions as F

from rows import bag
from termloom.sources.records import OPEN_QUOTE, OTHER_CELLS, cut_records, lines_of, read_records
from termloom.sources.sheets import read_sheet

SHEET = (
    'a,"b\nb",c\n1,x,y\n"2\n\n2","p""q","r\r\nr"\n"","",\n,,z\n\n'
    '"é\n""\n","line\nline\nline",3\n4,"""",""""""\n"5",6,"7\n"\n'
)


def write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8", newline="")
    return str(folder)


def splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture(autouse=True)
def settings(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_records_at_every_split_offset(spark, tmp_path):
    path = write(tmp_path / "s", one=SHEET)
    plain = list(csv.reader(io.StringIO(SHEET, newline="")))
    expected = sorted(",".join(r) for r in plain if r)
    seen = set()
    for size in [*range(1, 40), len(SHEET.encode()) // 2, 10_000]:
        splits(spark, size)
        lines = lines_of(spark.read, path)
        seen.add(lines.select("block").distinct().count())
        records = cut_records(lines).filter("record <> ''").collect()
        made = sorted(",".join(next(csv.reader(io.StringIO(r.record, newline="")))) for r in records)
        assert made == expected and all(r.closed for r in records), size
    assert len(seen) > 5


@pytest.mark.parametrize("size", [7, 23, 10_000])
def test_equals_the_one_task_reader(spark, tmp_path, size):
    path = write(tmp_path / "s", one=SHEET, two=SHEET.replace("x", "w"), three=SHEET.replace("\r", "").replace("\n", "\r\n"))
    splits(spark, size)
    good, rejects = read_records(spark, path)
    assert good.columns == read_sheet(spark, path).columns == ["a", "b\nb", "c"]
    assert bag(good) == bag(read_sheet(spark, path)) and rejects.count() == 0


def test_random_sheets(spark, tmp_path):
    rng = random.Random(4)
    for k in range(4):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["h1", "h2"])
        rows = [["".join(rng.choice('ab",\n ') for _ in range(rng.randint(1, 6))) for _ in range(2)] for _ in range(60)]
        writer.writerows(rows)
        path = write(tmp_path / f"r{k}", one=out.getvalue())
        splits(spark, rng.randint(3, 60))
        good, rejects = read_records(spark, path)
        assert rejects.count() == 0 and bag(good) == bag(spark.createDataFrame(rows, "h1 string, h2 string"))


@pytest.mark.parametrize("size", [5, 10_000])
def test_rejects_name_file_line_and_reason(spark, tmp_path, size):
    path = write(tmp_path / "s", one='h1,h2\n1,2\n"3\n3"\n4,5,6\n7,8\n', two='h1,h2\n9,"open\n10,11\n12,13\n')
    splits(spark, size)
    good, rejects = read_records(spark, path)
    assert {tuple(r) for r in good.collect()} == {("1", "2"), ("7", "8")}
    found = {(r.archivo.rsplit("/", 1)[1], r.linea, r.motivo, r.contenido) for r in rejects.collect()}
    assert found == {
        ("one.csv", 3, OTHER_CELLS, '"3\n3"'), ("one.csv", 5, OTHER_CELLS, "4,5,6"), ("two.csv", 2, OPEN_QUOTE, '9,"open'),
    }


def test_other_headers_fail(spark, tmp_path):
    path = write(tmp_path / "s", one="h1,h2\n1,2\n", two="h1,h3\n1,2\n")
    with pytest.raises(ValueError):
        read_records(spark, path, ["h1", "h2"])


def test_a_large_file_takes_many_tasks(spark, tmp_path):
    row = '"some\ntext, with ""quotes""",' + "x" * 200 + "\n"
    path = write(tmp_path / "s", one="h1,h2\n" + row * 20_000)
    splits(spark, 256 << 10)
    lines = lines_of(spark.read, path)
    assert lines.rdd.getNumPartitions() > 10
    good, rejects = read_records(spark, path)
    assert (good.count(), rejects.count()) == (20_000, 0)
    assert good.select("h1").distinct().collect()[0].h1 == 'some\ntext, with "quotes"'


def test_only_ranges_with_line_breaks_are_shuffled(spark, tmp_path):
    path = write(tmp_path / "s", one="h1,h2\n" + "1,2\n" * 3_000, two='h1,h2\n"3\n3",4\n')
    splits(spark, 4_000)
    records = cut_records(lines_of(spark.read, path))
    assert records.count() == 3_003
    quiet = records.filter(F.col("file").endswith("one.csv"))
    assert quiet.count() == 3_001 and quiet.agg(F.max("line")).first()[0] == 3_001
    # The lines of quiet ranges reach the union without an exchange, so they keep the partitions they were read in.
    assert records.rdd.getNumPartitions() > lines_of(spark.read, path).rdd.getNumPartitions()
    good, _ = read_records(spark, path)
    (folder,) = {f.rsplit("/", 1)[0] for f in good.inputFiles()}
    assert spark.read.parquet(folder).filter("record is not null").count() == 0


def test_exported_sheets_are_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from entry_support import registry

    monkeypatch.setattr(registry, "SHEET_ROWS", 100)
    spark.range(1, 1_000).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size", "1D as p_retailprice").coalesce(1).write.parquet(
        str(tmp_path / "part.parquet")
    )
    folder = registry._export_sheet(spark, str(tmp_path), "concepts")
    sheet = read_sheet(spark, folder)
    assert len(sheet.inputFiles()) >= 10 and sheet.count() == 999 + 5
