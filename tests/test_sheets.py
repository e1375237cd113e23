from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rows import bag
from termloom.operators.clean import clean_sheet, conform, drop_legend, normalise_headers
from termloom.schemas import CONCEPT, CONCEPT_LEGEND, CONCEPTS, LINEAGE, RULE, TRACE
from termloom.sources.sheets import REJECT, read_sheet, read_sheet_rows, stream_sheet

RUN = datetime(2026, 1, 1)

RULE_CSV = """ID Regla de Calidad,Término de Negocio,Umbral Superior,Columna ajena
Identificador de Regla de Calidad,leyenda,leyenda,leyenda
R1,"dos
lineas",95%,x
R2,"dice ""hola"", y",n/a,x
,nan,,
,sin clave,"0,5",
NaT,None,#N/A,null
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(RULE_CSV, encoding="utf-8")
    return tmp_path


def test_rule_sheet_end_to_end(spark, folder):
    rows = clean_sheet(read_sheet(spark, str(folder), multi_line=True), RULE, RUN)
    assert rows.schema.simpleString() == conform(rows, RULE.schema).schema.simpleString()
    assert [f.name for f in rows.schema] == [f.name for f in RULE.schema]
    got = {
        (r.id_regla_de_calidad, r.termino_de_negocio, r.umbral_superior, r.umbral_inferior, r.ingestion_date)
        for r in rows.collect()
    }
    assert got == {
        ("R1", "dos\nlineas", 95.0, None, RUN),
        ("R2", 'dice "hola", y', None, None, RUN),
        (None, "sin clave", 0.5, None, RUN),
    }


def test_many_files_and_stamp_default(spark, folder):
    (folder / "b.csv").write_text(RULE_CSV.replace("R1", "R3").replace("R2", "R4"), encoding="utf-8")
    rows = clean_sheet(read_sheet(spark, str(folder), multi_line=True), RULE)
    assert rows.count() == 6
    assert rows.filter(F.col("ingestion_date").isNull()).count() == 0


def test_file_with_other_headers_fails(spark, folder):
    (folder / "b.csv").write_text("Término de Negocio,ID Regla de Calidad,Umbral Superior,Columna ajena\nt,R9,1,\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        read_sheet(spark, str(folder)).collect()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_other_formats_read_as_text(spark, frame, tmp_path, fmt):
    df = frame("Código umbral", ("C1", 1.5), types="string double")
    df.write.mode("overwrite").format(fmt).save(str(tmp_path / fmt))
    if fmt == "json":
        with pytest.raises(ValueError, match="headers"):
            read_sheet(spark, str(tmp_path / fmt), fmt)
    back = read_sheet(spark, str(tmp_path / fmt), fmt, ["Código", "umbral"] if fmt == "json" else None)
    assert {f.dataType.simpleString() for f in back.schema} == {"string"}
    assert bag(back) == bag(frame("Código umbral", ("C1", "1.5")))


def test_trace_renames(frame):
    raw = frame("a b c", ("x", "y", "z")).toDF("Aplicativo(s)", "Sensble", "Data entry (SI/NO)")
    row = clean_sheet(raw, LINEAGE, RUN).first()
    assert (row.aplicativos, row.sensible, row.data_entry) == ("x", "y", "z")


def test_headers_with_dots_and_signs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Nro. ítem,% cumplimiento,ID `regla` de calidad,ID regla de calidad\n1,2,3,R1\nnan,,,\n", encoding="utf-8")
    raw = normalise_headers(read_sheet(spark, str(tmp_path)))
    assert raw.columns == ["nro._item", "%_cumplimiento", "id_`regla`_de_calidad", "id_regla_de_calidad"]
    rows = clean_sheet(read_sheet(spark, str(tmp_path)), RULE, RUN).collect()
    assert [r.id_regla_de_calidad for r in rows] == ["R1"]


def test_headers_that_clean_alike_are_refused(frame):
    with pytest.raises(ValueError, match="dato_critico"):
        normalise_headers(frame("a b", ("1", "2")).toDF("Dato crítico", "dato-critico"))


def test_legend_drop_keeps_null_keys(frame):
    df = frame(CONCEPT.key, (CONCEPT_LEGEND,), (None,), ("C1",))
    assert drop_legend(df, CONCEPT).count() == 2


def test_conform_orders_pads_and_is_idempotent(frame):
    df = frame("esquema extra iniciativa", ("e", "x", "i"))
    once = conform(df, TRACE)
    assert once.columns == TRACE.names and once.schema == TRACE
    assert bag(conform(once, TRACE)) == bag(once)


def test_conform_never_reads_text_as_number(frame):
    with pytest.raises(Exception):
        conform(frame("umbral_superior", ("95%",)), RULE.schema)


def test_concepts_sheet_from_text_columns_only(frame):
    rows = clean_sheet(frame("Personal", ("SI",)), CONCEPT, RUN)
    assert rows.schema.simpleString() == CONCEPTS.simpleString()


def test_malformed_rows_are_refused_or_returned(spark, tmp_path):
    text = 'ID regla de calidad,Término de negocio\nR1,"line one\nline two"\nR2,B,EXTRA\nR3\nR4,D\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        read_sheet(spark, str(tmp_path)).collect()
    rows, rejects = read_sheet_rows(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {("R1", "line one\nline two"), ("R4", "D")}
    assert {r[REJECT].strip() for r in rejects.collect()} == {"R2,B,EXTRA", "R3"}


def test_typed_parquet_streams(spark, frame, tmp_path):
    frame("k umbral", ("C1", 1.5), types="string double").write.parquet(str(tmp_path / "in"))
    raw = stream_sheet(spark, str(tmp_path / "in"), fmt="parquet")
    query = raw.writeStream.format("memory").queryName("typed").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("typed").collect()] == [("C1", "1.5")]
