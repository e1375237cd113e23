from datetime import datetime

import pytest

from rows import bag
from termloom.plans import jobs
from termloom.plans.golden import quality_report_eager
from termloom.plans.silver import coverage
from termloom.schemas import CODE, CONCEPT, LINEAGE, RULE, RULE_LEGEND, TABLES
from termloom.session import shared_folder
from termloom.sources.tables import Catalog, create_tables, read_table, write_table
from termloom.streaming.arrivals import append_arrivals, arriving_rows

RUN = datetime(2026, 1, 1)
CATALOG = Catalog(raw="t_raw", bronze="t_bronze", silver="t_silver", golden="t_golden")

CONCEPTS_CSV = """Código de entidad del dato,Concepto de negocio,Término de negocio,Nombre del dominio,Dato crítico
"Identificador único secuencial, asignado al Entidad de Dato por Data Officer",l,l,l,l
CRM001,uno,A,Persona,SI
CRM002,dos,B,,NO
"""
RULES_CSV = f"""ID regla de calidad,Término de negocio,Umbral superior
{RULE_LEGEND},l,l
R1,A,95%
R2,A,"90,5"
"""
TRACE_CSV = """Código de entidad del dato,Aplicativo(s)
"Identificador único secuencial, asignado al Entidad de Dato por CDO",l
POL1,APP
"""


@pytest.fixture(scope="module")
def catalog(spark):
    create_tables(spark, CATALOG)
    create_tables(spark, CATALOG)  # a second call changes nothing
    return CATALOG


def sheets(tmp_path):
    folders = {}
    for name, text in (("c", CONCEPTS_CSV), ("r", RULES_CSV), ("t", TRACE_CSV)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "sheet.csv").write_text(text, encoding="utf-8")
        folders[name] = str(tmp_path / name)
    return folders


def test_tables_follow_their_contracts(spark, catalog):
    for (layer, table), schema in TABLES.items():
        assert read_table(spark, catalog, layer, table).schema == schema


def test_sheets_to_golden(spark, catalog, tmp_path):
    folders = sheets(tmp_path)
    for name, entity in (("c", CONCEPT), ("r", RULE), ("t", LINEAGE)):
        jobs.ingest_sheet(spark, folders[name], entity, catalog, run_ts=RUN)
    assert read_table(spark, catalog, "bronze", RULE.table).count() == 2
    jobs.build_silver(spark, catalog, RUN)
    jobs.build_golden(spark, catalog, RUN)
    report = {r.nombre_del_dominio: r for r in read_table(spark, catalog, "golden", "reporte_calidad_conceptos").collect()}
    assert (report["Persona"].total_reglas_calidad, report["Persona"].promedio_umbral_superior) == (2, 92.75)
    assert report["No Especificado"].total_conceptos == 1
    assert read_table(spark, catalog, "golden", "resumen_prioridad_dominio").count() == 2

    figures = jobs.dashboard(spark, catalog)
    totals = {r.metric: r.total for r in figures["totals"].collect()}
    assert (totals["entities"], totals["with_rule"], totals["with_trace"]) == (2, 1, 1)
    assert all(df.count() for df in figures.values())

    # appending keeps what is there, overwriting does not
    jobs.ingest_sheet(spark, folders["r"], RULE, catalog, mode="append", run_ts=RUN)
    assert read_table(spark, catalog, "bronze", RULE.table).count() == 4
    jobs.ingest_sheet(spark, folders["r"], RULE, catalog, run_ts=RUN)
    assert read_table(spark, catalog, "bronze", RULE.table).count() == 2
    with pytest.raises(ValueError):
        jobs.ingest_sheet(spark, folders["r"], RULE, catalog, mode="merge")


def test_silver_plan_reads_only_what_it_needs(spark, catalog, capsys):
    """Filters reach the scan and unused columns are not read."""
    read = {n: read_table(spark, catalog, "bronze", t) for n, t in (
        ("concepts", CONCEPT.table), ("rules", RULE.table), ("trace", LINEAGE.table), ("custom", "app_custom_concepts"))}
    quality_report_eager(coverage(**read)).explain("formatted")
    plan = capsys.readouterr().out
    assert f"IsNotNull({CODE})" in plan and f"IsNotNull({RULE.key})" in plan
    assert "Not(EqualTo" in plan
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert len(schemas) == 4
    assert not [s for s in schemas if "logica_de_calculo" in s or "descripcion_de_regla" in s or "data_owner" in s]
    trace = next(s for s in schemas if s.count(":") == 2)
    assert trace.split(":", 1)[1].strip() == f"struct<{CODE}:string>"


def test_change_bronze(spark, catalog, frame, tmp_path):
    jobs.ingest_sheet(spark, sheets(tmp_path)["c"], CONCEPT, catalog, run_ts=RUN)
    new = frame(f"{CODE} concepto_de_negocio termino_de_negocio", ("N1", "c", "t"), ("", "c", "t"))
    jobs.change_bronze(spark, CONCEPT, catalog, inserts=new, run_ts=RUN)
    columns = [CODE, *CONCEPT.updatable, "seq"]
    edit = frame(" ".join(columns), ("N1", *["z"] * len(CONCEPT.updatable), 1), types=" ".join(["string"] * (len(columns) - 1) + ["int"]))
    jobs.change_bronze(spark, CONCEPT, catalog, updates=edit, deletes=frame(CODE, ("CRM001",)), run_ts=RUN)
    rows = {r[CODE]: r.concepto_de_negocio for r in read_table(spark, catalog, "bronze", CONCEPT.table).collect()}
    assert rows == {"CRM002": "dos", "N1": "z"}
    assert not [t.name for t in spark.catalog.listTables(catalog.bronze) if "__" in t.name]


def test_insert_goes_by_position_after_conforming(spark, catalog, frame):
    rows = frame("esquema codigo_de_entidad_del_dato", ("e", "c"))
    write_table(rows, catalog, "bronze", LINEAGE.table)
    row = read_table(spark, catalog, "bronze", LINEAGE.table).first()
    assert (row[CODE], row.esquema, row.iniciativa) == ("c", "e", None)


def test_stream_takes_each_file_once_and_equals_batch(spark, tmp_path):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    (folder / "one.csv").write_text(RULES_CSV, encoding="utf-8")
    sink, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")

    def run():
        append_arrivals(arriving_rows(spark, str(folder), RULE, run_ts=RUN), sink, checkpoint).awaitTermination()
        return spark.read.schema(RULE.schema).parquet(sink)

    assert run().count() == 2
    assert run().count() == 2
    (folder / "two.csv").write_text(RULES_CSV.replace("R1", "R8").replace("R2", "R9"), encoding="utf-8")
    got = bag(run())
    batch = jobs.clean_sheet(jobs.read_sheet(spark, str(folder)), RULE, RUN)
    assert got == bag(batch) and sum(got.values()) == 4


def test_stream_into_bronze(spark, catalog, tmp_path):
    folder = sheets(tmp_path)["r"]
    before = read_table(spark, catalog, "bronze", RULE.table).count()
    checkpoint = shared_folder(spark, "checkpoint")
    for _ in range(2):
        jobs.ingest_stream(spark, folder, RULE, checkpoint, catalog, run_ts=RUN)
    assert read_table(spark, catalog, "bronze", RULE.table).count() == before + 2


def test_shared_folder_is_below_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root) and shared_folder(spark, "x") != shared_folder(spark, "x")
