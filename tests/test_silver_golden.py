import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rows import bag
from termloom.operators.clean import conform
from termloom.plans import golden, metrics, silver
from termloom.schemas import (
    CODE, CONCEPT_LEGEND, CONCEPTS, CUSTOM_CONCEPTS, DOMAIN, PRIORITY_SUMMARY, QUALITY_REPORT, RULE_LEGEND, RULES,
    SILVER, SUBDOMAIN, TRACE, TRACE_LEGEND,
)

RUN = datetime(2026, 1, 1)


def quality_report_plain(wide, run_ts=None):
    """The report as a single aggregation with four distinct counts, to hold the others against."""
    report = golden.golden_rows(wide).groupBy(DOMAIN, SUBDOMAIN).agg(
        F.count_distinct(CODE).alias("total_conceptos"),
        *[F.count_distinct(F.when(F.col(flag) == "Sí", F.col(CODE))).alias(t) for flag, t in golden.TOTALS.items()],
        F.count("id_regla_de_calidad").alias("total_reglas_calidad"),
        *[F.coalesce(F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 4), F.lit(0.0)).alias(name) for c, name in golden.AVERAGES.items()],
    )
    return conform(report.withColumn("ultimo_procesamiento", F.lit(run_ts).cast("timestamp")), QUALITY_REPORT)


def bronze(frame, concepts=(), rules=(), trace=(), custom=()):
    return {
        "concepts": conform(
            frame(f"{CODE} termino_de_negocio {DOMAIN} {SUBDOMAIN} dato_critico personal sensible "
                  "prioridad_del_entidad_de_dato concepto_de_negocio definicion_de_negocio",
                  *[(*c, *[None] * (10 - len(c))) for c in concepts]), CONCEPTS),
        "rules": conform(
            frame("id_regla_de_calidad termino_de_negocio umbral_superior umbral_inferior principio_de_calidad_asociado",
                  *[(*r, *[None] * (5 - len(r))) for r in rules], types="string string double double string"), RULES),
        "trace": conform(
            frame(f"{CODE} tabla_en_fuente_oficial fecha_de_actualizacion_en_el_diccionario_tecnico aplicativos",
                  *[(*t, *[None] * (4 - len(t))) for t in trace]), TRACE),
        "custom": conform(frame(f"{CODE} termino_de_negocio dato_critico", *custom), CUSTOM_CONCEPTS),
    }


@pytest.fixture(scope="module")
def small(frame):
    return bronze(
        frame,
        concepts=[
            (" CRM00001 ", "A", "D1", "S1", "SI", None, " sí ", "Alta", "uno", "def"),
            ("CRM1", " A ", "D1", "S1", "Si"),
            ("SIN", "B", None, None, "S", "S", "S"),
            ("POL2", None, "D2", "S2", None, None, None, None, "dos", " "),
            (CONCEPT_LEGEND, "A", "D1"), ("   ", "A", "D1"), (None, "A", "D1"),
        ],
        rules=[
            ("R1", " A ", 95.0, 1.0, "Validez"), ("R2", "A", 90.5, None), ("R3", "B", None, None, "Validez"),
            (RULE_LEGEND, "A", 1.0, 1.0), (" ", "A", 1.0, 1.0), (None, "A", 1.0, 1.0), ("R4", None, 5.0, 5.0),
        ],
        trace=[
            ("001", "T1", "2024-05-01", "APP"), ("XX1 ", "T2", "29/04/2026"), ("POL", "T3"), ("ZZ7", "T4"),
            (TRACE_LEGEND, "T"), (" ", "T"), (None, "T"),
        ],
        custom=[("CUS1", "A", "SI"), (None, "B", "NO"), ("  ", " A", "S")],
    )


def test_silver_rows(small):
    rows = silver.silver(**small, run_ts=RUN)
    assert rows.schema.simpleString() == SILVER.simpleString()
    got = [
        (r[CODE], r.id_regla_de_calidad, r.tabla_en_fuente_oficial, r.is_custom_concept) for r in rows.collect()
    ]
    assert sorted(got, key=str) == sorted(
        [
            # one concept, two trace rows, two rules: four rows
            ("CRM00001", "R1", "T1", False), ("CRM00001", "R2", "T1", False),
            ("CRM00001", "R1", "T2", False), ("CRM00001", "R2", "T2", False),
            # a concept term with outer blanks finds no rule
            ("CRM1", None, "T1", False), ("CRM1", None, "T2", False),
            ("SIN", "R3", None, False), ("POL2", None, None, False),
            # entered by hand: never traced, not trimmed, not filtered
            ("CUS1", "R1", None, True), ("CUS1", "R2", None, True),
            (None, "R3", None, True), ("  ", None, None, True),
        ],
        key=str,
    )


def test_silver_dates_and_stamp(small):
    rows = silver.silver(**small, run_ts=RUN)
    dates = {r.tabla_en_fuente_oficial: r.fecha_actualizacion_diccionario for r in rows.collect()}
    assert dates["T1"] == datetime(2024, 5, 1) and dates["T2"] is None
    assert {r.ingestion_date for r in rows.collect()} == {RUN}


def test_trim_terms_option(small):
    rows = silver.silver(**small, trim_terms=True)
    assert rows.filter((F.col(CODE) == "CRM1") & F.col("id_regla_de_calidad").isNotNull()).count() == 4


def test_quality_report_values(small):
    report = {r[SUBDOMAIN]: r for r in golden.quality_report(silver.silver(**small), RUN).collect()}
    s1 = report["S1"]
    assert (s1.total_conceptos, s1.total_datos_criticos, s1.total_datos_sensibles) == (2, 1, 1)
    assert (s1.total_reglas_calidad, s1.promedio_umbral_superior, s1.promedio_umbral_inferior) == (4, 92.75, 1.0)
    assert report["S2"].total_reglas_calidad == 0 and report["S2"].promedio_umbral_superior == 0.0
    none = report["No Especificado"]
    assert (none.total_conceptos, none.total_datos_criticos, none.total_reglas_calidad) == (3, 3, 4)
    assert none.ultimo_procesamiento == RUN


def test_distinct_rules_option(small):
    report = golden.quality_report(silver.silver(**small), RUN, distinct_rules=True)
    assert {r[SUBDOMAIN]: r.total_reglas_calidad for r in report.collect()} == {"S1": 2, "S2": 0, "No Especificado": 3}


def random_bronze(frame, seed):
    rng = random.Random(seed)
    pick = rng.choice
    flags = ["SI", "si", " S ", "NO", "Si", "", None]
    return bronze(
        frame,
        concepts=[
            (pick(["CRM", "POL"]) + pick(["", "1", "02", "3", "4", "005"]), pick(["A", "B", "C", " A", None]),
             pick(["D1", "D2", None]), pick(["S1", "S2", None]), pick(flags), pick(flags), pick(flags),
             pick(["Alta", "Baja", None]), pick(["c", None, " "]), pick(["d", ""]))
            for _ in range(60)
        ],
        rules=[
            (f"R{i}", pick(["A", " B", "C ", "Z", None]), pick([1.5, 99.9999, 33.3333, None]),
             pick([0.1, 0.2, -7.0, None]), pick(["P1", "P2", None]))
            for i in range(25)
        ],
        trace=[(pick(["T1", "X02", "Y3", "Z9", "SIN"]), pick(["a", "b", None])) for _ in range(50)],
        custom=[(pick(["CUS1", "CUS2", None]), pick(["A", "B", None]), pick(flags)) for _ in range(15)],
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_three_forms_of_the_report_agree(frame, seed):
    tables = random_bronze(frame, seed)
    wide = silver.silver(**tables, run_ts=RUN, hot_rows=5)
    plain = bag(quality_report_plain(wide, RUN))
    assert bag(golden.quality_report(wide, RUN)) == plain
    assert bag(golden.quality_report_eager(silver.coverage(**tables), RUN)) == plain
    assert bag(golden.quality_report(wide.repartition(7).orderBy(F.rand(3)), RUN)) == plain
    assert bag(golden.priority_summary(wide, RUN)) == bag(golden.priority_summary(silver.coverage(**tables), RUN))


@pytest.mark.parametrize("values, expected", [
    ([0.123456789, 0.123456789], 0.1235),  # more decimals than the exact sum holds
    ([1e20, 3e20], 2e20),  # too large for it
    ([float("nan"), 2.0], 2.0), ([None], 0.0), ([33.33335], 33.3334),
])
def test_average_of_unusual_numbers(frame, values, expected):
    tables = bronze(frame, concepts=[("C1", "A")], rules=[(f"R{i}", "A", v) for i, v in enumerate(values)])
    wide = silver.silver(**tables)
    for report in (
        golden.quality_report(wide), quality_report_plain(wide),
        golden.quality_report_eager(silver.coverage(**tables)),
    ):
        assert report.first().promedio_umbral_superior == expected


def test_contracts(small):
    wide = silver.silver(**small)
    assert golden.quality_report(wide).schema.simpleString() == QUALITY_REPORT.simpleString()
    assert golden.priority_summary(wide).schema.simpleString() == PRIORITY_SUMMARY.simpleString()


def test_fill_defaults_leaves_blanks(frame):
    df = frame(f"{DOMAIN} dato_critico", (None, None), ("", " "))
    assert [tuple(r) for r in golden.fill_defaults(df).collect()] == [("No Especificado", "No"), ("", " ")]


# --- metrics over the same rows ------------------------------------------------


@pytest.mark.parametrize("seed", [4])
def test_dashboard_from_coverage_equals_silver(frame, seed):
    """Counts taken from compact rows equal those taken from the joined rows."""
    tables = random_bronze(frame, seed)
    base = silver.all_concepts(tables["concepts"], tables["custom"])
    wide = golden.golden_rows(silver.join_trace_and_rules(base, tables["trace"], tables["rules"]))
    cov = silver.coverage(**tables)
    totals = {r.metric: r.total for r in metrics.dashboard_totals(cov).collect()}

    def distinct(condition="true"):
        return wide.filter(condition).select(CODE).dropna().distinct().count()

    assert totals["entities"] == distinct()
    assert totals["critical"] == distinct("dato_critico = 'Sí'")
    assert totals["with_rule"] == distinct("id_regla_de_calidad is not null")
    assert totals["with_trace"] == distinct("has_trace")
    assert totals["domains"] == base.select(DOMAIN).dropna().distinct().count()
    assert totals["subdomains"] == base.select(DOMAIN, SUBDOMAIN).dropna().distinct().count()

    by_rule = wide.filter("id_regla_de_calidad is not null").groupBy(
        F.coalesce("principio_de_calidad_asociado", F.lit("Sin principio")).alias("principio"), DOMAIN
    ).agg(F.count_distinct("id_regla_de_calidad").alias("n"))
    assert bag(metrics.rules_by_principle(base, tables["rules"])) == bag(by_rule)


def test_completeness(small):
    rows = {r[SUBDOMAIN]: r for r in metrics.completeness(silver.coverage(**small)).collect()}
    s1 = rows["S1"]
    assert (s1.total, s1.sin_concepto, s1.sin_regla, s1.sin_trazabilidad) == (2, 1, 1, 0)
    assert (s1.pct_concepto, s1.pct_trazabilidad) == (50.0, 100.0)


def test_priority_share(small):
    rows = {r.prioridad_del_entidad_de_dato: (r.n, r.share) for r in metrics.priority_share(silver.coverage(**small)).collect()}
    assert rows == {"Alta": (1, 0.1667), "Media": (5, 0.8333)}


def test_top_latest_and_kpi(small, frame):
    top = metrics.top_domains(small["concepts"], limit=2).collect()
    assert [tuple(r) for r in top] == [("D1", 5), ("D2", 1)]
    kpi = {r.table: r.total for r in metrics.kpi_counts({"a": small["rules"], "b": small["trace"]}).collect()}
    assert kpi == {"a": 7, "b": 7}
    df = frame("k ingestion_date", ("a", 1), ("b", 3), ("c", None), ("d", 3), types="string int")
    assert [r.k for r in metrics.latest_records(df, limit=3).collect()] == ["b", "d", "a"]
    assert [r.k for r in metrics.latest_records(df).collect()][-2:] == ["a", "c"]
    assert metrics.latest_records(df, order_by=None).count() == 4
    newest = metrics.last_update({"t": df}).first()
    assert (newest.table, newest.last_update) == ("t", 3)


def test_lineage_both_ways(small, frame):
    forward = metrics.lineage_of_codes(small["concepts"], small["trace"])
    assert {(r[CODE], r.tabla) for r in forward.collect()} == {
        ("CRM00001", "T1"), ("CRM00001", "T2"), ("CRM1", "T1"), ("CRM1", "T2"),
    }
    back = metrics.codes_of_sources(frame("tabla campo", ("T2", None), ("T4", None)), small["trace"], small["concepts"])
    assert {(r.tabla, r[CODE]) for r in back.collect()} == {("T2", "CRM00001"), ("T2", "CRM1")}
