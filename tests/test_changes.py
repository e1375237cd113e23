from datetime import datetime

import pytest

from rows import bag
from termloom.operators.changes import (
    accepted, apply_deletes, apply_inserts, apply_updates, check_changes, rejected,
)
from termloom.operators.clean import conform
from termloom.schemas import CODE, CONCEPT, CONCEPTS, DOMAIN, LINEAGE, PRIORITY, RULE, RULES, TRACE

OLD, RUN = datetime(2025, 1, 1), datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def table(frame):
    rows = [("C1", "t", "Sí", "logic"), ("C1", "u", None, None), (" C2", "t", None, None), (None, "t", None, None)]
    return conform(
        frame(f"{CODE} termino_de_negocio personal logica_de_calculo ingestion_date", *[(*r, OLD) for r in rows],
              types="string string string string timestamp"), CONCEPTS)


def test_insert_required_and_choices(frame):
    df = frame(
        f"{CODE} concepto_de_negocio termino_de_negocio {PRIORITY} personal",
        ("A1", "c", "t", "Alta", "SI"), ("A2", "c", "t", "", None), ("", "c", None, "Media", "NO"),
        ("A3", "  ", "t", "Urgente", "Sí"), ("A4", "c", "t", "alta", ""),
    )
    checked = {r[CODE]: r for r in check_changes(df, CONCEPT).collect()}
    assert checked["A1"].accepted and checked["A2"].accepted
    assert checked[""].missing_fields == [CODE, "termino_de_negocio"]
    assert checked["A3"].missing_fields == [] and checked["A3"].bad_values == [PRIORITY, "personal"]
    assert checked["A4"].bad_values == [PRIORITY]
    assert accepted(df, CONCEPT).count() + rejected(df, CONCEPT).count() == 5


def test_insert_takes_only_named_columns(frame, table):
    new = frame(f"{CODE} concepto_de_negocio termino_de_negocio logica_de_calculo data_owner",
                (" N1 ", "c'x", "  ", "ignored", ""))
    out = apply_inserts(table, new, CONCEPT, RUN)
    row = out.filter(f"{CODE} = 'N1'").first()
    assert out.count() == 5 and out.schema == CONCEPTS
    assert (row.concepto_de_negocio, row.termino_de_negocio, row.logica_de_calculo, row.data_owner) == ("c'x", None, None, None)
    assert row.ingestion_date == RUN


def test_insert_then_delete_is_identity(frame, table):
    new = frame(f"{CODE} concepto_de_negocio termino_de_negocio", ("N1", "c", "t"), ("N1", "c", "t"))
    out = apply_deletes(apply_inserts(table, new, CONCEPT, RUN), frame(CODE, ("N1",)), CONCEPT)
    assert bag(out) == bag(table)


def concept_edit(frame, *rows):
    cols = [CODE, *CONCEPT.updatable, "seq"]
    return frame(" ".join(cols), *rows, types=" ".join(["string"] * (len(cols) - 1) + ["int"]))


def test_update_all_rows_of_key_last_sequence_wins_null_overwrites(frame, table):
    fill = [None] * (len(CONCEPT.updatable) - 2)
    edits = concept_edit(
        frame, (" C1 ", "old", "x", *fill, 1), ("C1", " new ", " ", *fill, 2), ("C2", "no match", "x", *fill, 1),
        (None, "null key", "x", *fill, 9), ("  ", "blank key", "x", *fill, 9),
    )
    out = apply_updates(table, edits, CONCEPT, "seq", RUN)
    assert out.schema == CONCEPTS
    rows = out.collect()
    changed = [r for r in rows if r[CODE] == "C1"]
    assert [(r.concepto_de_negocio, r.termino_de_negocio, r.ingestion_date) for r in changed] == [("new", None, RUN)] * 2
    assert sorted((r.logica_de_calculo for r in changed), key=str) == [None, "logic"]
    assert all(r.ingestion_date == OLD for r in rows if r[CODE] != "C1") and len(rows) == 4


def test_update_does_not_check_choices_but_needs_columns(frame, table):
    row = [None] * len(CONCEPT.updatable)
    row[CONCEPT.updatable.index(PRIORITY)] = "Urgente"
    out = apply_updates(table, concept_edit(frame, ("C1", *row, 1)), CONCEPT, "seq", RUN)
    assert {r[PRIORITY] for r in out.filter(f"{CODE} = 'C1'").collect()} == {"Urgente"}
    with pytest.raises(ValueError, match=DOMAIN):
        apply_updates(table, concept_edit(frame).drop(DOMAIN), CONCEPT, "seq", RUN)


def test_rule_numbers(frame):
    rules = conform(frame("id_regla_de_calidad umbral_superior", ("R1", 1.0), ("R2", 2.0), types="string double"), RULES)
    cols = ["id_regla_de_calidad", *RULE.updatable, "seq"]
    edits = frame(
        " ".join(cols), ("R1", "t", None, None, None, " 0.5 ", "", 1), ("R2", "t", None, None, None, "95%", "1", 1),
        types="string string string string string string string int",
    )
    rows = {r.id_regla_de_calidad: r for r in apply_updates(rules, edits, RULE, "seq", RUN).collect()}
    assert (rows["R1"].umbral_superior, rows["R1"].umbral_inferior) == (0.5, None)
    assert rows["R2"].umbral_superior == 2.0  # the whole edit is refused
    assert rejected(edits, RULE, inserting=False).first().bad_values == ["umbral_superior"]
    typed = frame("id_regla_de_calidad termino_de_negocio umbral_superior", ("R3", "t", 7.5), types="string string double")
    assert apply_inserts(rules, typed, RULE, RUN).filter("id_regla_de_calidad = 'R3'").first().umbral_superior == 7.5


def test_trace_insert_and_update(frame):
    trace = conform(frame(f"{CODE} aplicativos esquema", ("P1", "a", "e"), ("P1", "b", "f")), TRACE)
    edits = frame(" ".join([CODE, *LINEAGE.updatable, "seq"]), ("P1", *"nxftcdp", 1), types=" ".join(["string"] * 8 + ["int"]))
    rows = apply_updates(trace, edits, LINEAGE, "seq", RUN).collect()
    assert [(r.aplicativos, r.periodicidad_de_actualizacion) for r in rows] == [("x", "p")] * 2
    assert sorted(r.esquema for r in rows) == ["e", "f"]
    out = apply_inserts(trace, frame(f"{CODE} aplicativos", ("P2", "z"), ("", "z"), (None, "z")), LINEAGE, RUN)
    assert out.count() == 3


def test_delete_keys_are_exact_and_null_safe(frame, table):
    kept = apply_deletes(table, frame(CODE, (" C1 ",), (None,), ("",), ("C2",)), CONCEPT)
    assert sorted((r[CODE] for r in kept.collect()), key=str) == [" C2", None]
