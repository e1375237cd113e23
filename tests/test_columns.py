import pytest
from pyspark.sql import functions as F

from termloom.functions import (
    clean_text, has_yes, header_name, null_tokens, numeric_id, parse_number, plain_number, yes_no,
)
from termloom.schemas import NULL_TOKENS, YES_SPELLINGS


@pytest.mark.parametrize(
    "header, name",
    [
        (" Código de Entidad (del dato)", "codigo_de_entidad_del_dato"),
        ("Dato-Crítico?", "dato_critico"),
        ("Aplicativo(s)", "aplicativo_s"),
        ("AÑO\n[2024]", "ano_2024"),
        ("Data\xa0entry (SI/NO)", "data_entry_si_no"),
        ("#Ítem  / N°", "item_n°"),
        ("% cumplimiento.", "%_cumplimiento."),
        ("¿Personal?", "¿personal"),
        ("__ya_limpio__", "ya_limpio"),
        ("a _b", "a__b"),
        (7, "7"),
    ],
)
def test_header_name(header, name):
    assert header_name(header) == name


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_null_tokens(frame):
    df = frame("c", *[(t,) for t in NULL_TOKENS], (None,), ("nan ",), ("x",), (" ",))
    assert values(df, null_tokens(F.col("c")))[-3:] == ["nan ", "x", " "]
    assert set(values(df, null_tokens(F.col("c")))[:-3]) == {None}


def test_parse_number(frame):
    cases = {
        "95%": 95.0, "0,95": 0.95, "1.234,5": None, "n/a": None, "": None, None: None, " 12 ": 12.0,
        "-3,5%": -3.5, "1e2": 100.0, "NaN": None, "Infinity": None, "1d": None, "5 0": None, ".5": 0.5, "1e999": None,
    }
    df = frame("c", *[(t,) for t in cases])
    assert values(df, parse_number(F.col("c"))) == list(cases.values())


def test_plain_number_rejects_sheet_spellings(frame):
    df = frame("c", ("0,5",), ("95%",), ("0.5",))
    assert values(df, plain_number(F.col("c"))) == [None, None, 0.5]


def test_numeric_id(frame):
    cases = {
        "CRM00001": 1, "CRM001": 1, "001": 1, "POL": None, "": None, None: None, "A12B": None, "A12B7": 7,
        "X12345678901": 12345678901, "X" + "9" * 30: None,
    }
    df = frame("c", *[(t,) for t in cases])
    assert values(df, numeric_id(F.col("c"))) == list(cases.values())


def test_yes_no(frame):
    df = frame("c", *[(t,) for t in YES_SPELLINGS], (" si ",), ("Si",), ("SÍ",), ("s",), ("\tSI",), ("",), (None,))
    assert values(df, yes_no(F.col("c"))) == ["Sí"] * 6 + ["No"] * 6
    assert values(df, has_yes(F.col("c"), ("s",))) == [False] * 8 + [True] + [False] * 3


def test_clean_text(frame):
    df = frame("c", (" a b ",), ("\t\n",), ("\xa0x ",), ("",), (None,))
    assert values(df, clean_text(F.col("c"))) == ["a b", None, "x", None, None]
