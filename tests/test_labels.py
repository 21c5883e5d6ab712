"""Labels, units and numerals on known lines."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, lines):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
        return [r.v for r in sorted(rows, key=lambda r: r.i)]

    return run


def test_romans(apply, spark):
    rows = spark.range(1, 4000).select(F.col("id").alias("n"), T.to_roman(F.col("id")).alias("r")).select("n", T.roman_value(F.col("r")).alias("v"), T.is_roman(F.upper("r")).alias("ok"))
    assert rows.where("n <> v OR NOT ok").count() == 0
    assert apply(T.is_roman, ["IIII", "VX", "IIX", "", "abc", "iv", "XL"]) == [False, False, False, False, False, True, True]


def test_page_numbers(apply):
    marks = {"12": 12, "2024": None, "- 3 -": 3, "–1234—": 1234, "3 / 40": 3, "Strona 7 z 9": 7, "strona7": None, "STRONA 12": 12, "str. 5": 5, "s. 4/10": 4, "s.4": 4, "iv": 4, "MCMXC": 1990, "IIII": None, "": None, "x1": None, "12 / 345": 12, "12345 / 2": None, "1 / 12345": None, "- 3": None, "3 z 4": None}
    assert dict(zip(marks, apply(T.page_number, marks), strict=True)) == marks


def test_legal_units(apply):
    lines = {
        "Art. 12a. Bank": ("article", "Art. 12a", "12a", "Bank", ""), "Art.5.": ("article", "Art. 5", "5", "", ""), "Art. 5": None, "Art. 7¹². Tekst": ("article", "Art. 7¹²", "7¹²", "Tekst", ""), "§12": ("paragraph", "§ 12", "12", "", ""),
        "§ 12 ust. 3": None, "§ 7. Postanowienia": ("paragraph", "§ 7", "7", "Postanowienia", ""), "[Art. 31. Uchylony]": ("article", "Art. 31", "31", "Uchylony]", "["), "[§ 5": None, "§ 5.tekst": None, "§ abc.": None, "§ 12abcd.": None,
        "Dział IIa": ("division", "Dział IIa", "IIa", "", ""), "DZIAŁ 3. Opłaty": ("division", "DZIAŁ 3", "3", "Opłaty", ""), "Księga pierwsza": ("book", "Księga pierwsza", "pierwsza", "", ""), "Księga 3": None, "Rozdział xyz": None, "dział I": None, "Dział": None, "": None,
    }
    assert {k: v and tuple(v) for k, v in zip(lines, apply(T.legal_unit, lines), strict=True)} == lines


def test_list_labels(apply):
    lines = {
        "1) a": ("arabicParen", 1), "2a. b": ("arabicDot", 2), "12ab) c": ("arabicParen", 12), "3¹) x": ("arabicParen", 3), "1234) x": None, "a) x": ("letterParen", 1), "aa) x": ("letterParen", 27), "b²) x": ("letterParen", 2), "– x": ("dash", None), "• x": ("bullet", None),
        "\uf0b7 x": ("bullet", None), "1.2. x": ("outline", None), "1.2 x": ("outline", None), "II. x": ("roman", 2), "XL. x": None, "iv) x": ("roman", 4), "i. x": ("letterDot", 9), "xii. x": ("romanDot", 12), "1/ x": ("arabicSlash", 1), "1a/ x": ("arabicSlash", 1), "1ab/ x": None,
        "b/ x": ("letterSlash", 2), "[1) x": ("arabicParen", 1), "[– x": None, "<a. x": None, "np. x": None, "a)": None, "i) x": ("letterParen", 9), "v) x": ("letterParen", 22), "IIII) x": None, "": None, "x": None,
    }
    got = {k: v and (v.kind, v.ordinal) for k, v in zip(lines, apply(T.list_label, lines), strict=True)}
    assert got == lines
