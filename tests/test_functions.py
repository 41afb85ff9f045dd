import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from offerlake.functions import export_text as E
from offerlake.functions import keys as K
from offerlake.functions import numbers as N
from offerlake.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize("raw,expected", [
    ("1.234,56 EUR", "1234.5600"), ("€ 12,5", "12.5000"), ("1.2.3", "12.3000"), ("-7,00", "-7.0000"), ("−7,00", "-7.0000"),
    ("abc", None), ("-", None), ("1.234", "1.2340"),
])
def test_european_decimals(spark, raw, expected):
    got = one(spark, N.eu_decimal, raw)
    assert got == (None if expected is None else Decimal(expected))


def test_three_lenient_readings(spark):
    assert one(spark, lambda c: N.lenient_decimal(c, "check"), "1.234,50 EUR") == Decimal("1234.5000")
    assert one(spark, lambda c: N.lenient_decimal(c, "store"), "1.234,50 EUR") is None
    assert one(spark, lambda c: N.lenient_decimal(c, "export"), "1 234,50") == Decimal("1234.5000")


@pytest.mark.parametrize("raw,expected", [
    ("AN-2026-005", "AN2026005"), (" VAX 60326 ", "VAX60326"), ("angebot: 130 629", "ANGEBOT130629"), ("--", None),
])
def test_reference_keys(spark, raw, expected):
    assert one(spark, K.reference_key, raw) == expected


def test_name_based_ids_equal_the_library(spark):
    rows = spark.range(50).select(F.concat(F.lit("document:ä"), F.col("id").cast("string")).alias("n")).select("n", K.uuid5(F.col("n")).alias("u")).collect()
    space = uuid.UUID(K.ID_NAMESPACE)
    assert all(r.u == str(uuid.uuid5(space, r.n)) for r in rows)


@pytest.mark.parametrize("text", ["a\nb", "a\nb\n", "", "\n", "a\r\nb\x0bc\x0cd e", "a\n\n"])
def test_lines_are_cut_like_python_does(spark, text):
    assert one(spark, X.split_lines, text) == text.splitlines()


def test_amount_tokens(spark):
    assert one(spark, X.amount_tokens, "Rabatt 5 % - EUR 1.234,56 von € 20,00") == ["- EUR 1.234,56", "€ 20,00"]


def test_textual_dates(spark):
    assert one(spark, N.textual_date, "3. März 2026") == "03.03.2026"
    assert one(spark, N.textual_date, "3. Foo 2026") is None


def test_two_rounding_modes(spark):
    half = F.lit("2.345").cast("decimal(10,3)")
    row = spark.range(1).select(N.money(half).alias("up"), N.check_money(half).alias("even")).collect()[0]
    assert (row.up, row.even) == (Decimal("2.35"), Decimal("2.34"))


def test_long_text_cleaning(spark):
    text = "2 Stk Fenster DIN links\n2 Stk\n965 1000\n100,00 200,00\nKu.Pos.: 7\nAlternativ: Griff EP: € 10,00\nEP: € 1.250,00 lackiert"
    clean = lambda c: E.clean_long_text(c, F.lit("2").cast("decimal(14,4)"), F.lit("Stück"))
    assert one(spark, clean, text) == "Fenster DIN links\nlackiert"
    keep = lambda c: E.clean_long_text(c, F.lit("3").cast("decimal(14,4)"), F.lit("Stück"))
    assert one(spark, keep, "2 Stk Fenster DIN links") == "2 Stk Fenster DIN links"


def test_rich_text_escapes(spark):
    assert one(spark, E.rich_text, "a{b}\\ü\nz") == E.RTF_HEAD + "a\\{b\\}\\\\\\u252?\\line z" + E.RTF_TAIL


def test_position_numbers(spark):
    assert one(spark, K.position_numbers, "1, 2/3; 2") == ["1", "2", "3"]
