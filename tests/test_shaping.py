"""What the steps from blocks to positions give and how often they run."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.operators import items
from offerlake.rules.registry import REGISTRY

ODD_LINES = [
    ("Seite 1 von 2", True), ("seite von 3", True), ("Seiten 1 von 2", False), ("Angebot 12", True), ("Angebot vom Haus", False), ("Angebot vom Haus, Seite", True),
    ("Ansicht von innen", True), ("Ansicht von innen, links", False), ("Pos. Einzelpreis Anzahl", True), ("Pos. Anzahl", False), ("- = _", True), ("- a", False),
    ("  IBAN: 1", True), ("x IBAN: 1", False), ("", True), ("  ", True), ("Rahmen", False),
]


def test_furniture_by_one_pattern(spark):
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(ODD_LINES)], "i int, line string")
    got = {r.i: r.hit for r in rows.select("i", X.is_page_furniture(F.col("line")).alias("hit")).collect()}
    assert got == {i: hit for i, (_, hit) in enumerate(ODD_LINES)}


def test_a_text_is_trimmed_like_its_lines(spark):
    texts = ["a  b  c\n\n d \r\nSeite 1 von 2\nSumme  Alles\ne", "Summe\tAlles \n a", "summe", " \t\n", "", "a\fb  c\rd", "x\nSUMME alles", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for got in rows.select(X.trim_text(F.col("t"), ("summe alles", "summe ")).alias("a"), X.trim_block(X.split_lines(F.col("t")), ("summe alles", "summe ")).alias("b")).collect():
        assert got.a == got.b


@pytest.mark.parametrize("key", [r.key for r in REGISTRY.rules if r.shape is not None and r.key not in ("alu_one", "schuchter", "schlotterer")])
def test_a_block_is_trimmed_once(spark, key):
    texts = spark.createDataFrame([(1, "a")], "document_id long, text string").repartition(2)
    plan = items.shaped_items(texts, REGISTRY.get(key))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lupre ai solutions") == 1


def test_tokens_of_the_short_pattern(spark):
    money = "[0-9]{1,3}(?:[ .][0-9]{3})*,[0-9]{2}"
    before = rf"-?\s*(?:EUR|€)?\s*{money}|-?\s*(?:EUR|€)?\s*[0-9]+,[0-9]{{2}}"
    texts = ["EP: € 1.250,00 GP: EUR 12 500,00", "- 5,00-6,00", "1234,50 12345,678 1,2", "EUREUR 5,00 €€7,00", "a, b", "12.50", "  3,00", "--\t€ 1.2.3,45", "E 4,00", ",,00 ,50", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = F.transform(F.regexp_extract_all(X.normalize_text(F.col("t")), F.lit(before), F.lit(0)), lambda token: X.strip(F.regexp_replace(token, "[ \t]+", " ")))
    for got in rows.select(X.amount_tokens(F.col("t")).alias("a"), found.alias("b")).collect():
        assert got.a == got.b


def test_last_of(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (None,)], "v array<string>")
    assert [tuple(r) for r in rows.select(X.last_of(F.col("v")), X.last_of(F.col("v"), 2)).collect()] == [(None, None), ("a", None), ("b", "a"), (None, None)]


def test_a_price_pair_is_searched_once(spark):
    from offerlake.rules.blocks import ENTHOLZER_PAIR

    texts = spark.createDataFrame([(1, "a")], "document_id long, text string").repartition(2)
    plan = items.shaped_items(texts, REGISTRY.get("entholzer"))._jdf.queryExecution().optimizedPlan().toString()
    # one search of lines, one removal, two groups
    assert plan.count(ENTHOLZER_PAIR) == 6


@pytest.mark.parametrize("key,pattern,times", [
    ("rekord_vomp", r"(?:\s+[0-9]{3,4}){2,}$", 1),  # what is left of a line: once for three tests of it
])
def test_a_step_runs_once(spark, key, pattern, times):
    texts = spark.createDataFrame([(1, "a")], "document_id long, text string").repartition(2)
    plan = items.shaped_items(texts, REGISTRY.get(key))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pattern) == times


def test_headings_before_a_block(spark):
    text = "Kopf\n" + "\n".join(f"{n:03d} 1 Stk Türelement Nummer {n} EUR 1,00 EUR 2,00" for n in range(1, 10))
    rows = items.blocks(spark.createDataFrame([(1, text)], "document_id long, text string"), REGISTRY.get("alu_one")).orderBy("block_no").collect()
    bodies = ["Kopf\n"] + [r.block for r in rows]
    assert [r.before for r in rows] == ["".join(bodies[max(0, n - 6):n]) for n in range(1, 10)]


def test_positions_are_not_written_for_parents_nobody_reads(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["extract_schlotterer"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExistingRDD" not in plan
