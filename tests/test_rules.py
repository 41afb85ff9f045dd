import dataclasses
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from offerlake.operators import headers, items
from offerlake.plans import process
from offerlake.rules import blocks
from offerlake.rules.base import Registry, RuleSet
from offerlake.rules.registry import REGISTRY

TEXT = "document_id long, text string"


def raw(spark, key, text):
    rows = items.raw_items(spark.createDataFrame([(1, text)], TEXT), REGISTRY.get(key))
    return items.numbered(rows).orderBy("item_seq").collect()


def test_order_of_detection_is_part_of_the_rules(spark):
    texts = [(1, "Angebot Nr. 5 muigg.at"), (2, "angebot nummer"), (3, "nichts")]
    got = spark.createDataFrame(texts, TEXT).select("document_id", headers.detect_template(F.col("text")).alias("t")).orderBy("document_id").collect()
    assert [r.t for r in got] == ["muigg", "entholzer", "generic"]


def test_block_prices_ignore_embedded_alternatives(spark):
    text = "Position: 1\nFenster A\n2 Stk\nEP: € 100,00 GP: € 200,00\nAlternativ: Griff EP: € 9,00\n\fPosition: 2\nkein Start nach Seitenwechsel\nPosition: 3\nTüre B\n1 Stück\nEP: € 5,00\nGP: € 5,00\nNettosumme 205,00"
    got = raw(spark, "rieder", text)
    assert [(r.position_no, r.unit_price_raw, r.line_total_raw, r.page_ref) for r in got][0] == ("1", "€ 100,00", "€ 200,00", 1)
    assert got[-1].position_no == "3" and got[-1].page_ref == 2 and got[-1].description_short == "Türe B"
    assert "Alternativ: Griff EP: € 9,00" in got[0].description_long


def test_page_heads_carry_over_to_the_last_position(spark):
    text = "1 W1 2 Raffstore A 10,00 20,00\nBreite: 900mm\n2 W2 1 Raffstore B 5,00 5,00\n\fSeite\nFunkmotor 7,00\nHöhe: 800mm\n3 W3 1 Raffstore C 1,00 1,00"
    got = raw(spark, "schlotterer", text)
    assert [r.position_no for r in got] == ["1", "2", "3"]
    assert [(c.label, c.amount_raw) for c in got[1].components] == [("Funkmotor", "7,00")]
    assert "Höhe: 800mm" in got[1].description_long and got[1].height_raw == "800"
    assert got[0].width_raw == "900" and not got[0].components


def test_totals_are_completed_from_the_other_two(spark):
    rows = [(1, "Nettosumme 100,00\nEndbetrag 120,00"), (2, "Nettosumme 100,00\nMwSt 20 % 19,00\nEndbetrag 120,00"), (3, "Nettosumme\nx\n50,00")]
    got = headers.document_totals(spark.createDataFrame(rows, TEXT)).orderBy("document_id").collect()
    assert [(r.net_total, r.vat_total, r.gross_total) for r in got] == [
        (D("100.00"), D("20.00"), D("120.00")), (D("100.00"), D("20.00"), D("120.00")), (D("50.00"), None, None)]


def test_a_new_rule_set_plugs_in(spark):
    rule = RuleSet("acme", "Acme", lambda low: low.contains("acme"), lambda line, following: line.startswith("#"),
                   lambda rows: rows.select("document_id", "block_no", "page_ref", F.regexp_extract("block", r"^#(\d+)", 1).alias("position_no")))
    registry = Registry(list(REGISTRY.rules))
    registry.add(rule, before="alu_one")
    assert registry.rules[0].key == "acme"
    got = items.raw_items(spark.createDataFrame([(1, "Acme\n#1 x\ny\n\f#2 z")], TEXT), rule).orderBy("block_no").collect()
    assert [(r.position_no, r.page_ref) for r in got] == [("1", 1), ("2", 2)]


def test_a_plugged_in_rule_set_is_detected_and_extracted(spark):
    rule = RuleSet("acme", "Acme", lambda low: low.contains("acme"), lambda line, following: line.startswith("#"),
                   lambda rows: rows.select("document_id", "block_no", "page_ref", F.regexp_extract("block", r"^#(\d+)", 1).alias("position_no"),
                                                F.col("block").alias("description_long")))
    long = "x" * 20_000
    staged = process.stage_by_template(spark.createDataFrame([(1, f"Acme\n#1 {long}"), (2, "nothing")], TEXT), Registry([rule]))
    assert {(r.document_id, r.template) for r in staged.collect()} == {(1, "acme"), (2, "generic")}
    assert headers.document_headers(staged).where("document_id = 1").first().template == "acme"
    got = process.extract_items(staged, Registry([rule])).collect()
    # long texts stay whole
    assert [(r.document_id, r.position_no, len(r.description_long) > 20_000) for r in got] == [(1, "1", True)]


@pytest.mark.parametrize("key", ["muigg", "schlotterer"])
def test_extraction_needs_no_exchange(spark, key):
    rule = dataclasses.replace(REGISTRY.get(key), after=None)
    df = items.raw_items(spark.createDataFrame([(1, "x")], TEXT), rule)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_page_head_is_carried_over_empty_pages_and_never_from_page_one(spark):
    text = "Kopf\nVormotor 1,00\n\f1 W1 2 Raffstore A 10,00 20,00\n\f\fSeite\nHöhe: 800mm\nMotor 7,00\n\fMast 3,00\n2 W2 1 Raffstore B 5,00 5,00\nTiefe: 5"
    got = raw(spark, "schlotterer", text)
    assert [[(c.label, c.amount_raw) for c in r.components] for r in got] == [[("Motor", "7,00"), ("Mast", "3,00")], []]
    assert "Höhe: 800mm" in got[0].description_long and got[1].description_long == "Tiefe: 5" and [r.page_ref for r in got] == [2, 5]


def slip_apart(a, b):
    """Plain reading of what one slip is."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= (2 if len(a) <= 6 else 1)
    long, short = sorted((a, b), key=len, reverse=True)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_near_keys_equal_all_pairs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab1") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    wanted = {(d, w) for d in (1, 2) for w in rng.sample(words, 60)}
    known = {(d, w) for d in (1, 2) for w in rng.sample(words, 25)}
    wanted -= known
    schema = "document_id long, key string"
    found = {tuple(r) for r in blocks.near_keys(spark.createDataFrame(sorted(wanted), schema), spark.createDataFrame(sorted(known), schema)).collect()}
    want = set()
    for d, key in wanted:
        near = {k for e, k in known if e == d and slip_apart(key, k)}
        want |= {(d, key, *near)} if len(near) == 1 else set()
    assert found == want and len(found) > 5


def test_a_document_with_many_positions_is_paired(spark):
    rows = spark.range(20_000).select(
        F.lit(1).cast("long").alias("document_id"), F.col("id").alias("block_no"), (F.col("id") % 2 == 1).alias("is_alternative"), F.col("id").cast("string").alias("position_no"),
        F.concat(F.lit("Raum"), F.lpad(F.floor(F.col("id") / 2).cast("string"), 6, "0"), F.when(F.col("id") % 4 == 1, "x").otherwise("")).alias("lv_pos"),
        F.lit(None).cast("string").alias("alternative_parent_position_no"),
    )
    got = {r.block_no: r.alternative_parent_position_no for r in blocks.pair_alternatives(rows).collect()}
    assert all(got[i] == (str(i - 1) if i % 2 else None) for i in range(20_000) if i % 4 != 1)


def test_all_hooks_of_a_plugged_in_rule_set(spark):
    rule = RuleSet(
        "acme", "Acme Inc", lambda low: low.contains("acme"), lambda line, following: line.startswith("#"),
        lambda rows: rows.select("document_id", "block_no", "page_ref", F.regexp_extract("block", r"^#(\d+)", 1).alias("position_no"), F.lit("2").alias("quantity_raw"),
                                 F.regexp_extract("block", r"= ([0-9,]+)", 1).alias("line_total_raw"), F.lit("acme code").alias("lv_pos"), F.lit("text").alias("description_long"),
                                 F.array(F.struct(F.lit("Motor").alias("label"), F.lit("5,00").alias("amount_raw"))).alias("components")),
        count=lambda text: F.regexp_count(text, F.lit("(?m)^total #")), notes=lambda text: F.regexp_extract(text, "note: (.*)", 1),
        refine=lambda fields, text: {"document_number": F.concat(F.lit("AC-"), F.regexp_extract(text, "no (\\d+)", 1)), "document_date": F.lit("03.04.2026")},
        delivery=lambda texts, rows: texts.select("document_id", F.lit(99).alias("block_no"), F.lit("9").alias("position_no"), F.lit("1").alias("quantity_raw"), F.lit("7,00").alias("line_total_raw")).where("text like '%freight%'"),
        pricing="line", room_labels=True,
    )
    texts = [(1, "Acme\nno 12\n#1 x = 10,00\n#2 y = 20,00\nfreight\nnote: hello"), (2, "Acme\nno 13\ntotal #1\ntotal #2"), (3, "Pos 1\nPos 2"), (4, " ")]
    out = process.process_texts(spark.createDataFrame(texts, TEXT), Registry([rule]))
    heads = {r.document_id: r for r in out["documents"].collect()}
    assert heads[1].supplier_name == "Acme Inc" and heads[1].document_number == "AC-12" and str(heads[1].document_date) == "2026-04-03" and heads[1].document_notes == "hello"
    assert {i: (r.template, r.position_count) for i, r in heads.items()} == {1: ("acme", 3), 2: ("acme", 2), 3: ("generic", 2)}
    items_ = sorted(out["line_items"].collect(), key=lambda r: r.item_seq)
    assert [(r.position_no, str(r.line_total)) for r in items_] == [("1", "10.00"), ("2", "20.00"), ("9", "7.00")]
    assert [r.description_long for r in items_[:2]] == ["acme code\ntext"] * 2
    assert {(r.item_seq, r.component_no, r.label, str(r.amount)) for r in out["components"].collect()} == {(1, 1, "Motor", "5.00"), (2, 1, "Motor", "5.00")}
    assert [(r.document_id, r.reason) for r in out["rejects"].collect()] == [(4, "empty_text")]
