from decimal import Decimal as D

from pyspark.sql import functions as F

from offerlake.operators import amounts, pricing, validate

ITEM = "document_id long, item_seq int, is_alternative boolean, quantity decimal(14,4), unit_price decimal(14,2), line_total decimal(14,2), pricing_source string"
AMOUNT = "document_id long, sort_order int, line_type string, label_raw string, percent decimal(8,4), base_amount decimal(14,2), amount decimal(14,2)"


def chain(spark, price, *steps):
    ops = F.array(*[F.struct(F.lit(i).alias("sort_order"), F.lit(k).alias("line_type"), F.lit(p).cast("decimal(8,4)").alias("percent")) for i, (k, p) in enumerate(steps)])
    return spark.range(1).select(pricing.apply_chain(F.lit(price).cast("decimal(14,2)"), ops).alias("r")).collect()[0].r


def test_chains_round_once(spark):
    assert chain(spark, "751.44", ("discount", "10")) == D("676.30")
    assert chain(spark, "1339.00", ("discount", "34"), ("discount", "8")) == D("813.04")
    assert chain(spark, "6531.88", ("surcharge", "3"), ("discount", "38"), ("discount", "8"), ("discount", "8")) == D("3530.55")


def amount_rows(spark, rows):
    return spark.createDataFrame([(1, i, k, "", p and D(p), None, D(a)) for i, (k, p, a) in enumerate(rows)], AMOUNT)


def test_delta_goes_to_the_last_main_row_and_freight_stays_out(spark):
    items = spark.createDataFrame([
        (1, 1, False, D(1), D("100.00"), D("100.00"), None), (1, 2, True, D(1), D("50.00"), D("50.00"), None),
        (1, 3, False, D(2), D("50.00"), D("100.00"), None), (1, 4, False, D(1), D("200.00"), D("200.00"), "delivery_block"),
    ], ITEM)
    lines = amount_rows(spark, [("subtotal", None, "200.00"), ("discount", "10", "-20.00"), ("subtotal", None, "180.05"), ("net_total", None, "380.05")])
    suppliers = spark.createDataFrame([(1, "rieder")], "document_id long, provider_key string")
    out = {r.item_seq: r for r in pricing.price_by_chain(items, amounts.condition_profile(lines), suppliers).collect()}
    assert [out[i].line_total for i in (1, 2, 3, 4)] == [D("90.00"), D("45.00"), D("90.05"), D("200.00")]
    assert out[3].rounding_delta == D("0.05") and out[3].unit_price == D("45.03")
    assert out[4].original_line_total is None


def test_sequence_restarts_at_printed_subtotals(spark):
    good = amount_rows(spark, [("subtotal", None, "1000.00"), ("surcharge", "3", "30.00"), ("subtotal", None, "1030.00"),
                               ("discount", "38", "-391.40"), ("subtotal", None, "638.60"), ("net_total", None, "838.60")])
    row = validate.sequence_check(good).collect()[0]
    assert row.sequence_matches and row.last_subtotal == D("638.60") and row.step_count == 2
    bad = amount_rows(spark, [("subtotal", None, "1000.00"), ("surcharge", "3", "30.00"), ("subtotal", None, "1031.00")])
    assert not validate.sequence_check(bad).collect()[0].sequence_matches


def test_printed_discount_groups(spark):
    text = "Raffstore 2.488,00 48,00 % 1.194,24\nZubehör 925,00 50,00 % -462,50\nSumme 1,00 1,00 % 1,00"
    rows = amounts.discount_groups(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("group_order").collect()
    assert [(r.label, r.discount_amount) for r in rows] == [("Raffstore", D("-1194.24")), ("Zubehör", D("-462.50"))]


def test_amount_lines_look_ahead(spark):
    text = "Zwischensumme\n1.000,00\nRabatt 5 %\nNetto\n50,00\nMwSt 20 % 190,00\nSumme Positionen\nx\ny\nz\nw\n950,00"
    got = amounts.extract_amount_lines(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("line_no").collect()
    assert [(r.line_type, r.amount_raw, r.percent_raw) for r in got] == [
        ("subtotal", "1.000,00", None), ("discount", "-50,00", "5"), ("vat", "190,00", "20"), ("net_total", "950,00", None)]


def test_effective_discount_rounds_exact_half_cents_up(spark):
    # 0.15 of 0.30 at 0.01 is half a cent, which 1 / 30 cut to some digits falls short of
    items = spark.sql("""
        SELECT 1L AS document_id, seq AS item_seq, false AS is_alternative, CAST(1 AS DECIMAL(14,4)) AS quantity, CAST(0.15 AS DECIMAL(14,2)) AS unit_price,
               CAST(0.15 AS DECIMAL(14,2)) AS line_total, '1' AS position_no, CAST(NULL AS STRING) AS lv_pos, 'Raffstore' AS description_short
        FROM VALUES (1), (2) AS v(seq)""")
    profile = spark.sql("SELECT 1L AS document_id, CAST(0.01 AS DECIMAL(14,2)) AS net_total")
    rows = pricing.price_by_effective_discount(items, profile).orderBy("item_seq").collect()
    assert [str(r["line_total"]) for r in rows] == ["0.01", "0.00"]
