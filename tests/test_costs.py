"""Steps that were too dear a row: what they may not do again, and that results stayed."""

import itertools

from pyspark.sql import functions as F

from offerlake.functions import export_text as E
from offerlake.functions import text as X
from offerlake.operators import amounts, images, items, pricing, quality, validate
from offerlake.rules.blocks import _slat_body
from offerlake.rules.registry import REGISTRY
from offerlake.sources import layout


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_are_read_without_pairing(spark):
    texts = spark.createDataFrame([(1, "Kopf\n1 W1a 2 Raffstore K7 10,00 20,00\nFunkmotor 10,00\n")], "document_id long, text string")
    rows = items.shaped_items(texts, REGISTRY.get("schlotterer"))
    plan = plan_of(rows.select("document_id", "block_no", "components"))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    assert [(c.label, c.amount_raw) for r in rows.collect() for c in r.components] == [("Funkmotor", "10,00")]


def test_lines_are_cut_and_normalised_without_a_lookup_of_every_sign(spark):
    cases = [
        ("a\r\nb\rc\n", ["a", "b", "c"]), ("a b\u000bc", ["a", "b", "c"]), ("\n\n", ["", ""]), ("", []),
        ("x  y\t\tz  \n ", ["x  y\t\tz  ", " "]),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(X.split_lines(F.col("t"))).collect()] == [lines for _, lines in cases]
    line = df.where("t like 'x%'").select(X.normalize_line(F.col("t")).alias("line"), X.normalize_text(F.col("t")).alias("text"))
    assert tuple(line.first()) == ("x y z \n".strip(), "x  y\t\tz  \n ")
    assert "translate" not in plan_of(line)


def test_text_of_a_slat_row_in_its_three_shapes(spark):
    cases = [
        ("3 W1 2 Raffstore 1 234,56 12,00", "W1 2 Raffstore"), ("3 W1 2 Raffstore 1.234,56", "W1 2 Raffstore"), ("3 W1 2 Raffstore", "W1 2 Raffstore"),
        ("3 a 1,00 2,00 3,00", "a 1,00"), ("3 1,00 2,00", "1,00"), ("Breite: 900mm", None), ("3", None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(_slat_body(F.col("t"))).collect()] == [body for _, body in cases]


def test_long_texts_meet_each_pattern_once(spark):
    cases = [
        ("12 Stk Tür\nEP: € 1.250,00 lackiert\nAlternativ: x\nKu.Pos.: 47\n965 1000", "Tür\nlackiert"),
        ("3 Stk Tür 1,00 2,00\nwww.schlotterer.com\n \u3000\n2 Stk", None), ("12,00 Stück 01.02.03.A:\nweiß ( roh ) , matt", "weiß (roh), matt"), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(t, 12) for t, _ in cases], "t string, q int").select("t", F.col("q").cast("decimal(14,4)").alias("q"))
    clean = df.select(E.clean_long_text(F.col("t"), F.col("q"), F.lit("Stk")).alias("clean"))
    assert [r[0] for r in clean.collect()] == [text for _, text in cases]
    assert clean._jdf.queryExecution().optimizedPlan().toString().count(E.QUANTITY_PREFIX) <= 4


def test_rich_text_escapes_without_a_row_per_sign(spark):
    df = spark.createDataFrame([("a{b}\\\r\nü😀ü\t|",), (None,)], "t string")
    rich = df.select(E.rich_text(F.col("t")))
    body = "a\\{b\\}\\\\\\line \\u252?\\u62976?\\u252?\\u9?|"
    assert [r[0] for r in rich.collect()] == [E.RTF_HEAD + body + E.RTF_TAIL, E.RTF_HEAD + E.RTF_TAIL]
    assert "split(" not in rich._jdf.queryExecution().optimizedPlan().toString()


def test_group_rows_are_read_by_one_match(spark):
    text = "Raffstore 1.250,00 20,00 % 10,00\nMotor 50,00 30 % -15,00 dazu\nRabatte: 5,00 3 % 1,00\nRaffstore 1.250,00 20,00 % 10,00\nMotor 5"
    df = amounts.discount_groups(spark.createDataFrame([(1, text)], "document_id long, text string"))
    rows = sorted((r.group_order, r.label, str(r.base_amount), str(r.percent), str(r.discount_amount)) for r in df.collect())
    assert rows == [(0, "Raffstore", "1250.00", "20.0000", "-10.00"), (1, "Motor", "50.00", "30.0000", "-15.00")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(amounts.GROUP_ROW) <= 2


def test_leak_audit_cuts_lines_once(spark):
    df = quality.leak_audit(spark.createDataFrame([(1, "3 Stk\nx 12 34\ny 1,00"), (1, None), (2, "z 4")], "supplier int, description_long string"), "supplier")
    assert [tuple(r) for r in df.collect()] == [(1, 2, 1, 1, 1, 0, 1), (2, 1, 1, 0, 0, 1, 0)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_description_columns_read_words_once_for_heads_and_prices(spark):
    page = lambda n, cells: [(1, n, x, y, text, 595.0) for x, y, text in cells]
    heads = [(190.0, 40.0, "Bezeichnung"), (430.0, 40.0, "E-Preis")]
    # the leftmost price stands on the other page and ends the column there
    rows = page(1, [*heads, (30.0, 80.0, "Pos."), (200.0, 81.0, "Fenster"), (410.0, 81.0, "rechts")]) + page(2, [*heads, (400.0, 90.0, "1.265,40")])
    words = spark.createDataFrame(rows, "document_id long, page_ref int, x0 double, y0 double, text string, page_width double")
    blocks = layout.description_blocks(words)
    assert [tuple(r) for r in blocks.collect()] == [(1, 1, "Fenster")]
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4  # two of them for the bands


def test_next_windows_share_one_exchange(spark):
    rows = [(1, 1, 1, 0.1), (1, 2, 1, 0.5), (1, 3, 1, 0.5), (1, 4, 3, 0.2), (1, 5, None, 0.3), (1, 6, 3, None), (2, 1, 1, 0.4)]
    out = items.next_windows(spark.createDataFrame(rows, "document_id long, item_seq int, page_ref int, item_top_ratio double"))
    plan = plan_of(out)
    assert "Join" not in plan and plan.count("Exchange") == 1
    cells = ("next_position_page_ref", "next_position_top_ratio", "next_item_top_ratio", "next_page_first_item_top_ratio")
    assert sorted((r.document_id, r.item_seq, *(r[c] for c in cells)) for r in out.collect()) == [
        (1, 1, 1, 0.5, 0.5, None), (1, 2, 1, 0.5, 0.5, 0.2), (1, 3, 3, 0.2, None, None), (1, 4, None, None, None, None),
        (1, 5, None, None, None, None), (1, 6, None, None, None, None), (2, 1, None, None, None, None),
    ]


def test_window_bounds_say_what_the_window_says(spark):
    values = {"page": (1, 2), "top": (None, 0.0, 0.4), "np": (None, 1, 2, 3), "nt": (None, 0.3), "ni": (None, 0.6), "nf": (None, 0.2)}
    rows = [(p, t, np_, nt, ni, nf, a, p + gap) for p, t, np_, nt, ni, nf in itertools.product(*values.values()) for a in (None, 0.0, 0.25, 0.39, 0.5, 0.9) for gap in (0, 1)]
    df = spark.createDataFrame(rows, "page_ref int, item_top_ratio double, next_position_page_ref int, next_position_top_ratio double, next_item_top_ratio double, next_page_first_item_top_ratio double, a double, image_page int")
    image = F.struct(F.col("image_page").alias("page_ref"), F.col("a").alias("center_y_ratio"), F.lit(None).cast("double").alias("top_ratio"), F.col("a").alias("anchor"))
    bounds = images.with_bounds(df)
    found = F.when(F.col("image_page") == F.col("page_ref"), images._here(F.col("image"))).otherwise(images._next(F.col("image")))
    assert bounds.withColumn("image", image).where(~found.eqNullSafe(images.within_window(F.col("image")))).count() == 0


def test_group_discounts_and_their_fallback_pass_the_positions_once(spark):
    money = "CAST({} AS DECIMAL(14,2))".format
    items = spark.sql(f"""
        SELECT doc AS document_id, seq AS item_seq, false AS is_alternative, CAST(1 AS DECIMAL(14,4)) AS quantity, {money(100)} AS unit_price, {money(100)} AS line_total,
               '1' AS position_no, CAST(NULL AS STRING) AS lv_pos, text AS description_short, CAST(array() AS ARRAY<STRUCT<label:STRING,amount_raw:STRING>>) AS components
        FROM VALUES (1L, 1, ' Röd  tür'), (1L, 2, 'Griff'), (2L, 1, 'Röd tür'), (2L, 2, 'Verpackungsbeitrag'), (3L, 1, NULL) AS v(doc, seq, text)""")
    groups = spark.sql("SELECT doc AS document_id, 0 AS group_order, 'roed' AS key, CAST(20 AS DECIMAL(8,4)) AS percent FROM VALUES (1L), (2L) AS v(doc)")
    profile = spark.sql(f"SELECT doc AS document_id, CAST(net AS DECIMAL(14,2)) AS net_total FROM VALUES (1L, 180.05), (2L, 150.00) AS v(doc, net)")
    priced = pricing.price_with_fallback(items, profile, groups)
    rows = {(r["document_id"], r["item_seq"]): (str(r["line_total"]), r["pricing_applied"], r["pricing_adjustment_source"]) for r in priced.collect()}
    by_group, by_net = "schlotterer_discount_groups", "schlotterer_effective_discount"
    assert rows == {
        (1, 1): ("80.05", True, by_group), (1, 2): ("100.00", False, None),
        (2, 1): ("50.00", True, by_net), (2, 2): ("100.00", False, None), (3, 1): ("100.00", False, None),
    }
    optimized = priced._jdf.queryExecution().optimizedPlan().toString()
    # no second pass for the documents without accepted groups; one key a position, not one a group name
    assert "LeftAnti" not in optimized and "Union" not in optimized
    assert optimized.count("[^a-z0-9]+") <= 3


def test_runs_are_folded_once_a_page_and_lines_normalised_once(spark):
    lines = spark.createDataFrame([(1, 1, 30.0, 80.0, "\r001 ", 842.0), (1, 1, 70.0, 80.5, "2\u00a0Stk", 842.0), (1, 1, 120.0, 81.0, "Element K7", 842.0),
                                   (1, 1, 400.0, 81.2, "10,00 €", 842.0), (1, 1, 120.0, 94.0, " \u00a0\r\u3000", 842.0), (1, 1, 9.0, None, "x", 842.0)],
                                  "document_id long, page_ref int, x0 double, y0 double, text string, page_height double")
    hints = layout.row_hints(lines)
    assert [r["position_no"] for r in hints.collect()] == ["001"]
    optimized = hints._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count(X.UNEVEN_BLANKS) == 1
    # below the explode, not anew for each exploded row
    assert "filter(aggregate(" not in optimized
    filled = lines.select(X.is_filled(F.col("text")).alias("a"), (X.normalize_line(F.col("text")) != "").alias("b"), (X.strip(F.col("text")) != "").alias("c"))
    assert all(r["a"] == r["b"] == r["c"] for r in filled.collect())


def test_issues_of_positions_read_them_once_for_rules_and_once_for_drawings(spark):
    items = spark.sql("""
        SELECT 1L AS document_id, seq AS item_seq, pos AS position_no, 'Tür' AS description_short, '' AS description_long, '' AS lv_pos, false AS is_alternative, page AS page_ref,
               CAST(1 AS DECIMAL(14,4)) AS quantity, CAST(5 AS DECIMAL(14,2)) AS unit_price, CAST(5 AS DECIMAL(14,2)) AS line_total, ids AS image_ids,
               true AS image_auto_match_allowed, CAST(NULL AS STRING) AS image_assignment_source, checked AS review_checked
        FROM VALUES (1, '1', 1, array(7L, 7L), true), (2, '2', 2, array(7L), true), (3, '3', 1, CAST(array() AS ARRAY<BIGINT>), false), (4, NULL, 1, array(8L), true),
                    (5, '5', 3, array(9L, CAST(NULL AS BIGINT)), false) AS v(seq, pos, page, ids, checked)""")
    images = spark.sql("SELECT 1L AS document_id, id AS image_id, page AS page_ref FROM VALUES (7L, 1), (7L, 4), (8L, 1), (9L, 3), (CAST(NULL AS BIGINT), 1) AS v(id, page)")
    modes = spark.sql("SELECT 1L AS document_id, 'muigg' AS provider_key, 'strict' AS mode")
    issues = validate.position_issues(items, images, modes)
    rows = sorted((r["item_seq"] or 0, r["code"], r["severity"], r["resolved"]) for r in issues.collect())
    assert rows == [
        (0, "duplicate_image_assignments", "error", False), (1, "duplicate_image_assignment", "error", False),
        (2, "duplicate_image_assignment", "error", False), (2, "image_before_item_page", "warning", True),
        (3, "missing_image_assignment", "warning", False), (4, "missing_position_no", "error", False),
    ]
    per_document, per_item = validate.duplicate_image_issues(items)
    old = validate.item_issues(items, modes).unionByName(validate.image_issues(items, images, modes)).unionByName(per_item)
    assert sorted(tuple(r) for r in validate.resolve_reviewed(old, items).select("item_seq", "code", "severity", "resolved").collect()) == rows[1:]
    assert [r["code"] for r in per_document.collect()] == ["duplicate_image_assignments"]
    # items only meet their modes; drawings and review marks need no join
    assert issues._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
