"""Queries: corrections, journals, table merges, layout tables, quality jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.functions import numbers as N
from offerlake.functions import text as X
from offerlake.operators import amounts, changes, headers, pricing, quality, store
from offerlake.operators.snapshot import TableSet
from offerlake.plans.catalog import query
from offerlake.plans.queries_links import LINKS_SQL, resolved_links
from offerlake.plans.views import Tables
from offerlake.session import shared_folder
from offerlake.sources import layout

NEWEST_SQL = """
, newest AS (SELECT document_id, line_item_id, field, arg_max(value, ts) AS value, arg_max(actor, ts) AS actor, MAX(ts) AS changed_at FROM change_log GROUP BY ALL)"""


@query("latest_field_values", "MUT-02 STR-02", NEWEST_SQL + """
SELECT document_id, line_item_id, field, value, actor, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS changed_at FROM newest""")
def _(t):
    return changes.latest_values(t.change_log).withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss"))


@query("edited_items", "MUT-04", NEWEST_SQL + """
, p AS (
  SELECT document_id, line_item_id, MAX(CASE WHEN field = 'quantity' THEN value END) AS q, MAX(CASE WHEN field = 'unit_price' THEN value END) AS u,
         MAX(CASE WHEN field = 'line_total' THEN value END) AS l, MAX(CASE WHEN field = 'position_no' THEN value END) AS n FROM newest GROUP BY ALL
)
SELECT i.document_id, i.line_item_id, CAST(COALESCE(CAST(q AS DECIMAL(14,4)), quantity) AS DOUBLE) AS quantity, CAST(COALESCE(CAST(u AS DECIMAL(14,2)), unit_price) AS DOUBLE) AS unit_price,
       CAST(COALESCE(CAST(l AS DECIMAL(14,2)), line_total) AS DOUBLE) AS line_total, COALESCE(n, position_no) AS position_no,
       (CASE WHEN u IS NOT NULL AND CAST(u AS DECIMAL(14,2)) <> unit_price THEN 1 ELSE 0 END) + (CASE WHEN l IS NOT NULL AND CAST(l AS DECIMAL(14,2)) <> line_total THEN 1 ELSE 0 END)
         + (CASE WHEN q IS NOT NULL AND CAST(q AS DECIMAL(14,4)) <> quantity THEN 1 ELSE 0 END) + (CASE WHEN n IS NOT NULL AND n <> position_no THEN 1 ELSE 0 END) AS edited_fields
FROM line_items i LEFT JOIN p USING (document_id, line_item_id)""")
def _(t):
    out = changes.apply_edits(t.line_items, t.change_log)
    return out.select(
        "document_id", "line_item_id", "position_no", F.size("manual_edit_fields").alias("edited_fields"),
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "line_total")],
    )


@query("item_flags_patched", "MUT-02 MUT-03", """
, newest AS (SELECT document_id, line_item_id, sub_key, arg_max(value, ts) AS value FROM change_log WHERE field = 'alternative_append_at_end' GROUP BY ALL)
SELECT document_id, line_item_id, sub_key, value FROM newest""")
def _(t):
    return changes.nested_flags(t.change_log, "alternative_append_at_end").select("document_id", "line_item_id", "sub_key", "value")


@query("review_flags", "MUT-02", NEWEST_SQL + """
SELECT document_id, line_item_id, MAX(CASE WHEN field = 'review_checked' THEN value END) AS review_checked,
       MAX(CASE WHEN field = 'alternative_append_at_end' THEN value END) AS append FROM newest WHERE field IN ('review_checked', 'alternative_append_at_end') GROUP BY ALL""")
def _(t):
    out = changes.patched_flags(t.change_log, ("review_checked", "alternative_append_at_end"))
    return out.select("document_id", "line_item_id", F.try_element_at("flags", F.lit("review_checked")).alias("review_checked"),
                      F.try_element_at("flags", F.lit("alternative_append_at_end")).alias("append"))


@query("overridden_totals", "MUT-05 PRC-02", NEWEST_SQL + """
, o AS (SELECT document_id, line_item_id, CAST(value AS DECIMAL(14,2)) AS total FROM newest WHERE field = 'line_total')
SELECT i.document_id, i.line_item_id, total IS NOT NULL AS is_overridden, CAST(COALESCE(total, line_total) AS DOUBLE) AS line_total,
       CAST(CASE WHEN total IS NULL THEN unit_price ELSE CAST(CAST((2 * CAST(total * 100 AS BIGINT) + CAST(quantity AS BIGINT)) // (2 * CAST(quantity AS BIGINT)) AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) END AS DOUBLE) AS unit_price
FROM line_items i LEFT JOIN o USING (document_id, line_item_id)""")
def _(t):
    out = changes.override_totals(t.line_items, t.change_log)
    return out.select("document_id", "line_item_id", "is_overridden", F.col("line_total").cast("double").alias("line_total"), F.col("unit_price").cast("double").alias("unit_price"))


@query("standing_approvals", "MUT-06", """
, a AS (
  SELECT document_id, arg_max(value, ts) FILTER (field = 'approval_status') AS decision, MAX(ts) FILTER (field = 'approval_status') AS decided_at,
         arg_max(actor, ts) FILTER (field = 'approval_status') AS actor, MAX(ts) FILTER (field <> 'approval_status') AS changed FROM change_log GROUP BY document_id
), s AS (SELECT *, COALESCE(decision = 'approved' AND (changed IS NULL OR decided_at > changed), FALSE) AS stands FROM a)
SELECT document_id, CASE WHEN stands THEN 'approved' ELSE 'pending' END AS approval_status, CASE WHEN stands THEN actor END AS reviewed_by FROM s""")
def _(t):
    return changes.approvals(t.change_log).drop("reviewed_at")


@query("reset_documents", "MUT-07", LINKS_SQL + """
, gone AS (SELECT DISTINCT user_id AS document_id FROM events WHERE event_type = 'error')
SELECT d.document_id, CASE WHEN g.document_id IS NULL THEN d.document_number END AS document_number, CASE WHEN g.document_id IS NULL THEN d.document_type ELSE 'angebot' END AS document_type,
       CASE WHEN g.document_id IS NULL THEN d.status ELSE 'uploaded' END AS status,
       CAST(CASE WHEN g.document_id IS NULL AND h.document_id IS NULL THEN l.linked_offer_document_id END AS DOUBLE) AS linked_offer_document_id
FROM docs d LEFT JOIN gone g ON g.document_id = d.document_id LEFT JOIN links l ON l.document_id = d.document_id LEFT JOIN gone h ON h.document_id = l.linked_offer_document_id""")
def _(t):
    ids = t.read("events").where("event_type = 'error'").select(F.col("user_id").alias("document_id"))
    documents, cut = changes.reset_documents(t.documents, resolved_links(t).drop("is_manual"), ids)
    return documents.select("document_id", "document_number", "document_type", "status").join(
        cut.withColumn("linked_offer_document_id", F.col("linked_offer_document_id").cast("double")), "document_id"
    )


@query("children_after_reset", "MUT-01 MUT-07", """
SELECT document_id, item_seq FROM line_items WHERE document_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def _(t):
    ids = t.read("events").where("event_type = 'error'").select(F.col("user_id").alias("document_id")).distinct()
    return changes.without_documents(t.line_items, ids).select("document_id", "item_seq")


@query("target_assignments", "MUT-08", """
, n AS (SELECT user_id AS document_id, arg_max(event_type, ts) AS kind, arg_max(value, ts) AS value FROM events GROUP BY user_id)
SELECT document_id, kind AS customer_name, CASE WHEN kind <> 'error' THEN 'Auftrag ' || kind END AS orderdoc_destination, kind <> 'error' AND value > 20 AS orderdoc_additional FROM n""")
def _(t):
    kind = F.col("event_type")
    log = t.read("events").select(
        F.col("user_id").alias("document_id"), F.concat(kind, F.lit(" ")).alias("customer_name"),
        F.when(kind == "error", " ").otherwise(F.concat(F.lit("Auftrag "), kind)).alias("destination"), (F.col("value") > 20).alias("additional"), "ts",
    )
    return changes.assignments(log)


@query("processing_status", "MUT-09", """
SELECT user_id AS document_id, CASE WHEN arg_max(event_type, ts) = 'error' THEN 'failed' ELSE 'processed' END AS status,
       CASE WHEN arg_max(event_type, ts) = 'error' THEN left(repeat('x', 990) || arg_max(event_id, ts) || repeat('y', 20), 1000) END AS error_message FROM events GROUP BY user_id""", views=False)
def _(t):
    message = F.concat(F.repeat(F.lit("x"), 990), F.col("event_id").cast("string"), F.repeat(F.lit("y"), 20))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("processed")
    return changes.processing_status(t.read("events").select(F.col("user_id").alias("document_id"), status.alias("status"), message.alias("message"), "ts"))


@query("replaced_rows", "SNK-03 SNK-04 MUT-01", """
SELECT document_id, item_seq, CAST(line_total AS DOUBLE) AS line_total FROM line_items WHERE document_id % 2 = 0
UNION ALL SELECT document_id, item_seq, CAST(line_total + 1 AS DOUBLE) FROM line_items WHERE document_id % 2 = 1""")
def _(t):
    rows = t.line_items.select("document_id", "item_seq", "line_total")
    fresh = rows.where("document_id % 2 = 1").withColumn("line_total", (F.col("line_total") + 1).cast("decimal(14,2)"))
    tables = TableSet(t.spark, shared_folder(t.spark, "replaced"))
    tables.replace({"rows": rows}, rows)
    tables.replace({"rows": fresh}, fresh)
    return tables.table("rows").select("document_id", "item_seq", F.col("line_total").cast("double").alias("line_total"))


@query("audit_rows", "SNK-11", """
SELECT event_id AS line_item_id, 'user' || user_id AS actor_username, event_type AS action, '{"value":"' || CAST(CAST(value AS DECIMAL(14,2)) AS VARCHAR) || '"}' AS details_json FROM events""", views=False)
def _(t):
    details = F.create_map(F.lit("value"), F.col("value").cast("decimal(14,2)").cast("string"))
    events = t.read("events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor_username"), F.col("event_type").alias("action"),
        F.col("event_id").alias("document_id"), details.alias("details"), F.col("ts").alias("created_at"),
    )
    return store.audit_rows(events).drop("created_at").withColumnRenamed("document_id", "line_item_id")


@query("corpus_differences", "QA-01", """
, a AS (SELECT document_id, document_number, CASE WHEN document_id % 7 = 0 THEN 'x' ELSE document_type END AS document_type FROM docs WHERE document_id % 11 <> 0)  -- the others stand under another id
SELECT d.document_id, 'document_type' AS field, d.document_type AS expected, a.document_type AS actual FROM docs d JOIN a USING (document_id) WHERE d.document_type <> a.document_type
UNION ALL SELECT document_id, 'document', 'present', NULL FROM docs WHERE document_id % 11 = 0
UNION ALL SELECT -document_id - 1, 'document', NULL, 'present' FROM docs WHERE document_id % 11 = 0""")
def _(t):
    key = F.col("document_id")
    actual = t.documents.withColumns({"document_type": F.when(key % 7 == 0, "x").otherwise(F.col("document_type")), "document_id": F.when(key % 11 == 0, -key - 1).otherwise(key)})
    return quality.compare_fields(t.documents, actual, "document_id", ["document_number", "document_type"])


@query("text_leak_audit", "QA-03", """
, f AS (
  SELECT supp_key % 12 AS supplier, unnest(str_split(description_long, chr(10))) AS line, line_item_id, document_id FROM described_items
), g AS (
  SELECT supplier, document_id, line_item_id, BOOL_OR(regexp_matches(line, '^\\s*\\d[\\d.,]*\\s+\\D')) AS leading_number, BOOL_OR(regexp_matches(line, '(?:\\s+\\d{2,}){2,}\\s*$')) AS trailing_pair,
         BOOL_OR(regexp_matches(line, '\\s\\d\\s*$')) AS trailing_single, BOOL_OR(regexp_matches(line, '(?:€|EUR)|\\d{1,3}(?:\\.\\d{3})*,\\d{2}')) AS price FROM f GROUP BY ALL
)
SELECT supplier, COUNT(*) AS positions, COUNT(*) FILTER (leading_number OR trailing_pair OR trailing_single OR price) AS flagged, COUNT(*) FILTER (leading_number) AS leading_number,
       COUNT(*) FILTER (trailing_pair) AS trailing_pair, COUNT(*) FILTER (trailing_single) AS trailing_single, COUNT(*) FILTER (price) AS price FROM g GROUP BY supplier""")
def _(t):
    return quality.leak_audit(t.described_items.withColumn("supplier", F.col("supp_key") % 12), "supplier")


@query("group_discount_rows", "AMT-04 AMT-06 PRC-08", """
, r AS (
  SELECT document_id, 'Summe der Ware' AS label_raw, 'subtotal' AS line_type, subtotal AS amount, 0 AS o FROM order_sums
  UNION ALL SELECT document_id, 'Raffstore ' || replace(replace(replace(format('{:,.2f}', CAST(subtotal AS DOUBLE)), ',', '#'), '.', ','), '#', '.') || ' 20,00% -10,00', 'discount', -10.00, 1 FROM order_sums
  UNION ALL SELECT document_id, 'Motor 50,00 30,00% -15,00', 'discount', -15.00, 2 FROM order_sums
  UNION ALL SELECT document_id, 'Gesamt Nettosumme', 'net_total', net_total, 3 FROM order_sums
)
SELECT document_id, label_raw, line_type, CAST(amount AS DOUBLE) AS amount, o AS place FROM r""")
def _(t):
    text = F.concat(F.lit("Raffstore "), N.eu_format(F.col("subtotal")), F.lit(" 20,00 % 10,00\nMotor 50,00 30,00 % 15,00\nRabatte: 25,00\nRaffstore "),
                    N.eu_format(F.col("subtotal")), F.lit(" 20,00 % 10,00"))
    groups = amounts.discount_groups(t.order_sums.select("document_id", text.alias("text"))).withColumn("key", pricing.group_key(F.col("label")))
    money = "decimal(14,2)"
    base = t.order_sums.select("document_id", F.inline(F.array(
        F.struct(F.lit("subtotal").alias("line_type"), F.lit("Summe der Ware").alias("label_raw"), F.col("subtotal").alias("amount"), F.lit(0).alias("sort_order")),
        F.struct(F.lit("discount").alias("line_type"), F.lit("Rabatte: 25,00").alias("label_raw"), F.lit("-25.00").cast(money).alias("amount"), F.lit(1).alias("sort_order")),
        F.struct(F.lit("net_total").alias("line_type"), F.lit("Gesamt Nettosumme").alias("label_raw"), F.col("net_total").alias("amount"), F.lit(2).alias("sort_order")),
    ))).withColumns({"percent": F.lit(None).cast("decimal(8,4)"), "base_amount": F.lit(None).cast(money)})
    out = amounts.resequence(amounts.expand_group_discounts(base, groups), ["sort_order", "line_type"], "place")
    return out.select("document_id", "label_raw", "line_type", F.col("amount").cast("double").alias("amount"), "place")


@query("page_details", "DOC-13 FN-22", """
SELECT document_id, item_seq AS page_ref, 'A' || document_id AS source_order_number, item_seq || ',' || (item_seq + 10) AS positions, 'Systemdetails Rahmen' AS source_detail_type, 'high' AS confidence
FROM line_items""")
def _(t):
    seq = F.col("item_seq").cast("string")
    page = F.concat(F.lit("Auftrag: A"), F.col("document_id").cast("string"), F.lit("\nPosition(en): "), seq, F.lit(", "), seq, F.lit("/"),
                    (F.col("item_seq") + 10).cast("string"), F.lit("\nSystemdetails Rahmen"))
    texts = t.line_items.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("item_seq", page.alias("page")))).alias("pages"))
    # pages without a drawing stay empty and give no row
    filled = F.transform(F.sequence(F.lit(1), F.element_at("pages", -1)["item_seq"]), lambda n: F.coalesce(
        F.get(F.filter("pages", lambda p: p["item_seq"] == n), F.lit(0))["page"], F.lit("leer")))
    out = headers.page_details(texts.select("document_id", F.array_join(filled, "\f").alias("text")))
    return out.select("document_id", "page_ref", "source_order_number", F.array_join("source_position_numbers", ",").alias("positions"),
                      "source_detail_type", F.col("source_mapping_confidence").alias("confidence"))


@query("document_notes", "DOC-07 DOC-09", """
SELECT document_id, 'Allgemeine Ausführung:' || chr(10) || 'Zeile ' || document_id AS notes, 'Haus ' || document_id || ' am Hang' AS project FROM docs""")
def _(t):
    key = F.col("document_id").cast("string")
    text = F.concat(F.lit("Kopf\nKommission: Haus "), key, F.lit("\nam Hang\nTel: 1\nAllgemeine Ausführung:\nTel 0512\nZeile "), key, F.lit("\n\nGesamtpreis 1,00\nEnde"))
    rows = t.documents.select("document_id", text.alias("text"))
    return rows.select("document_id", headers.document_notes(F.col("text")).alias("notes"),
                       headers.multiline_value(X.filled_lines(F.col("text")), "Kommission").alias("project"))


@query("number_spellings", "FN-03 FN-04 FN-05", """
SELECT document_id, item_seq, CAST(line_total AS DOUBLE) AS eu, CAST(line_total AS DOUBLE) AS checked, CASE WHEN part_key % 2 = 0 THEN CAST(line_total AS DOUBLE) END AS stored FROM line_items""")
def _(t):
    even = F.col("part_key") % 2 == 0
    text = F.when(even, F.col("line_total").cast("string")).otherwise(F.concat(F.lit("EUR "), N.eu_format(F.col("line_total")), F.lit(" €")))
    printed = F.concat(F.lit("€ "), N.eu_format(F.col("line_total")))
    return t.line_items.select(
        "document_id", "item_seq", N.eu_decimal(printed).cast("double").alias("eu"), N.lenient_decimal(text, "check").cast("double").alias("checked"),
        N.lenient_decimal(text, "store").cast("double").alias("stored"),
    )


@query("image_placements", "SRC-08", """
SELECT document_id, item_seq, ROUND(LEAST(1.0::DOUBLE, (part_key % 50) / 595.0::DOUBLE), 6) AS left_ratio, ROUND(LEAST(1.0::DOUBLE, (item_seq * 130) / 842.0::DOUBLE), 6) AS top_ratio,
       ROUND(LEAST(1.0::DOUBLE, (item_seq * 130 + 60.0::DOUBLE) / 842.0::DOUBLE), 6) AS center_y_ratio FROM line_items""")
def _(t):
    top, left = F.col("item_seq") * 130, (F.col("part_key") % 50).cast("int")
    rows = t.line_items.select("document_id", "item_seq", left.alias("left"), top.alias("top"), (left + 200).alias("right"), (top + 120).alias("bottom"),
                               F.lit(595).alias("canvas_width"), F.lit(842).alias("canvas_height"))
    return layout.placement_ratios(rows).select("document_id", "item_seq", "left_ratio", "top_ratio", "center_y_ratio")


def _layout_lines(t: Tables) -> DataFrame:
    """Three layout lines per position: number, quantity with unit, label with a price."""
    y = (F.col("item_seq") - 1) % 3 * 200 + 80.5
    cell = lambda x, text, shift: F.struct(F.lit(x).alias("x0"), (y + shift).alias("y0"), text.alias("text"))
    number = F.lpad("position_no", 3, "0")
    cells = F.array(cell(30.0, number, 0.0), cell(70.0, F.concat(F.col("quantity").cast("int").cast("string"), F.lit(" Stk")), 0.5),
                    cell(120.0, F.concat(F.lit("Element K"), F.col("part_key").cast("string")), 1.0), cell(400.0, F.lit("10,00 €"), 1.2), cell(120.0, F.lit("Beschreibung"), 14.0))
    return t.line_items.select("document_id", "page_ref", F.inline(cells), F.lit(842.0).alias("page_height"))


_HINTS_SQL = """
SELECT document_id, page_ref, lpad(position_no, 3, '0') AS position_no, ROUND((((item_seq - 1) % 3) * 200 + 80.5::DOUBLE) / 842.0::DOUBLE, 6) AS item_top_ratio,
       ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY item_seq) AS hint_no FROM line_items"""


@query("layout_row_hints", "SRC-06", _HINTS_SQL)
def _(t):
    return layout.row_hints(_layout_lines(t)).withColumn("hint_no", F.col("hint_no").cast("long"))


@query("layout_left_hints", "SRC-06", _HINTS_SQL)
def _(t):
    return layout.left_column_hints(_layout_lines(t)).withColumn("hint_no", F.col("hint_no").cast("long"))


@query("description_columns", "SRC-07", """
SELECT document_id, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY item_seq) AS block, 'Fenster K' || part_key || chr(10) || 'weiß' AS description FROM line_items""")
def _(t):
    y = (F.col("item_seq") - 1) % 3 * 200 + 80.0
    cell = lambda x, dy, text: F.struct(F.lit(x).alias("x0"), (y + dy).alias("y0"), text.alias("text"))
    cells = F.array(
        cell(30.0, 0.0, F.lit("Pos.")), cell(60.0, 0.5, F.col("position_no")), cell(200.0, 1.0, F.lit("Fenster")),
        cell(240.0, 1.5, F.concat(F.lit("K"), F.col("part_key").cast("string"))), cell(420.0, 1.0, F.lit("1.265,40")), cell(150.0, 12.0, F.lit("2300")), cell(205.0, 4.2, F.lit("weiß")),
    )
    body = t.line_items.select("document_id", "page_ref", F.inline(cells))
    pages = t.line_items.select("document_id", "page_ref").distinct()
    heads = pages.select("document_id", "page_ref", F.inline(F.array(
        F.struct(F.lit(30.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit("Pos.").alias("text")), F.struct(F.lit(190.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit("Bezeichnung").alias("text")),
        F.struct(F.lit(430.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit("E-Preis").alias("text")),
    )))
    words = body.unionByName(heads).withColumn("page_width", F.lit(595.0))
    return layout.description_blocks(words)


@query("position_bands", "IMG-18", """
, b AS (SELECT document_id, page_ref, item_seq, ((item_seq - 1) % 3) * 200 + 80.0::DOUBLE AS y FROM line_items), n AS (SELECT *, LEAD(y) OVER (PARTITION BY document_id, page_ref ORDER BY y) AS ny FROM b)
SELECT document_id, page_ref, y AS y0, y - 8.0::DOUBLE AS band_top, LEAST(812.0::DOUBLE, COALESCE(LEAST(ny, y + 150.0::DOUBLE), y + 150.0::DOUBLE) - 6.0::DOUBLE) AS band_bottom FROM n""")
def _(t):
    y = (F.col("item_seq") - 1) % 3 * 200 + 80.0
    cell = lambda dy, text: F.struct(F.lit(30.0).alias("x0"), (y + dy).alias("y0"), (y + dy + 10.0).alias("y1"), text.alias("text"))
    blocks = t.line_items.select("document_id", "page_ref", F.inline(F.array(
        cell(0.0, F.concat(F.lit("Pos. "), "position_no", F.lit(" 1 Stk"))), cell(3.0, F.concat(F.lit("Pos.: "), "position_no")), cell(20.0, F.lit("AZ ohne Nummer")), cell(150.0, F.lit("-" * 30)),
    )), F.lit(842.0).alias("page_height"))
    return layout.position_bands(blocks)


@query("box_overlaps", "IMG-19", """
, x AS (SELECT document_id, page_ref, item_seq, (item_seq - 1) % 3 * 100 AS top, part_key % 5 AS s FROM line_items)
SELECT document_id, page_ref, item_seq AS box_id FROM x WHERE s < 2 """)
def _(t):
    top = ((F.col("item_seq") - 1) % 3 * 100).cast("int")
    shift = (F.col("part_key") % 5 * 20).cast("int")
    others = t.line_items.select("document_id", "page_ref", F.lit(0).alias("left"), top.alias("top"), F.lit(100).alias("right"), (top + 50).alias("bottom"))
    # boxes reach 20 points further into their own rival with every step
    boxes = t.line_items.select("document_id", "page_ref", F.col("item_seq").alias("box_id"), (F.lit(100) - shift).alias("left"), top.alias("top"),
                                (F.lit(200) - shift).alias("right"), (top + 50).alias("bottom"))
    return layout.without_overlaps(boxes, others).select("document_id", "page_ref", "box_id")


@query("images_distinct_on_page", "IMG-19", "SELECT document_id, page_ref, sha256, MIN(image_id) AS image_id FROM images GROUP BY ALL")
def _(t):
    return layout.distinct_on_page(t.images.select("document_id", "page_ref", "sha256", "image_id", "width")).select("document_id", "page_ref", "sha256", "image_id")
