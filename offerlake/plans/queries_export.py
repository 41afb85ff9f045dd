"""Queries: alternatives, export shaping, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake import schemas as S
from offerlake.functions import export_text as E
from offerlake.functions.keys import metadata_map, pricing_enabled
from offerlake.operators import alternatives as A
from offerlake.operators import export as X
from offerlake.operators.amounts import condition_profile
from offerlake.operators.validate import documents_without_positions
from offerlake.plans.catalog import query
from offerlake.plans.queries_links import HEX_SQL, LINKS_SQL, UUID_SQL, resolved_links
from offerlake.plans.queries_pricing import PROFILE_SQL
from offerlake.plans.views import Tables

EXPORTED_AT = "2026-01-02 03:04:05"


def export_items(t: Tables) -> DataFrame:
    """Positions with append marks, named parents and one sequential supplier family."""
    part = F.col("part_key")
    operations = condition_profile(t.amount_lines).select("document_id", "operations")
    return t.described_items.join(operations, "document_id", "left").select(
        "document_id", "item_seq", F.col("line_item_id").cast("string").alias("source_id"), "position_no", "is_alternative",
        "quantity", "unit", "unit_price", "line_total", "description_short", "description_long", "operations",
        "width_mm", "height_mm", "page_ref",
        (part % 5 == 0).alias("alternative_append_at_end"),
        F.when(part % 3 == 0, "1").when(part % 3 == 1, "2").alias("alternative_parent_position_no"),
        (F.col("document_id") % 6 == 0).alias("sequential_alternative"),
        F.when(part % 2 == 0, F.array(F.lit(1))).alias("embedded_append"),
        F.when(part % 10 == 0, F.array().cast("array<bigint>"))
        .when(part % 77 == 0, F.array(F.lit(-1).cast("bigint"), F.lit(999).cast("bigint")))
        .otherwise(F.array(F.col("line_item_id"))).alias("image_ids"),
        F.col("lv_pos").alias("main_line_item_id"),
    )


def export_documents(t: Tables) -> DataFrame:
    return t.documents.withColumn("pricing_on", pricing_enabled(F.col("apply_pricing_adjustments")))


def _prepared(t: Tables) -> DataFrame:
    return A.prepare_positions(export_items(t), export_documents(t))


NUMBER_SQL = """
, en AS (
  SELECT i.*, COALESCE(apply_pricing_adjustments, TRUE) AS on_flag, alternative_position_mode = 'append' AS append_mode,
         i.document_id % 6 = 0 AS sequential
  FROM described_items i JOIN docs USING (document_id)
), nm AS (
  SELECT *, NOT is_alternative AS is_main, is_alternative AND sequential AS is_forced FROM en
), nn AS (
  SELECT *, CAST(SUM(CASE WHEN is_main OR is_forced THEN 1 ELSE 0 END) OVER w AS INTEGER) AS main_no FROM nm
  WINDOW w AS (PARTITION BY document_id ORDER BY item_seq ROWS UNBOUNDED PRECEDING)
), numbered AS (
  SELECT *, LAST_VALUE(CASE WHEN is_main THEN main_no END IGNORE NULLS) OVER w AS parent_no,
         LAST_VALUE(CASE WHEN is_main THEN item_seq END IGNORE NULLS) OVER w AS parent_seq,
         MAX(main_no) OVER (PARTITION BY document_id) AS main_count
  FROM nn WINDOW w AS (PARTITION BY document_id ORDER BY item_seq ROWS UNBOUNDED PRECEDING)
)"""

PREPARED_SQL = PROFILE_SQL + NUMBER_SQL + """
, factors AS (
  SELECT p.document_id, COALESCE(CAST(f1 AS DECIMAL(5,4)), CAST(1 AS DECIMAL(5,4))) AS f1, COALESCE(CAST(f2 AS DECIMAL(5,4)), CAST(1 AS DECIMAL(5,4))) AS f2
  FROM (SELECT DISTINCT document_id FROM order_sums) p LEFT JOIN chain USING (document_id)
), emb AS (
  SELECT n.document_id, item_seq AS seq, 1 AS idx, main_no AS parent_no, CAST(main_no AS VARCHAR) AS parent_label, item_seq AS parent_seq,
         append_mode OR part_key % 2 = 0 AS to_tail, sequential AS no_group, p_brand AS label, unit, quantity,
         line_item_id || ':alt:1' AS source_id, CAST(line_item_id AS VARCHAR) AS parent_id, on_flag,
         CAST(100.5 + (part_key % 10) * 10 AS DECIMAL(14,2)) AS printed, main_count
  FROM (SELECT numbered.*, COALESCE(p_brand, 'Brand') AS p_brand FROM numbered LEFT JOIN part ON p_partkey = part_key) n
  WHERE is_main AND part_key % 3 = 0
), emb2 AS (
  SELECT e.*, CAST(ROUND(CAST(printed AS DECIMAL(20,2)) * f1 * f2, 2) AS DECIMAL(14,2)) AS purchase FROM emb e JOIN factors USING (document_id)
), stored AS (
  SELECT n.*, append_mode OR part_key % 5 = 0 AS to_tail,
         CASE WHEN part_key % 3 = 0 THEN '1' WHEN part_key % 3 = 1 THEN '2' END AS wish,
         COALESCE(description_short, split_part(description_long, chr(10), 1)) AS label
  FROM numbered n WHERE NOT is_main AND NOT is_forced
), targets AS (
  SELECT s.document_id, s.item_seq, arg_max(m.main_no, (m.item_seq, CASE WHEN CAST(m.main_no AS VARCHAR) = s.wish THEN 1 ELSE 0 END)) AS target_no,
         arg_max(m.item_seq, (m.item_seq, CASE WHEN CAST(m.main_no AS VARCHAR) = s.wish THEN 1 ELSE 0 END)) AS target_seq,
         arg_max(m.line_item_id, (m.item_seq, 0)) AS target_id
  FROM stored s JOIN numbered m ON m.document_id = s.document_id AND m.is_main AND m.item_seq < s.item_seq
   AND (m.position_no = s.wish OR CAST(m.main_no AS VARCHAR) = s.wish)
  GROUP BY ALL
), deferred AS (
  SELECT s.*, target_no, target_seq, target_id FROM stored s JOIN targets t USING (document_id, item_seq) WHERE NOT to_tail
), inline AS (
  SELECT s.* FROM stored s LEFT JOIN targets t USING (document_id, item_seq) WHERE NOT to_tail AND target_no IS NULL
), dgroup AS (
  SELECT document_id, target_no, lower(label) AS gkey, lower(unit) AS gunit, COUNT(*) AS n, MIN(item_seq) AS first_at, MAX(target_seq) AS target_seq,
         SUM(unit_price) AS unit_price, arg_min(quantity, item_seq) AS quantity, arg_min(line_total, item_seq) AS first_total,
         arg_min(label, item_seq) AS label, arg_min(line_item_id, item_seq) AS first_id, arg_min(target_id, item_seq) AS target_id,
         arg_min(description_short, item_seq) AS first_short
  FROM deferred GROUP BY document_id, target_no, lower(label), lower(unit)
), dnum AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, target_no ORDER BY first_at) AS list_idx FROM dgroup
), nested AS (
  SELECT document_id, CAST(parent_no AS VARCHAR) AS counter, parent_label, seq AS event_seq, 1 AS list_idx, parent_seq AS major, 2 AS minor,
         quantity, CASE WHEN on_flag THEN purchase ELSE printed END AS unit_price, CAST(NULL AS DECIMAL(14,2)) AS line_total, label AS short_text, source_id, source_id AS export_id, 1 AS sources, seq AS tie
  FROM emb2 WHERE NOT to_tail
  UNION ALL
  SELECT document_id, COALESCE(CAST(parent_no AS VARCHAR), position_no), COALESCE(CAST(parent_no AS VARCHAR), CAST(GREATEST(1, main_no) AS VARCHAR)), item_seq, 0, item_seq, 0,
         quantity, unit_price, line_total, description_short, CAST(line_item_id AS VARCHAR), CAST(line_item_id AS VARCHAR), 1, item_seq FROM inline
  UNION ALL
  SELECT document_id, CAST(target_no AS VARCHAR), CAST(target_no AS VARCHAR), 2147483647, list_idx, target_seq, 1, quantity, unit_price,
         CASE WHEN n > 1 THEN CAST(ROUND(quantity * unit_price, 2) AS DECIMAL(14,2)) ELSE first_total END,
         CASE WHEN n > 1 THEN label ELSE first_short END,
         CASE WHEN n > 1 THEN 'aggregate:nested:' || target_no || ':' || list_idx || ':' || lower(label) ELSE CAST(first_id AS VARCHAR) END,
         CASE WHEN n > 1 THEN target_id || ':aggregate:nested:' || target_no || ':' || list_idx || ':' || lower(label) ELSE CAST(first_id AS VARCHAR) END, n, first_at
  FROM dnum
), nested_numbered AS (
  SELECT *, parent_label || '.' || ROW_NUMBER() OVER (PARTITION BY document_id, counter ORDER BY event_seq, list_idx, tie) AS position_no FROM nested
), tail_rows AS (
  SELECT document_id, seq, idx, label, unit, quantity, CASE WHEN on_flag THEN purchase ELSE printed END AS unit_price, printed AS exp_unit, CAST(NULL AS DECIMAL(14,2)) AS line_total, no_group, source_id, parent_id, label AS short_text, main_count
  FROM emb2 WHERE to_tail
  UNION ALL
  SELECT document_id, item_seq, 0, label, unit, quantity, unit_price, unit_price, line_total, FALSE, CAST(line_item_id AS VARCHAR), CAST(line_item_id AS VARCHAR), description_short, main_count FROM stored WHERE to_tail
), tail_keyed AS (
  SELECT *, CASE WHEN no_group THEN '~' || seq ELSE regexp_replace(regexp_replace(lower(label), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g') || '|' || lower(unit) END AS gkey FROM tail_rows
), tail_grouped AS (
  SELECT document_id, gkey, MAX(no_group) AS alone, COUNT(*) AS n, MIN((seq, idx)) AS first_at, CAST(SUM(quantity) AS DECIMAL(14,4)) AS quantity, CAST(ROUND(SUM(exp_unit * quantity), 2) AS DECIMAL(14,2)) AS total,
         arg_min(unit_price, (seq, idx)) AS first_unit, arg_min(line_total, (seq, idx)) AS first_total, arg_min(label, (seq, idx)) AS label, arg_min(source_id, (seq, idx)) AS first_id,
         arg_min(parent_id, (seq, idx)) AS parent_id, arg_min(short_text, (seq, idx)) AS first_short, MAX(main_count) AS main_count
  FROM tail_keyed GROUP BY document_id, gkey
), tail_numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY alone, first_at) AS list_idx,
         trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS lkey FROM tail_grouped
), prepared AS (
  SELECT document_id, item_seq AS major, 0 AS minor, 0 AS list_idx, CAST(main_no AS VARCHAR) AS position_no, is_alternative, quantity, unit_price, line_total,
         description_short AS short_text, CAST(line_item_id AS VARCHAR) AS source_id, CAST(line_item_id AS VARCHAR) AS export_id, 1 AS sources FROM numbered WHERE is_main OR is_forced
  UNION ALL
  SELECT document_id, major, minor, list_idx, position_no, TRUE, quantity, unit_price, line_total, short_text, source_id, export_id, sources FROM nested_numbered
  UNION ALL
  SELECT document_id, 2147483647, 0, list_idx, CAST(main_count + list_idx AS VARCHAR), TRUE, quantity,
         CASE WHEN n > 1 THEN CAST(CAST((2 * CAST(total * 100 AS BIGINT) + CAST(quantity AS BIGINT)) // (2 * CAST(quantity AS BIGINT)) AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) ELSE first_unit END,
         CASE WHEN n > 1 THEN total ELSE first_total END, CASE WHEN n > 1 THEN label ELSE first_short END,
         CASE WHEN n > 1 THEN 'aggregate:alt:' || list_idx || ':' || trim(regexp_replace(lower(label), '[^a-z0-9]', ' ', 'g')) ELSE first_id END,
         CASE WHEN n > 1 THEN parent_id || ':aggregate:alt:' || list_idx || ':' || lkey ELSE first_id END, n
  FROM tail_numbered
)"""


@query("main_numbers", "ALT-02 ALT-08", NUMBER_SQL + """
SELECT document_id, item_seq, is_main, is_forced, main_no, CAST(parent_no AS DOUBLE) AS parent_no, main_count FROM numbered""")
def _(t):
    out = A.main_numbers(A.with_defaults(export_items(t)))
    return out.select(
        "document_id", "item_seq", "is_main", "is_forced", "main_no", F.col("parent_no").cast("double").alias("parent_no"), "main_count"
    )


@query("embedded_alternatives", "ALT-01 FN-18", """
SELECT document_id, item_seq, COALESCE(p_brand, 'Brand') || ' EP: € 1' || (part_key % 10) || '0,50' AS alternative,
       COALESCE(p_brand, 'Brand') AS short_text
FROM line_items LEFT JOIN part ON p_partkey = part_key WHERE part_key % 3 = 0""")
def _(t):
    rows = t.described_items.select("document_id", "item_seq", F.explode(E.embedded_alternatives(F.col("description_long"))).alias("alternative"))
    return rows.withColumn("short_text", E.strip_price_tokens(F.col("alternative")))


@query("export_positions", "ALT-02 ALT-03 ALT-04 ALT-05 ALT-06 ALT-07", PREPARED_SQL + """
SELECT document_id, major, minor, list_idx, position_no, is_alternative, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(line_total AS DOUBLE) AS line_total, short_text, source_id, export_id, sources FROM prepared""")
def _(t):
    return _prepared(t).select(
        "document_id", "major", "minor", "list_idx", "position_no", "is_alternative",
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "line_total")],
        F.col("description_short").alias("short_text"), "source_id", F.col("export_source_id").alias("export_id"),
        F.col("source_count").alias("sources"),
    )


def _with_images(t: Tables) -> DataFrame:
    return X.with_primary_images(_prepared(t), t.images)


@query("export_position_rows", "ALT-10 FN-17 SNK-09 FLT-06", None)
def _(t):
    return X.position_rows(_with_images(t), F.lit(EXPORTED_AT).cast("timestamp"))


@query("export_position_prices", "ALT-10 PRC-12", PREPARED_SQL + """
SELECT p.document_id, position_no, is_alternative, CASE WHEN COALESCE(apply_pricing_adjustments, TRUE) THEN 999999.0::DOUBLE END AS sentinel,
       CAST(quantity AS DOUBLE) AS quantity, export_id AS source_line_item_id
FROM prepared p JOIN docs USING (document_id)""")
def _(t):
    rows = X.position_rows(_with_images(t).withColumn("main_line_item_id", F.col("document_id").cast("string")), F.lit(EXPORTED_AT).cast("timestamp"))
    return rows.select(
        F.col("main_line_item_id").cast("long").alias("document_id"), "position_no", "is_alternative",
        F.when(F.col("unit_price") == 999999.0, F.col("unit_price")).alias("sentinel"), "quantity", "source_line_item_id",
    )


@query("export_headers", "ALT-09 FN-26 LNK-07", LINKS_SQL + PREPARED_SQL + """
, onlyalt AS (SELECT document_id, BOOL_AND(is_alternative) AS a FROM prepared GROUP BY document_id)
SELECT CAST(d.document_id AS VARCHAR) AS source_document_id, supplier_name,
       CASE WHEN document_type = 'auftragsbestaetigung' THEN 'auftrag' ELSE document_type END AS document_type, document_number,
       CASE WHEN linked_offer_document_id IS NOT NULL THEN CAST(linked_offer_document_id AS VARCHAR) WHEN document_type <> 'auftragsbestaetigung' THEN offer_reference END AS offer_reference,
       CAST(document_date AS VARCHAR) AS document_date, project_ref, currency AS currency_code, CAST(net_total AS DOUBLE) AS net_total,
       CAST(vat_total AS DOUBLE) AS vat_total, CAST(gross_total AS DOUBLE) AS gross_total, COALESCE(a, FALSE) AS is_alternate, '2026-01-02 03:04:05' AS created_at,
       project_ref AS subject, FALSE AS orderdoc_additional, """ + UUID_SQL.format(HEX_SQL.format("'document:' || d.document_id")) + """ AS external_document_id
FROM docs d LEFT JOIN links l ON l.document_id = d.document_id LEFT JOIN onlyalt o ON o.document_id = d.document_id""")
def _(t):
    rows = X.header_rows(t.documents, resolved_links(t), _prepared(t), F.lit(EXPORTED_AT).cast("timestamp"))
    return rows.drop("supplier_id", "tax_type", "customer_id", "orderdoc_destination")


@query("export_image_warnings", "ALT-11 SNK-08", PREPARED_SQL + """
, pi AS (
  SELECT p.document_id, p.position_no, i.part_key, i.line_item_id, i.part_key % 9 = 0 AS no_path
  FROM prepared p JOIN line_items i ON CAST(i.line_item_id AS VARCHAR) = p.source_id AND i.document_id = p.document_id
)
SELECT document_id, position_no, CASE WHEN part_key % 77 = 0 THEN 'primary_image_missing' ELSE 'primary_image_storage_path_missing' END AS code,
       CASE WHEN part_key % 77 = 0 THEN 999 ELSE line_item_id END AS primary_image_id
FROM pi WHERE part_key % 10 <> 0 AND (part_key % 77 = 0 OR no_path)""")
def _(t):
    return X.image_warnings(_with_images(t))


@query("export_summary", "ALT-12", PREPARED_SQL + """
, pw AS (
  SELECT p.*, i.part_key FROM prepared p LEFT JOIN line_items i ON CAST(i.line_item_id AS VARCHAR) = p.source_id AND i.document_id = p.document_id
), cnt AS (
  SELECT document_id, COUNT(*) AS position_count, SUM(CASE WHEN is_alternative THEN sources ELSE 0 END) AS alternative_position_count,
         COUNT(*) FILTER (part_key % 10 <> 0 AND (part_key % 77 = 0 OR part_key % 9 = 0)) AS warning_count,
         BOOL_OR(COALESCE(part_key % 10 <> 0 AND part_key % 77 <> 0 AND part_key % 9 <> 0, FALSE)) AS has_images
  FROM pw GROUP BY document_id
)
SELECT document_id, alternative_position_mode, COALESCE(position_count, 0) AS position_count, COALESCE(alternative_position_count, 0) AS alternative_position_count,
       COALESCE(warning_count, 0) AS warning_count, COALESCE(has_images, FALSE) AS has_images, CASE WHEN cnt.document_id IS NULL THEN 1 ELSE 0 END AS error_count
FROM docs LEFT JOIN cnt USING (document_id)""")
def _(t):
    return X.export_summary(_with_images(t), t.documents, documents_without_positions(t.documents, t.positions))


@query("export_id_map", "ALT-13 FN-17", PREPARED_SQL + """
, last_of AS (SELECT document_id, export_id, arg_max(source_id, (major, minor, list_idx)) AS source_id FROM prepared GROUP BY ALL
), named AS (SELECT document_id, export_id, """ + HEX_SQL.format("'document:' || document_id || ':line-item:' || source_id") + """ AS b FROM last_of)
SELECT document_id, export_id AS source_line_item_id, """ + UUID_SQL.format("b") + """ AS external_line_item_id FROM named""")
def _(t):
    return X.line_item_ids(_prepared(t))


@query("clean_long_texts", "FLT-06 FN-19 FN-18", """
SELECT document_id, item_seq, COALESCE(p_name, 'Position') || chr(10)
       || CASE WHEN FALSE THEN '' ELSE '12 Stk ' || COALESCE(p_type, 'TYPE') || chr(10) || 'lackiert' END AS long_text
FROM line_items LEFT JOIN part ON p_partkey = part_key""")
def _(t):
    return t.described_items.select(
        "document_id", "item_seq", E.clean_long_text(F.col("description_long"), F.col("quantity"), F.col("unit")).alias("long_text")
    )


@query("quantity_heads", "FN-19 FN-15", """
SELECT document_id, item_seq, CASE WHEN part_key % 2 = 0 AND unit <> 'lfm' THEN COALESCE(p_type, 'TYPE')
       ELSE CASE WHEN part_key % 2 = 0 THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) ELSE '9999' END || ' Stk ' || COALESCE(p_type, 'TYPE') END || chr(10) || 'lackiert' AS long_text
FROM line_items LEFT JOIN part ON p_partkey = part_key""")
def _(t):
    even = F.col("part_key") % 2 == 0
    number = F.when(even, F.col("quantity").cast("long").cast("string")).otherwise("9999")
    kind = F.regexp_extract("description_long", r"12 Stk (\w+)", 1)
    text = F.concat(number, F.lit(" Stk "), kind, F.lit("\nlackiert"))
    return t.described_items.select(
        "document_id", "item_seq", E.clean_long_text(text, F.col("quantity"), F.col("unit")).alias("long_text")
    )


@query("rich_texts", "SNK-09", """
SELECT document_id, item_seq, '{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Calibri;}}\\viewkind4\\uc1\\pard\\f0\\fs18 '
  || replace(replace(COALESCE(p_name, 'Position') || '|{x}|' || unit, '{x}', '\\{x\\}'), 'ü', '\\u252?') || '\\line Ende\\par}' AS rtf
FROM line_items LEFT JOIN part ON p_partkey = part_key""")
def _(t):
    first = F.regexp_extract("description_long", r"^([^\n]*)", 1)
    return t.described_items.select(
        "document_id", "item_seq", E.rich_text(F.concat(first, F.lit("|{x}|"), F.col("unit"), F.lit("\nEnde"))).alias("rtf")
    )


@query("nested_json", "SNK-01 LNK-12", """
, ij AS (
  SELECT document_id, string_agg('{"item_seq":' || item_seq || ',"position_no":"' || position_no || '","unit_price":"' || CAST(unit_price AS VARCHAR)
           || '","line_total":"' || CAST(line_total AS VARCHAR) || '"}', ',' ORDER BY item_seq) AS items FROM line_items GROUP BY document_id
), aj AS (
  SELECT document_id, string_agg('{"sort_order":' || sort_order || ',"line_type":"' || line_type || '","amount":"' || CAST(amount AS VARCHAR) || '"}', ',' ORDER BY sort_order) AS amounts
  FROM amount_lines GROUP BY document_id
)
SELECT document_id, '{"document":{"document_id":' || document_id || ',"document_number":"' || document_number || '"' || CASE WHEN net_total IS NOT NULL THEN ',"net_total":"' || CAST(net_total AS VARCHAR) || '"' ELSE '' END
  || ',"document_date":"' || CAST(document_date AS VARCHAR) || '"}' || COALESCE(',"line_items":[' || items || ']', '') || COALESCE(',"amount_lines":[' || amounts || ']', '') || '}' AS json
FROM docs LEFT JOIN ij USING (document_id) LEFT JOIN aj USING (document_id)""")
def _(t):
    return X.nested_documents(
        t.documents.select("document_id", "document_number", "net_total", "document_date"),
        {
            "line_items": (t.line_items.select("document_id", "item_seq", "position_no", "unit_price", "line_total"), "item_seq"),
            "amount_lines": (t.amount_lines.select("document_id", "sort_order", "line_type", "amount"), "sort_order"),
        },
    )


@query("flat_export_rows", "SNK-02 FN-24", """
SELECT document_id, document_type, offer_reference, document_number, CAST(document_date AS VARCHAR) AS document_date, supplier_name, project_ref, currency, approval_status,
       position_no, lv_pos, is_alternative, CAST(quantity AS DOUBLE) AS quantity, unit, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(line_total AS DOUBLE) AS line_total, 2 AS image_count, line_item_id || ',' || (line_item_id + 1) AS image_ids
FROM line_items JOIN docs USING (document_id)""")
def _(t):
    item = F.col("line_item_id")
    items = t.line_items.withColumn("image_ids", F.array_distinct(F.array(item, item + 1, item)))
    rows = X.flat_rows(t.documents, items)
    kept = ["document_id", "document_type", "offer_reference", "document_number", "supplier_name", "project_ref", "currency",
            "approval_status", "position_no", "lv_pos", "is_alternative", "unit", "image_count", "image_ids"]
    return rows.select(
        *kept, F.col("document_date").cast("string").alias("document_date"),
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "line_total")],
    )


@query("export_error_texts", "SNK-10", """
, e AS (
  SELECT user_id AS document_id, event_id, event_type AS code, CASE WHEN event_id % 3 <> 0 THEN 'event ' || event_id END AS message,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS error_no FROM events
), n AS (SELECT document_id, COUNT(*) AS total FROM e GROUP BY document_id)
SELECT document_id, string_agg(code || ': ' || COALESCE(message, code), '; ' ORDER BY error_no)
       || CASE WHEN MAX(total) > 8 THEN '; ... ' || (MAX(total) - 8) || ' weitere Fehler' ELSE '' END AS error_text
FROM e JOIN n USING (document_id) WHERE error_no < 8 GROUP BY document_id""")
def _(t):
    from pyspark.sql import Window

    event = F.col("event_id")
    errors = t.read("events").select(
        F.col("user_id").alias("document_id"), "event_id", F.col("event_type").alias("code"),
        F.when(event % 3 != 0, F.concat(F.lit("event "), event.cast("string"))).alias("message"),
    )
    # the first eight by rank are kept per task before the shuffle; the total is a plain count
    first = Window.partitionBy("document_id").orderBy("event_id")
    ranked = errors.withColumn("error_no", F.row_number().over(first) - 1).where("error_no < 8")
    totals = errors.groupBy("document_id").agg(F.count("*").alias("total"))
    return X.error_text(ranked, totals)


@query("target_binding", "SNK-05 SNK-06 QA-02", """
SELECT CAST(document_id AS VARCHAR) AS "Source_Document_ID", supplier_name AS "SUPPLIER_NAME", FALSE AS is_alternative FROM docs""")
def _(t):
    rows = X.header_rows(
        t.documents, t.documents.select("document_id", F.lit(None).cast("long").alias("linked_offer_document_id")),
        t.line_items.select("document_id", F.lit(False).alias("is_alternative")), F.lit(EXPORTED_AT).cast("timestamp"),
    )
    bindings = X.resolve_bindings(
        S.HEADER_COLUMNS, ("source_document_id",), ["Source_Document_ID", "SUPPLIER_NAME", "is_alternative", "extra"], S.HEADER_ALIASES
    )
    return X.bind(rows, bindings)


@query("typed_target_values", "SNK-07", """
SELECT document_id, CASE WHEN document_id % 5 < 3 THEN CAST(document_date AS VARCHAR) END AS day,
       CASE WHEN document_id % 5 >= 3 THEN 'kein Datum' END AS day_unread,
       CASE WHEN document_id % 2 = 0 THEN CAST(document_date AS VARCHAR) || ' 10:20:30' END AS moment,
       CASE WHEN document_id % 2 <> 0 THEN 'gestern' END AS moment_unread,
       CASE WHEN document_id % 3 <> 0 THEN upper(hex(CAST(document_id AS VARCHAR))) END AS bytes, CASE WHEN document_id % 3 = 0 THEN 'zz' END AS bytes_unread
FROM docs""")
def _(t):
    key, day = F.col("document_id"), F.col("document_date")
    text = (
        F.when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 5 == 1, F.date_format(day, "dd.MM.yyyy"))
        .when(key % 5 == 2, F.date_format(day, "yyyy/MM/dd")).otherwise("kein Datum")
    )
    moment = F.when(key % 4 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:20:30"))).when(
        key % 4 == 2, F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" 10:20:30"))
    ).otherwise("gestern")
    raw = F.when(key % 3 == 0, "zz").otherwise(F.concat(F.lit("0x"), F.hex(F.encode(key.cast("string"), "UTF-8"))))
    rows = t.documents.select("document_id", text.alias("day"), moment.alias("moment"), raw.alias("bytes"))
    out = X.coerce(rows, {"day": "date", "moment": "timestamp", "bytes": "binary"})
    return out.withColumns({
        "day": F.col("day").cast("string"), "moment": F.date_format("moment", "yyyy-MM-dd HH:mm:ss"), "bytes": F.hex("bytes")
    })


@query("metadata_maps", "FN-25", """
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""", views=False)
def _(t):
    return t.read("events").select("event_id", F.try_element_at(metadata_map(F.col("props")), F.lit("k")).alias("k"))
