"""Queries: what is written and read back. Snapshots, loads, journals, image content, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake import schemas as S
from offerlake.operators import export, items, load, store, validate
from offerlake.operators.snapshot import TableSet
from offerlake.plans.catalog import query
from offerlake.plans.queries_export import EXPORTED_AT
from offerlake.plans.queries_links import LINKS_SQL, resolved_links
from offerlake.plans.queries_validation import CHECKED_SQL, checked_items, kept_amounts, odd_documents, page_counts
from offerlake.plans.process import extract_items, stage_by_template
from offerlake.plans.render import CONFIRMING, MIXED, rendered, rendered_mixed
from offerlake.plans.views import Tables
from offerlake.rules.registry import REGISTRY
from offerlake.rules.suppliers import SUPPLIER_NAMES
from offerlake.session import shared_folder, staged
from offerlake.sources import files
from offerlake.streaming.jobs import document_tables, fold_batch, process_batch


def _four_tables(t: Tables) -> dict[str, DataFrame]:
    return {
        "documents": t.documents.select("document_id", "document_number", "net_total"),
        "amount_lines": t.amount_lines.select("document_id", "sort_order", "line_type", "amount"),
        "line_items": t.line_items.select("document_id", "item_seq", "position_no", "line_total"),
        "images": t.images.select("document_id", "image_id", "storage_path", "bytes_size"),
    }


@query("replaced_tables", "SNK-03 MUT-01", """
, kept AS (SELECT document_id, document_id % 2 = 1 AS changed FROM docs WHERE document_id % 5 <> 0)
SELECT 'documents' AS part, document_id, 0 AS child, CAST(CASE WHEN changed THEN net_total + 1 ELSE net_total END AS DOUBLE) AS value FROM kept JOIN docs USING (document_id)
UNION ALL SELECT 'amount_lines', document_id, sort_order, CAST(CASE WHEN changed THEN amount + 1 ELSE amount END AS DOUBLE) FROM kept JOIN amount_lines USING (document_id) WHERE NOT changed OR sort_order < 5
UNION ALL SELECT 'line_items', document_id, item_seq, CAST(CASE WHEN changed THEN line_total + 1 ELSE line_total END AS DOUBLE) FROM kept JOIN line_items USING (document_id) WHERE NOT changed OR item_seq > 1
UNION ALL SELECT 'images', document_id, image_id, CAST(bytes_size AS DOUBLE) FROM kept JOIN images USING (document_id) WHERE NOT changed""")
def _(t):
    """Load all, parse the odd documents anew (fewer children, no images), reset every fifth."""
    tables = TableSet(t.spark, shared_folder(t.spark, "tables"))
    given = _four_tables(t)
    ids = given["documents"].select("document_id").unionByName(given["line_items"].select("document_id")).distinct()
    tables.replace(given, ids, writer="load", batch=0)
    odd = F.col("document_id") % 2 == 1
    more = lambda c: (F.col(c) + 1).cast("decimal(14,2)")
    tables.replace({
        "documents": given["documents"].where(odd).withColumn("net_total", more("net_total")),
        "amount_lines": given["amount_lines"].where(odd & (F.col("sort_order") < 5)).withColumn("amount", more("amount")),
        "line_items": given["line_items"].where(odd & (F.col("item_seq") > 1)).withColumn("line_total", more("line_total")),
        "images": given["images"].limit(0),
    }, ids.where(odd), writer="load", batch=1)
    reset = ids.where("document_id % 5 = 0")
    for _ in range(2):  # the second run finds its batch committed
        tables.replace({name: df.limit(0) for name, df in given.items()}, reset, writer="load", batch=2)
    cells = {"documents": (F.lit(0), "net_total"), "amount_lines": ("sort_order", "amount"), "line_items": ("item_seq", "line_total"), "images": ("image_id", "bytes_size")}
    stored = tables.tables()
    parts = [
        stored[name].select(F.lit(name).alias("part"), "document_id", (F.col(child) if isinstance(child, str) else child).cast("long").alias("child"), F.col(value).cast("double").alias("value"))
        for name, (child, value) in cells.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _header_payload(t: Tables) -> DataFrame:
    key, text = F.col("document_id"), F.col("document_id").cast("string")
    values = {
        "external_document_id": F.concat(F.lit("D-"), text), "source_document_id": text, "supplier_id": F.lit("L").cast("string"), "currency_code": F.col("currency"),
        "document_date": F.when(key % 13 == 0, "unbekannt").otherwise(F.date_format("document_date", "dd.MM.yyyy")),
        "net_total": F.col("net_total").cast("double"), "vat_total": F.col("vat_total").cast("double"), "gross_total": F.col("gross_total").cast("double"),
        "is_alternate": key % 3 == 0, "created_at": F.lit(EXPORTED_AT), "subject": F.concat(F.lit("Herr O'Neill "), text),
        "orderdoc_additional": key % 2 == 0,
    }
    own = t.documents.columns
    return t.documents.select(*[values.get(c, F.col(c) if c in own else F.lit(None).cast("string")).alias(c) for c in S.HEADER_COLUMNS])


def _position_payload(rows: DataFrame) -> DataFrame:
    key, item = F.col("document_id").cast("string"), F.col("line_item_id").cast("string")
    values = {
        "external_line_item_id": F.concat(F.lit("P-"), item), "external_document_id": F.concat(F.lit("D-"), key), "source_line_item_id": item,
        "quantity": F.col("quantity").cast("double"), "unit_code": F.col("unit"), "width_mm": F.col("width_mm").cast("double"), "height_mm": F.col("height_mm").cast("double"),
        "description_short": F.concat(F.lit("Kurz '"), item, F.lit("'")), "description_long": F.concat(F.lit("Lang "), item), "text_only_rtf": F.concat(F.lit("{\\rtf1 "), item, F.lit("}")),
        "unit_price": F.col("unit_price").cast("double"), "page_ref": F.col("page_ref").cast("string"), "image_is_primary": F.col("part_key") % 2 == 0,
        "image_hex": F.when(F.col("part_key") % 2 == 0, F.concat(F.lit("0x"), F.hex(F.encode(item, "UTF-8")))).when(F.col("part_key") % 7 == 0, "zz"),
        "created_at": F.lit(EXPORTED_AT), "main_line_item_id": F.col("lv_pos"),
    }
    return rows.select(*[values.get(c, F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in S.POSITION_COLUMNS])


def _loaded(t: Tables) -> TableSet:
    """Everything, then the even documents again with a later header and fewer positions, some without any."""
    target = TableSet(t.spark, shared_folder(t.spark, "erp"), key=load.KEY)
    # both loads and their journals read them: numbered once
    headers, positions = _header_payload(t), _position_payload(staged(t.line_items, "erp-positions"))
    load.load(headers, positions, target, writer="erp", batch=0)
    number = F.col("source_document_id").cast("long")
    again = headers.where(number % 2 == 0).withColumn("subject", F.lit("zweite Ladung"))
    place = F.col("source_line_item_id").cast("long") % 100
    fewer = positions.where(place > 1).where(F.substring("external_document_id", 3, 20).cast("long") % 2 == 0)
    load.load(again, fewer, target, writer="erp", batch=1)
    return target


@query("erp_headers", "SNK-04 SNK-06 SNK-07", """
SELECT 'D-' || document_id AS external_document_id, CAST(document_id AS VARCHAR) AS source_document_id, supplier_name, 'L' AS supplier_id, document_type, document_number, offer_reference,
       CASE WHEN document_id % 13 <> 0 THEN CAST(document_date AS VARCHAR) END AS document_date, project_ref, currency AS currency_code, CAST(net_total AS DOUBLE) AS net_total,
       CAST(vat_total AS DOUBLE) AS vat_total, CAST(gross_total AS DOUBLE) AS gross_total, document_id % 3 = 0 AS is_alternate, '2026-01-02 03:04:05' AS created_at,
       CASE WHEN document_id % 2 = 0 THEN 'zweite Ladung' ELSE 'Herr O''Neill ' || document_id END AS subject, CAST(NULL AS VARCHAR) AS tax_type, CAST(NULL AS VARCHAR) AS customer_id,
       CAST(NULL AS VARCHAR) AS orderdoc_destination, document_id % 2 = 0 AS orderdoc_additional
FROM docs""")
def _(t):
    rows = _loaded(t).table("erp_header")
    return rows.withColumns({"document_date": F.col("document_date").cast("string"), "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")})


@query("erp_positions", "SNK-04 SNK-06 SNK-07", """
SELECT 'P-' || line_item_id AS external_line_item_id, 'D-' || document_id AS external_document_id, CAST(line_item_id AS VARCHAR) AS source_line_item_id, position_no, CAST(NULL AS VARCHAR) AS item_type,
       is_alternative, CAST(quantity AS DOUBLE) AS quantity, unit AS unit_code, CAST(width_mm AS DOUBLE) AS width_mm, CAST(height_mm AS DOUBLE) AS height_mm,
       'Kurz ''' || line_item_id || '''' AS description_short, 'Lang ' || line_item_id AS description_long, '{\\rtf1 ' || line_item_id || '}' AS text_only_rtf, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(NULL AS VARCHAR) AS purchase_price, CAST(page_ref AS VARCHAR) AS page_ref, CAST(NULL AS VARCHAR) AS image_long_text_rtf, CAST(NULL AS VARCHAR) AS image_only_rtf,
       CASE WHEN part_key % 2 = 0 THEN hex(CAST(line_item_id AS VARCHAR)) END AS image_hex, part_key % 2 = 0 AS image_is_primary, '2026-01-02 03:04:05' AS created_at,
       CAST(NULL AS VARCHAR) AS article_no, CAST(NULL AS VARCHAR) AS discount_1, CAST(NULL AS VARCHAR) AS discount_2, CAST(NULL AS VARCHAR) AS vat_type, CAST(NULL AS VARCHAR) AS unity, lv_pos AS main_line_item_id
FROM line_items WHERE document_id % 2 = 1 OR item_seq > 1""")
def _(t):
    rows = _loaded(t).table("erp_position")
    return rows.withColumns({"image_hex": F.hex("image_hex"), "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")})


@query("erp_unread_values", "SNK-07", """
SELECT 'D-' || document_id AS external_document_id, 'header' AS part, CAST(document_id AS VARCHAR) AS source_id, 'document_date' AS "column", 'unbekannt' AS value FROM docs WHERE document_id % 13 = 0
UNION ALL SELECT 'D-' || document_id, 'position', CAST(line_item_id AS VARCHAR), 'image_hex', 'zz' FROM line_items WHERE part_key % 2 <> 0 AND part_key % 7 = 0 AND (document_id % 2 = 1 OR item_seq > 1)""")
def _(t):
    return _loaded(t).table("erp_unread")


@query("erp_load_statements", "SNK-05", """
, cells AS (
  SELECT document_id, line_item_id, 'INSERT INTO erp_position (' || 'external_line_item_id, external_document_id, position_no, is_alternative, page_ref, lv_pos' || ') VALUES (N''P-' || line_item_id || ''', N''D-' || document_id
    || ''', N''' || position_no || ''', ' || CASE WHEN is_alternative THEN '1' ELSE '0' END || ', ' || page_ref || ', ' || COALESCE('N''' || lv_pos || '''', 'NULL') || ');' AS statement FROM line_items
)
SELECT 'D-' || document_id AS external_document_id, step, CAST(NULL AS VARCHAR) AS source_id,
  CASE step WHEN 0 THEN 'SET XACT_ABORT ON;' WHEN 1 THEN 'BEGIN TRANSACTION;' WHEN 2 THEN 'DELETE FROM erp_position WHERE external_document_id = N''D-' || document_id || ''';'
    WHEN 3 THEN 'DELETE FROM erp_header WHERE external_document_id = N''D-' || document_id || ''';'
    WHEN 4 THEN 'INSERT INTO erp_header (external_document_id, source_document_id, subject, document_date, created_at) VALUES (N''D-' || document_id || ''', N''' || document_id || ''', N''Herr O''''Neill '
      || document_id || ''', CONVERT(datetime, ''' || strftime(document_date, '%Y%m%d') || ''', 112), CAST(''2026-01-02T03:04:05'' AS datetime2));'
    ELSE 'COMMIT TRANSACTION;' END AS statement
FROM docs, (SELECT unnest([0, 1, 2, 3, 4, 6]) AS step)
UNION ALL SELECT 'D-' || document_id, 5, 'P-' || line_item_id, statement FROM cells""")
def _(t):
    headers = _header_payload(t).join(t.documents.select(F.col("document_id").cast("string").alias("source_document_id"), F.col("document_date").alias("day")), "source_document_id").select(
        "external_document_id", "source_document_id", "subject", F.col("day").alias("document_date"), F.col("created_at").cast("timestamp").alias("created_at"))
    item = F.col("line_item_id").cast("string")
    positions = t.line_items.select(
        F.concat(F.lit("P-"), item).alias("external_line_item_id"), F.concat(F.lit("D-"), F.col("document_id").cast("string")).alias("external_document_id"),
        "position_no", "is_alternative", "page_ref", "lv_pos",
    )
    return load.load_statements(headers, positions, "erp_header", "erp_position")


# --- image files --------------------------------------------------------------------------------

def _stored_images(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Images whose files hold the text of a page; every ninth has no path, every seventh no file."""
    key = F.col("page_id")
    pages = t.read("pages").select(key.alias("image_id"), F.when(key % 9 != 0, F.concat(F.lit("/img/"), (key % 10).cast("string"), F.lit("/"), key.cast("string"), F.lit(".png"))).alias("storage_path"),
                                   F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    folder = shared_folder(t.spark, "images")
    files.write_files(pages.where("storage_path IS NOT NULL AND image_id % 7 <> 0").select("storage_path", "content"), folder).write.format("noop").mode("overwrite").save()
    return pages.drop("content"), files.image_files(t.spark, folder)


@query("image_contents", "SNK-08 SRC-08", """
SELECT page_id AS image_id, CASE WHEN page_id % 9 = 0 THEN 'missing_storage_path' WHEN page_id % 7 = 0 THEN 'file_not_found' END AS content_error,
       CASE WHEN page_id % 9 <> 0 AND page_id % 7 <> 0 THEN sha256(COALESCE(html, '')) END AS content_sha256,
       CASE WHEN page_id % 9 <> 0 AND page_id % 7 <> 0 THEN octet_length(encode(COALESCE(html, ''))) END AS content_bytes,
       CASE WHEN page_id % 9 <> 0 AND page_id % 7 <> 0 THEN base64(encode(COALESCE(html, ''))) END AS content_base64
FROM pages""", views=False)
def _(t):
    images, stored = _stored_images(t)
    return files.with_content(images, stored).drop("storage_path")


@query("placed_image_files", "SRC-08", """
SELECT page_id AS image_id, CASE WHEN page_id % 7 <> 0 AND page_id % 9 <> 0 THEN sha256(COALESCE(html, '')) END AS sha256,
       CASE WHEN page_id % 7 <> 0 AND page_id % 9 <> 0 THEN octet_length(encode(COALESCE(html, ''))) END AS bytes_size,
       ROUND(LEAST(1.0, (page_id % 50) / 40.0::DOUBLE), 6) AS left_ratio, ROUND(GREATEST(1, 7) / 40.0::DOUBLE, 6) AS width_ratio, ROUND(LEAST(1.0, (page_id % 30) / 25.0::DOUBLE), 6) AS top_ratio
FROM pages WHERE page_id % 11 <> 0""", views=False)
def _(t):
    images, stored = _stored_images(t)
    key = F.col("image_id")
    placements = images.select("image_id", "storage_path", (key % 50).alias("left"), (key % 50 + 7).alias("right"), (key % 30).alias("top"), (key % 30 + 3).alias("bottom"),
                               F.when(key % 11 == 0, 0).otherwise(40).alias("canvas_width"), F.lit(25).alias("canvas_height"))
    return files.placed_images(placements, stored).select("image_id", "sha256", "bytes_size", "left_ratio", "width_ratio", "top_ratio")


# --- journals -----------------------------------------------------------------------------------

@query("export_journal", "SNK-10", """
SELECT event_id AS job_key, user_id AS document_id, event_type IN ('view', 'click') AS dry_run, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('view', 'click') THEN 'dry_run_ok' ELSE 'exported' END AS status,
       CAST(FLOOR(value) AS BIGINT) AS line_item_count, strftime(ts, '%Y-%m-%d') AS day FROM events""", views=False)
def _(t):
    """Half of the jobs, then all of them twice: every job stands in the journal once."""
    jobs, path = t.export_jobs.withColumnRenamed("job_id", "job_key"), shared_folder(t.spark, "journal")
    for part in (jobs.where("job_key % 2 = 0"), jobs, jobs):
        store.append_once(part, path, "job_key", "created_at")
    rows = t.spark.read.parquet(path)
    return rows.select("job_key", "document_id", "dry_run", "status", "line_item_count", F.col("day").cast("string").alias("day"))


@query("audit_journal", "SNK-11", """
SELECT event_id AS audit_key, 'user' || user_id AS actor_username, event_type AS action, '{"value":"' || CAST(CAST(value AS DECIMAL(14,2)) AS VARCHAR) || '"}' AS details_json FROM events""", views=False)
def _(t):
    details = F.create_map(F.lit("value"), F.col("value").cast("decimal(14,2)").cast("string"))
    events = t.read("events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor_username"), F.col("event_type").alias("action"),
        F.col("event_id").alias("document_id"), details.alias("details"), F.col("ts").alias("created_at"),
    )
    rows, path = store.audit_rows(events).withColumnRenamed("document_id", "audit_key"), shared_folder(t.spark, "audit")
    for _ in range(2):
        store.append_once(rows, path, "audit_key", "created_at")
    return t.spark.read.parquet(path).select("audit_key", "actor_username", "action", "details_json")


# --- results ------------------------------------------------------------------------------------

def _json_sql(cells: dict[str, str]) -> str:
    """SQL text of a JSON object; a value is a quoted text, or, behind "=", a bare one. Null cells are left out."""
    parts = []
    for name, value in cells.items():
        bare = value.startswith("=")
        value = value.removeprefix("=")
        shown = f"CAST({value} AS VARCHAR)" if bare else f"'\"' || CAST({value} AS VARCHAR) || '\"'"
        parts.append(f"CASE WHEN {value} IS NULL THEN '' ELSE ',\"{name}\":' || {shown} END")
    return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"


_RESULT_PARTS = {
    "relations": ("rel", "relation, related_id", {"related_id": "=related_id", "relation": "relation", "supplier_name": "supplier_name", "document_type": "document_type", "document_number": "document_number", "document_date": "document_date"}),
    "amount_lines": ("amount_lines", "sort_order", {"sort_order": "=sort_order", "line_type": "line_type", "label_raw": "label_raw", "percent": "CAST(percent AS DECIMAL(8,4))", "amount": "amount"}),
    "line_items": ("line_items", "item_seq", {"item_seq": "=item_seq", "position_no": "position_no", "lv_pos": "lv_pos", "is_alternative": "=is_alternative", "quantity": "quantity", "unit": "unit", "unit_price": "unit_price", "line_total": "line_total", "page_ref": "=page_ref"}),
    "images": ("images", "image_id", {"image_id": "=image_id", "page_ref": "=page_ref", "sha256": "sha256", "bytes_size": "=bytes_size", "storage_path": "storage_path"}),
    "validation": ("issues", "COALESCE(item_seq, -1), code, COALESCE(field, '')", {"item_seq": "=item_seq", "code": "code", "severity": "severity", "field": "field"}),
}
_RESULT_SQL = CHECKED_SQL + LINKS_SQL + """
, rel AS (
  SELECT l.document_id, 'linked_offer' AS relation, d.document_id AS related_id, d.supplier_name, d.document_type, d.document_number, d.document_date FROM links l JOIN docs d ON d.document_id = l.linked_offer_document_id
  UNION ALL SELECT l.linked_offer_document_id, 'linked_order_confirmation', d.document_id, d.supplier_name, d.document_type, d.document_number, d.document_date
  FROM links l JOIN docs d ON d.document_id = l.document_id WHERE l.linked_offer_document_id IS NOT NULL
), issues AS (
  SELECT document_id, CAST(NULL AS INTEGER) AS item_seq, code, severity, NULL AS field FROM field_issues UNION ALL SELECT document_id, NULL, code, severity, NULL FROM gross_issues
  UNION ALL SELECT document_id, item_seq, code, severity, NULL FROM item_issues
)""" + "".join(
    f"\n, part_{name} AS (SELECT document_id, '[' || string_agg({_json_sql(cells)}, ',' ORDER BY {order}) || ']' AS j FROM {source} GROUP BY document_id)"
    for name, (source, order, cells) in _RESULT_PARTS.items()
) + "\nSELECT docs.document_id, '{\"document\":' || " + _json_sql({
    "document_id": "=docs.document_id", "supplier_name": "supplier_name", "document_type": "document_type", "document_number": "document_number", "document_date": "document_date", "net_total": "net_total",
    "linked_offer_document_id": "=linked_offer_document_id", "offer_link_manual": "=is_manual",
}) + "".join(f" || COALESCE(',\"{name}\":' || part_{name}.j, '')" for name in _RESULT_PARTS) + " || '}' AS json\nFROM docs JOIN links ON links.document_id = docs.document_id" + "".join(
    f" LEFT JOIN part_{name} ON part_{name}.document_id = docs.document_id" for name in _RESULT_PARTS
)


@query("document_results", "LNK-12 SNK-01 LNK-05 VAL-01 VAL-03", _RESULT_SQL)
def _(t):
    shown = {name: list(cells) for name, (_, _, cells) in _RESULT_PARTS.items()}
    nameless = lambda issues: issues.withColumn("field", F.lit(None).cast("string"))
    odd = odd_documents(t)
    heads = nameless(validate.field_issues(odd)).unionByName(nameless(validate.gross_issues(odd)).select("document_id", "code", "severity", "field"))
    found = nameless(validate.item_issues(checked_items(t), validate.component_mode(t.documents, kept_amounts(t)), page_counts(t)))
    documents = t.documents.select("document_id", "supplier_name", "document_type", "document_number", "document_date", "net_total")
    rows = export.document_results(
        documents, resolved_links(t), t.amount_lines.select("document_id", *shown["amount_lines"]), t.line_items.select("document_id", *shown["line_items"]),
        t.images.select("document_id", *shown["images"]), heads.select("document_id", "code", "severity", "field"), found.select("document_id", "item_seq", "code", "severity", "field"),
    )
    return rows


# --- the document job over a mixed corpus ---------------------------------------------------------

_MIXED_SQL = "[" + ", ".join(f"{{'key': '{k}', 'name': '{SUPPLIER_NAMES[k]}', 'confirms': {str(k in CONFIRMING).lower()}}}" for k in MIXED) + "]"
MIXED_SQL = f"""
, mixed AS (
  SELECT d.document_id, ({_MIXED_SQL})[CAST(d.document_id % {len(MIXED)} AS INTEGER) + 1] AS e, '2' || lpad(CAST(d.document_id AS VARCHAR), 7, '0') AS number,
         (d.document_id // {len(MIXED)}) % 2 = 1 AS odd, '2' || lpad(CAST(d.document_id - {len(MIXED)} AS VARCHAR), 7, '0') AS before, CAST(d.document_date AS VARCHAR) AS day, d.net_total
  FROM docs d JOIN order_sums USING (document_id)
)"""


@query("mixed_corpus_documents", "STR-01 LI-21 DOC-01 DOC-03 DOC-05 DOC-08 DOC-11 DOC-12 FN-07 LNK-01 UDF-01 MUT-01", MIXED_SQL + f"""
, counted AS (SELECT document_id, COUNT(*) AS n FROM line_items GROUP BY document_id)
SELECT m.document_id, e.key AS template, e.name AS supplier_name, CASE WHEN e.confirms AND odd THEN 'auftragsbestaetigung' ELSE 'angebot' END AS document_type, number AS document_number, day AS document_date,
       'Haus ' || m.document_id AS project_ref, CASE WHEN e.confirms AND odd THEN before END AS offer_reference, CAST(m.net_total AS DOUBLE) AS net_total, n AS position_count, 0.99::DOUBLE AS parse_confidence,
       CASE WHEN e.confirms AND odd THEN CAST(o.document_id AS DOUBLE) END AS offer_id
FROM mixed m JOIN counted USING (document_id) LEFT JOIN order_sums o ON o.document_id = m.document_id - {len(MIXED)}""")
def _(t):
    """The inbox job in two batches: first the documents with an even id, then the others, the last of the first once more."""
    tables, texts = document_tables(t.spark, shared_folder(t.spark, "inbox")), rendered_mixed(t)
    again = F.col("document_id") % 10 == 0
    process_batch(texts.where("document_id % 2 = 0").withColumn("text", F.when(again, F.concat(F.lit("Angebot: alt\n"), "text")).otherwise(F.col("text"))), tables, batch=0)
    process_batch(texts.where((F.col("document_id") % 2 == 1) | again), tables, batch=1)
    rows = tables.table("documents").join(tables.table("links").select("document_id", "offer_id"), "document_id", "left")
    return rows.select(
        "document_id", "template", "supplier_name", "document_type", "document_number", F.col("document_date").cast("string").alias("document_date"), "project_ref", "offer_reference",
        "position_count", *[F.col(c).cast("double").alias(c) for c in ("net_total", "parse_confidence", "offer_id")],
    )


@query("mixed_corpus_items", "LI-21 UDF-01 LI-17", MIXED_SQL + """
SELECT i.document_id, e.key AS template, CAST(ROW_NUMBER() OVER (PARTITION BY i.document_id ORDER BY item_seq) AS INTEGER) AS item_seq, CAST(quantity AS DOUBLE) AS quantity, CAST(line_total AS DOUBLE) AS line_total, page_ref
FROM line_items i JOIN mixed USING (document_id)""")
def _(t):
    rows = items.typed_items(items.numbered(extract_items(stage_by_template(rendered_mixed(t)))))
    return rows.select("document_id", "template", "item_seq", F.col("quantity").cast("double").alias("quantity"), F.col("line_total").cast("double").alias("line_total"), "page_ref")


@query("mixed_corpus_texts", "FLT-07 FLT-11 FN-11 LI-02 LI-04 LI-06 LI-07 LI-08 LI-09 LI-14", MIXED_SQL + r"""
, c AS (SELECT i.*, e.key AS k, 'K' || part_key AS code, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS q, chr(10) AS nl,
    COALESCE(LEAD(page_ref) OVER (PARTITION BY i.document_id ORDER BY item_seq) <> page_ref, FALSE) AS last_of_page FROM line_items i JOIN mixed USING (document_id)
), money AS (SELECT *, replace(replace(replace(format('{:,.2f}', CAST(unit_price AS DOUBLE)), ',', '#'), '.', ','), '#', '.') AS u, replace(replace(replace(format('{:,.2f}', CAST(line_total AS DOUBLE)), ',', '#'), '.', ','), '#', '.') AS g FROM c)
SELECT document_id, k AS template, CAST(ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY item_seq) AS INTEGER) AS item_seq,
  CASE k WHEN 'muigg' THEN '01.02' WHEN 'koch' THEN 'Top 7' WHEN 'schachermayer' THEN 'Haus ' || document_id WHEN 'rekord_vomp' THEN 'F' || code WHEN 'schuchter' THEN 'EG: Bad' WHEN 'schlotterer' THEN 'W' || item_seq || 'a' END AS lv_pos,
  CASE WHEN k NOT IN ('schachermayer', 'sr_schauraum') THEN 1200.0::DOUBLE END AS height_mm, CASE WHEN k IN ('muigg', 'newo', 'schuchter') THEN TRUE WHEN k IN ('schachermayer', 'schlotterer') THEN FALSE END AS image_required,
  CASE k WHEN 'rieder' THEN CASE WHEN is_alternative THEN 'Alternativ für Pos. 1' || nl ELSE '' END || 'Fenster ' || code || ' Dreh' || nl || q || ' Stk' || nl || 'B/H: 900 x 1200' || nl || 'Uw 0,9'
    WHEN 'muigg' THEN 'LV-Pos: 01.02' || nl || 'Rahmen verzinkt'
    WHEN 'entholzer' THEN 'Aluclip ' || code || nl || 'Menge: ' || q || ' Stk. Element' || CASE WHEN is_alternative THEN nl || 'Alternativ zur Vorposition' ELSE '' END || nl || 'B/H: 900 x 1200'
    WHEN 'koch' THEN 'Objektposition: Top 7' WHEN 'schachermayer' THEN 'Solido ' || code || nl || 'weiß beschichtet' WHEN 'alu_one' THEN '900 mm x 1200 mm' || nl || 'Rahmen: pulverbeschichtet'
    WHEN 'newo' THEN 'NeWo Raffstore ' || code || ' weiß' || CASE WHEN is_alternative THEN nl || 'Alternativ' ELSE '' END || nl || 'Elementbreite: 900 mm, Elementhöhe: 1200 mm'
    WHEN 'sr_schauraum' THEN CASE WHEN is_alternative THEN 'OPTIONAL: Paket ' ELSE 'MODUL ' || item_seq || ' Paket ' END || code || nl || '- mit Einschulung' || nl || q || ' Stk ' || u || ' EUR ' || g || ' EUR'
    WHEN 'rekord_vomp' THEN 'Kunststoff ' || code || nl || 'RAM: 900 mm x 1200 mm' WHEN 'schuchter' THEN 'Fenster ' || code || '-flg' || nl || 'B/H: 900 x 1200' || CASE WHEN last_of_page THEN nl || 'Seite 2 von' ELSE '' END  -- this layout's text runs into the page head
    ELSE 'Breite: 900mm' || nl || 'Höhe: 1200mm' || nl || 'Funkmotor 10,00' END AS long_text
FROM money""")
def _(t):
    """Codes, sizes, flags and long texts of every layout; the totals behind the last position are cut off."""
    rows = items.typed_items(items.numbered(extract_items(stage_by_template(rendered_mixed(t)))))
    long_text = F.regexp_replace("description_long", r"(?s)\n(?:Gesamt Nettosumme|MwSt 20 %).*$", "")
    return rows.select("document_id", "template", "item_seq", "lv_pos", F.col("height_mm").cast("double").alias("height_mm"), "image_required", long_text.alias("long_text"))


@query("carried_components", "LI-12 LI-13", """
, r AS (SELECT document_id, item_seq, LEAD(page_ref) OVER (PARTITION BY document_id ORDER BY item_seq) <> page_ref AS last_of_page FROM line_items)
SELECT document_id, item_seq, 1 AS component_no, 'Funkmotor' AS label, 10.0::DOUBLE AS amount FROM r
UNION ALL SELECT document_id, item_seq, 2, 'Zusatzmotor', 7.5::DOUBLE FROM r WHERE last_of_page""")
def _(t):
    """Every page head carries a component of the position before the page end."""
    texts = rendered(t, "schlotterer").withColumn("text", F.replace("text", F.lit("\nSeite 2 von 3\n"), F.lit("\nSeite 2 von 3\nZusatzmotor 7,50\n")))
    # pairing changes no component
    rows = items.numbered(items.shaped_items(texts, REGISTRY.get("schlotterer")))
    return items.component_rows(rows).withColumn("amount", F.col("amount").cast("double"))


@query("folded_field_values", "STR-02 MUT-02", """
, newest AS (SELECT document_id, line_item_id, sub_key, field, arg_max(value, ts) AS value, MAX(ts) AS changed_at FROM change_log GROUP BY ALL)
SELECT document_id, line_item_id, sub_key, field, value, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS ts FROM newest""")
def _(t):
    """The log in three batches, its oldest third last, and one batch twice."""
    tables, log = TableSet(t.spark, shared_folder(t.spark, "changes")), t.change_log
    third = F.pmod(F.xxhash64("ts", "document_id"), F.lit(3))
    for batch, part in enumerate((2, 1, 0)):
        for _ in range(1 + batch % 2):
            fold_batch(log.where(third == part), tables, batch=batch)
    return tables.table("field_values").drop("actor").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
