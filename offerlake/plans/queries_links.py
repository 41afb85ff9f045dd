"""Queries: links, lookups, packages and the export journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.functions.keys import (
    collapsed_lookup_key, external_document_id, external_line_item_id, position_numbers, reference_key, unit_key,
)
from offerlake.operators import links, package
from offerlake.operators.headers import provider_key
from offerlake.plans.catalog import query
from offerlake.plans.queries_pricing import PROVIDER_SQL
from offerlake.plans.views import Tables
from offerlake.sources import lookups

KEY_SQL = "NULLIF(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"

LINKS_SQL = f"""
, conf AS (
  SELECT document_id, supplier_name, {KEY_SQL.format('offer_reference')} AS key FROM docs WHERE document_type = 'auftragsbestaetigung'
), offers AS (
  SELECT document_id, supplier_name, document_date, approval_status, {KEY_SQL.format('document_number')} AS key FROM docs WHERE document_type = 'angebot'
), link_rows AS (
  SELECT c.document_id, o.document_id AS offer_id,
         ROW_NUMBER() OVER (PARTITION BY c.document_id ORDER BY o.document_date DESC NULLS LAST, o.document_id DESC) AS rn
  FROM conf c JOIN offers o ON o.key = c.key AND (c.supplier_name IS NULL OR o.supplier_name = c.supplier_name)
), auto_conf AS (
  SELECT c.document_id, offer_id FROM conf c LEFT JOIN (SELECT * FROM link_rows WHERE rn = 1) l USING (document_id)
), prev_rows AS (
  SELECT a.document_id, b.document_id AS offer_id,
         ROW_NUMBER() OVER (PARTITION BY a.document_id ORDER BY b.document_date NULLS LAST, b.document_id) AS rn
  FROM offers a JOIN offers b ON a.key = b.key AND a.document_id <> b.document_id AND b.approval_status = 'approved'
), auto_prev AS (
  SELECT a.document_id, offer_id FROM offers a LEFT JOIN (SELECT * FROM prev_rows WHERE rn = 1) p USING (document_id)
), auto_links AS (SELECT * FROM auto_conf UNION ALL SELECT * FROM auto_prev
), links AS (
  SELECT d.document_id, CASE WHEN offer_link_manual THEN manual_offer_id ELSE offer_id END AS linked_offer_document_id, offer_link_manual AS is_manual
  FROM docs d LEFT JOIN auto_links USING (document_id)
)"""


@query("confirmation_links", "LNK-01 FN-13", LINKS_SQL + " SELECT document_id, CAST(offer_id AS DOUBLE) AS offer_id FROM auto_conf")
def _(t):
    return links.confirmation_links(t.documents).select("document_id", F.col("offer_id").cast("double").alias("offer_id"))


@query("predecessor_links", "LNK-02", LINKS_SQL + " SELECT document_id, CAST(offer_id AS DOUBLE) AS offer_id FROM auto_prev")
def _(t):
    return links.predecessor_links(t.documents).select("document_id", F.col("offer_id").cast("double").alias("offer_id"))


@query("links_in_arrival_order", "LNK-03", LINKS_SQL + """
, seqd AS (SELECT o_orderkey AS document_id, (o_orderkey * 7919) % 1000003 AS seq FROM orders
), late AS (
  SELECT c.document_id, arg_max(o.document_id, so.seq) AS offer_id
  FROM conf c JOIN seqd sc ON sc.document_id = c.document_id
  JOIN offers o ON o.key = c.key AND (o.supplier_name IS NULL OR o.supplier_name = c.supplier_name)
  JOIN seqd so ON so.document_id = o.document_id WHERE so.seq > sc.seq GROUP BY c.document_id
)
SELECT a.document_id, CAST(COALESCE(l.offer_id, a.offer_id) AS DOUBLE) AS offer_id FROM auto_conf a LEFT JOIN late l USING (document_id)""")
def _(t):
    documents = t.documents.withColumn("processed_seq", F.col("document_id") * 7919 % 1000003)
    return links.confirmation_links(documents, arrival_order=True).select(
        "document_id", F.col("offer_id").cast("double").alias("offer_id")
    )


def resolved_links(t: Tables) -> DataFrame:
    automatic = links.confirmation_links(t.documents).unionByName(links.predecessor_links(t.documents))
    return links.resolve_links(t.documents, automatic)


@query("resolved_links", "LNK-04", LINKS_SQL + """
SELECT document_id, CAST(linked_offer_document_id AS DOUBLE) AS linked_offer_document_id, is_manual FROM links""")
def _(t):
    return resolved_links(t).withColumn("linked_offer_document_id", F.col("linked_offer_document_id").cast("double"))


@query("manual_link_checks", "LNK-04", """
, dec AS (
  SELECT document_id, CASE WHEN document_id % 9 = 0 THEN NULL WHEN document_id % 8 = 0 THEN document_id WHEN document_id % 50 = 7 THEN -1 ELSE document_id + 3 END AS linked_id FROM docs
)
SELECT * FROM (
  SELECT d.document_id, CAST(d.linked_id AS DOUBLE) AS linked_id, r.reason IS NULL AS accepted, r.reason
  FROM dec d JOIN docs a ON a.document_id = d.document_id LEFT JOIN docs b ON b.document_id = d.linked_id,
  LATERAL (SELECT CASE WHEN d.linked_id IS NULL THEN NULL WHEN d.linked_id = d.document_id THEN 'self_link' WHEN b.document_id IS NULL THEN 'not_found'
    WHEN b.document_type <> 'angebot' THEN 'not_an_offer'
    WHEN a.document_type = 'auftragsbestaetigung' AND a.supplier_name IS NOT NULL AND b.supplier_name IS NOT NULL AND a.supplier_name <> b.supplier_name THEN 'other_supplier' END AS reason) r
)""")
def _(t):
    key = F.col("document_id")
    linked = F.when(key % 9 == 0, None).when(key % 8 == 0, key).when(key % 50 == 7, F.lit(-1)).otherwise(key + 3)
    decisions = t.documents.select("document_id", linked.cast("long").alias("linked_id"))
    return links.check_manual_links(decisions, t.documents).withColumn("linked_id", F.col("linked_id").cast("double"))


@query("document_relations", "LNK-05", LINKS_SQL + """
SELECT l.document_id, 'linked_offer' AS relation, d.document_id AS related_id, d.supplier_name, d.document_type, d.document_number, CAST(d.document_date AS VARCHAR) AS document_date
FROM links l JOIN docs d ON d.document_id = l.linked_offer_document_id
UNION ALL
SELECT l.linked_offer_document_id, 'linked_order_confirmation', d.document_id, d.supplier_name, d.document_type, d.document_number, CAST(d.document_date AS VARCHAR)
FROM links l JOIN docs d ON d.document_id = l.document_id WHERE l.linked_offer_document_id IS NOT NULL""")
def _(t):
    return links.relations(t.documents, resolved_links(t)).withColumn("document_date", F.col("document_date").cast("string"))


@query("offer_candidates", "LNK-06", """
SELECT supplier_name, document_id, document_number, CAST(document_date AS VARCHAR) AS document_date, project_ref, status, approval_status
FROM docs WHERE document_type = 'angebot'""")
def _(t):
    return links.offer_candidates(t.documents).withColumn("document_date", F.col("document_date").cast("string"))


@query("offer_candidate_counts", "LNK-06", """
SELECT document_id, CASE WHEN supplier_name IS NULL THEN 0 ELSE
         (SELECT COUNT(*) FROM docs o WHERE o.document_type = 'angebot' AND o.supplier_name = d.supplier_name) - CASE WHEN document_type = 'angebot' THEN 1 ELSE 0 END END AS offer_candidates,
       (SELECT COUNT(*) FROM docs o WHERE o.document_type = 'angebot') - CASE WHEN document_type = 'angebot' THEN 1 ELSE 0 END AS predecessor_candidates
FROM docs d""")
def _(t):
    return links.candidate_counts(t.documents)


_ALIASES = "(VALUES " + ", ".join(f"({i}, '{a}', '{s}')" for i, (a, s) in enumerate(links.SUPPLIER_IDS)) + ") AS aliases(pos, alias, id)"


@query("supplier_ids", "LNK-07 FN-14 DOC-02", PROVIDER_SQL + f"""
, named AS (
  SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'Fa. ' || supplier_name || ' & Co' ELSE supplier_name END AS name FROM docs
), keyed AS (
  SELECT document_id, regexp_replace(trim(regexp_replace(replace(lower(name), '&', ' '), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')), ' +', ' ', 'g') AS key FROM named
)
SELECT k.document_id, COALESCE((SELECT arg_max(id, pos) FROM {_ALIASES} WHERE alias = k.key),
                             (SELECT arg_min(id, pos) FROM {_ALIASES} WHERE contains(k.key, alias))) AS supplier_id, key AS lookup_key
FROM keyed k""")
def _(t):
    odd = F.col("document_id") % 3 == 0
    name = F.when(odd, F.concat(F.lit("Fa. "), F.col("supplier_name"), F.lit(" & Co"))).otherwise(F.col("supplier_name"))
    key = F.when(name.isNotNull(), collapsed_lookup_key(name))
    return t.documents.select("document_id", links.supplier_id(name).alias("supplier_id"), key.alias("lookup_key"))


@query("provider_keys", "DOC-02", PROVIDER_SQL + " SELECT document_id, provider_key FROM providers")
def _(t):
    return t.documents.select("document_id", provider_key(F.col("supplier_name")).alias("provider_key"))


@query("import_state", "LNK-10", """
SELECT document_id, BOOL_OR(NOT dry_run AND status = 'exported') AS already_imported,
       strftime(MAX(created_at) FILTER (NOT dry_run AND status = 'exported'), '%Y-%m-%d %H:%M:%S') AS latest_imported_at
FROM export_jobs GROUP BY document_id""")
def _(t):
    out = links.import_state(t.export_jobs)
    return out.withColumn("latest_imported_at", F.date_format("latest_imported_at", "yyyy-MM-dd HH:mm:ss"))


@query("latest_export_job", "LNK-11", """
SELECT document_id, MAX(job_id) AS job_id, arg_max(status, job_id) AS status, arg_max(dry_run, job_id) AS dry_run FROM export_jobs GROUP BY document_id""")
def _(t):
    return links.latest_job(t.export_jobs).select("document_id", "job_id", "status", "dry_run")


@query("recent_export_jobs", "LNK-11", """
SELECT * FROM (SELECT document_id, job_id, status, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY job_id DESC) AS place FROM export_jobs) WHERE place <= 20""")
def _(t):
    return links.recent_jobs(t.export_jobs).select("document_id", "job_id", "status", F.col("place").cast("long").alias("place"))


@query("document_list", "LNK-11", """
SELECT document_id, document_number, status FROM docs ORDER BY document_id DESC LIMIT 20""")
def _(t):
    return links.document_list(t.documents).select("document_id", "document_number", "status")


@query("customer_lookup", "SRC-04", """
SELECT CAST(c_custkey AS VARCHAR) AS contact_oid, c_acctbal < 0 AS inactive, CAST(c_custkey AS VARCHAR) AS customer_number, c_name AS display_name FROM customer""", views=False)
def _(t):
    customers = t.read("customer").select(
        F.col("c_custkey").alias("contact_oid"), (F.col("c_acctbal") < 0).alias("inactive"), F.lit("").alias("uid_number"),
        F.col("c_custkey").cast("string").alias("customer_number"), F.col("c_name").alias("display_name"),
    )
    return lookups.customer_options(customers).drop("uid_number")


@query("order_lookup", "SRC-05", """
SELECT 'Auftrag ' || o_orderkey AS name FROM orders WHERE o_orderkey % 5 <> 0""", views=False)
def _(t):
    key = F.col("o_orderkey")
    named = F.when(key % 5 != 0, F.concat(F.lit(" Auftrag "), key.cast("string")))
    return lookups.order_options(t.read("orders").select(named.alias("name")))


PACKAGE_SQL = """
, pdocs AS (
  SELECT document_id, document_id // 4 AS package_id, CASE WHEN document_id % 20 = 1 OR (document_id % 4 = 0 AND document_id % 28 <> 0) THEN document_type ELSE 'detailzeichnung' END AS document_type,
         project_ref FROM docs
), cand AS (
  SELECT package_id, document_id FROM pdocs p WHERE document_type <> 'detailzeichnung' AND EXISTS (SELECT 1 FROM positions i WHERE i.document_id = p.document_id)
), mains AS (
  SELECT package_id, COUNT(c.document_id) AS n, MAX(c.document_id) AS candidate FROM (SELECT DISTINCT package_id FROM pdocs) LEFT JOIN cand c USING (package_id) GROUP BY package_id
), drawings AS (
  SELECT candidate AS main_document_id, i.image_id, i.page_ref, i.image_index, p.document_id,
         CASE WHEN i.width % 100 = 0 THEN 0 WHEN i.width % 60 = 0 THEN 1 ELSE 2 END AS priority,
         unnest(list_distinct([CAST(i.image_index AS VARCHAR), CAST(i.width % 3 + 1 AS VARCHAR)])) AS position_no
  FROM mains JOIN pdocs p USING (package_id) JOIN images i ON i.document_id = p.document_id WHERE n = 1 AND p.document_id <> candidate
)"""


def _package(t: Tables):
    key = F.col("document_id")
    keeps = (key % 20 == 1) | ((key % 4 == 0) & (key % 28 != 0))
    documents = t.documents.withColumn("document_type", F.when(keeps, F.col("document_type")).otherwise("detailzeichnung"))
    members = documents.select("document_id", F.floor(key / 4).alias("package_id"))
    mains = package.main_documents(members, documents, t.positions)
    width = F.col("width")
    images = t.images.select(
        "document_id", "image_id", "page_ref", "image_index",
        position_numbers(F.concat_ws(", ", F.col("image_index").cast("string"), (width % 3 + 1).cast("string"))).alias("source_position_numbers"),
        F.when(width % 100 == 0, "Visualisierung aussen").when(width % 60 == 0, "SYSTEM 80").otherwise("Schnitt").alias("source_detail_type"),
    )
    return mains, package.position_drawings(members, mains, documents, images)


@query("package_main_documents", "LNK-08", PACKAGE_SQL + """
SELECT package_id, CAST(CASE WHEN n = 1 THEN candidate END AS DOUBLE) AS main_document_id,
       CASE WHEN n = 0 THEN 'no_main_document' WHEN n > 1 THEN 'several_main_documents' END AS error FROM mains""")
def _(t):
    mains, _ = _package(t)
    return mains.withColumn("main_document_id", F.col("main_document_id").cast("double"))


@query("package_drawings", "LNK-09 FN-22", PACKAGE_SQL + """
, best AS (
  SELECT main_document_id, position_no, arg_min(image_id, (priority, page_ref, image_index, document_id, image_id)) AS image_id, COUNT(DISTINCT image_id) AS candidate_count
  FROM drawings GROUP BY ALL
)
SELECT p.document_id AS main_document_id, p.item_seq, CAST(p.item_seq AS VARCHAR) AS position_no, CAST(image_id AS DOUBLE) AS image_id, CAST(candidate_count AS DOUBLE) AS candidate_count
FROM positions p LEFT JOIN best b ON b.main_document_id = p.document_id AND b.position_no = CAST(p.item_seq AS VARCHAR)
WHERE p.document_id IN (SELECT main_document_id FROM drawings)""")
def _(t):
    _, drawings = _package(t)
    out = package.package_assignments(drawings, t.line_items)
    return out.withColumns({c: F.col(c).cast("double") for c in ("image_id", "candidate_count")})


@query("package_missing_positions", "LNK-09", PACKAGE_SQL + """
SELECT p.document_id AS main_document_id, CAST(p.item_seq AS VARCHAR) AS position_no FROM positions p
WHERE p.document_id IN (SELECT main_document_id FROM drawings)
  AND NOT EXISTS (SELECT 1 FROM drawings d WHERE d.main_document_id = p.document_id AND d.position_no = CAST(p.item_seq AS VARCHAR))""")
def _(t):
    _, drawings = _package(t)
    return package.missing_positions(drawings, t.line_items)


@query("reference_keys", "FN-13 FN-15", f"""
SELECT document_id, item_seq, {KEY_SQL.format("'angebot: ' || unit || ' ' || position_no")} AS reference_key,
       CASE unit WHEN 'lfm' THEN 'lfm' ELSE 'piece' END AS unit_key
FROM line_items""")
def _(t):
    return t.line_items.select(
        "document_id", "item_seq", reference_key(F.concat(F.lit("angebot: "), "unit", F.lit(" "), "position_no")).alias("reference_key"),
        unit_key(F.col("unit")).alias("unit_key"),
    )


HEX_SQL = "sha1(CAST(unhex('8f0f8c500f5845d8b8e583a0f7e79a11') AS BLOB) || encode({0}))"


UUID_SQL = (
    "(substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || translate(substr({0}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({0}, 18, 3) || '-' || substr({0}, 21, 12))"
)


@query("external_ids", "FN-17", """
, named AS (SELECT document_id, item_seq, 'document:' || document_id AS doc_name, 'document:' || document_id || ':line-item:' || line_item_id AS item_name FROM line_items
), hashed AS (
  SELECT document_id, item_seq, """ + HEX_SQL.format("doc_name") + " AS a, " + HEX_SQL.format("item_name") + """ AS b FROM named
)
SELECT document_id, item_seq,
  """ + UUID_SQL.format("a") + " AS external_document_id, " + UUID_SQL.format("b") + """ AS external_line_item_id
FROM hashed""")
def _(t):
    return t.line_items.select(
        "document_id", "item_seq", external_document_id(F.col("document_id")).alias("external_document_id"),
        external_line_item_id(F.col("document_id"), F.col("line_item_id").cast("string")).alias("external_line_item_id"),
    )
