"""Queries: validation rules, roll-ups and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.operators import validate as V
from offerlake.plans.catalog import query
from offerlake.plans.queries_pricing import PROVIDER_SQL
from offerlake.plans.views import Tables


def checked_items(t: Tables) -> DataFrame:
    """Positions with gaps and faults, image ids and review marks."""
    part = F.col("part_key")

    def gone(every: int, name: str):
        return F.when(part % every != 0, F.col(name)).alias(name)

    first_image = (F.col("document_id") * 100 + 1).cast("long")
    return t.described_items.select(
        "document_id", "item_seq", "line_item_id", "is_alternative", "part_key", "description_long",
        gone(89, "position_no"),
        F.when(part % 11 == 0, "umfang").when(part % 12 == 0, "system").otherwise(F.col("lv_pos")).alias("lv_pos"),
        F.when(part % 71 == 0, None).when(part % 73 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("decimal(14,4)").alias("quantity"),
        gone(59, "unit_price"),
        F.when(part % 61 == 0, None).when(part % 67 == 0, F.lit(0)).otherwise(F.col("line_total")).cast("decimal(14,2)").alias("line_total"),
        F.when(part % 79 == 0, None).when(part % 83 == 0, F.lit(99)).otherwise(F.col("page_ref")).cast("int").alias("page_ref"),
        F.when(part % 47 == 0, None).when(part % 13 == 0, "Info Montage").when(part % 17 == 0, "AZ - Griff")
        .when(part % 19 == 0, "Auftragsinfo").otherwise(F.col("description_short")).alias("description_short"),
        F.when(part % 5 == 0, F.array().cast("array<bigint>"))
        .when(part % 37 == 0, F.array(first_image)).otherwise(F.array(F.col("line_item_id"))).alias("image_ids"),
        (part % 14 != 0).alias("image_auto_match_allowed"),
        F.when(part % 10 == 0, "document_package").alias("image_assignment_source"),
        (part % 6 == 0).alias("review_checked"),
        F.when(part % 29 == 0, "delivery_block").alias("pricing_source"),
        F.when(part % 58 == 0, F.col("line_total")).alias("printed_total"),
        (part % 31 == 0).alias("pricing_applied"),
        (part % 62 == 0).alias("pricing_disabled"),
    )


CHECKED_SQL = PROVIDER_SQL + """
, checked AS (
  SELECT document_id, item_seq, line_item_id, is_alternative, part_key, description_long,
         CASE WHEN part_key % 89 <> 0 THEN position_no END AS position_no,
         CASE WHEN part_key % 11 = 0 THEN 'umfang' WHEN part_key % 12 = 0 THEN 'system' ELSE lv_pos END AS lv_pos,
         CASE WHEN part_key % 71 = 0 THEN NULL WHEN part_key % 73 = 0 THEN 0 ELSE quantity END AS quantity,
         CASE WHEN part_key % 59 <> 0 THEN unit_price END AS unit_price,
         CASE WHEN part_key % 61 = 0 THEN NULL WHEN part_key % 67 = 0 THEN 0 ELSE line_total END AS line_total,
         CASE WHEN part_key % 79 = 0 THEN NULL WHEN part_key % 83 = 0 THEN 99 ELSE page_ref END AS page_ref,
         CASE WHEN part_key % 47 = 0 THEN NULL WHEN part_key % 13 = 0 THEN 'Info Montage' WHEN part_key % 17 = 0 THEN 'AZ - Griff'
              WHEN part_key % 19 = 0 THEN 'Auftragsinfo' ELSE description_short END AS description_short,
         CASE WHEN part_key % 5 = 0 THEN NULL WHEN part_key % 37 = 0 THEN document_id * 100 + 1 ELSE line_item_id END AS image_id,
         part_key % 14 <> 0 AS allowed, part_key % 10 = 0 AS package, part_key % 6 = 0 AS review_checked,
         part_key % 29 = 0 AS block, CASE WHEN part_key % 58 = 0 THEN line_total END AS printed_total,
         part_key % 31 = 0 AS pricing_applied, part_key % 62 = 0 AS pricing_disabled
  FROM described_items
), flagged AS (
  SELECT c.*, provider_key,
    CASE provider_key
      WHEN 'alu_one' THEN COALESCE(lower(description_short) = 'vorbemerkungen' OR lower(description_short) LIKE 'info %', FALSE)
      WHEN 'entholzer' THEN COALESCE(lv_pos, '') = 'system' AND unit_price IS NULL AND line_total IS NULL
      WHEN 'rekord_vomp' THEN COALESCE(lv_pos, '') = 'umfang'
      WHEN 'schlotterer' THEN COALESCE(lower(description_short), '') = 'auftragsinfo'
      ELSE FALSE END AS info,
    COALESCE(lower(description_short) IN ('lieferung') OR lower(description_short) LIKE 'vorbemerk%'
      OR lower(description_short) LIKE 'az - %', FALSE) OR COALESCE(lv_pos = 'umfang', FALSE) AS non_visual
  FROM checked c JOIN providers USING (document_id)
), modes AS (
  SELECT document_id, provider_key,
    CASE WHEN provider_key IN ('entholzer', 'rekord_vomp', 'rieder', 'schlotterer', 'schuchter') THEN 'provider_complex_pricing'
         WHEN EXISTS (SELECT 1 FROM kept_amounts a WHERE a.document_id = p.document_id AND line_type IN ('discount', 'surcharge'))
           OR (SELECT COUNT(*) FROM kept_amounts a WHERE a.document_id = p.document_id AND line_type = 'subtotal') > 1
         THEN 'complex_pricing_breakdown' END AS reason
  FROM providers p
), item_issues AS (
  SELECT document_id, item_seq, 'missing_position_no' AS code, 'error' AS severity FROM flagged WHERE position_no IS NULL
  UNION ALL SELECT document_id, item_seq, 'missing_quantity', 'warning' FROM flagged WHERE quantity IS NULL
  UNION ALL SELECT document_id, item_seq, 'non_positive_quantity', 'warning' FROM flagged WHERE quantity <= 0 AND NOT is_alternative AND NOT info
  UNION ALL SELECT document_id, item_seq, 'missing_unit_price', 'warning' FROM flagged WHERE unit_price IS NULL AND NOT info
  UNION ALL SELECT document_id, item_seq, 'missing_line_total', 'error' FROM flagged WHERE line_total IS NULL AND NOT is_alternative AND NOT info
  UNION ALL SELECT document_id, item_seq, 'zero_line_total', 'warning' FROM flagged WHERE line_total = 0 AND NOT is_alternative AND NOT info
  UNION ALL SELECT document_id, item_seq, 'missing_page_ref', 'warning' FROM flagged WHERE page_ref IS NULL
  UNION ALL SELECT document_id, item_seq, 'invalid_page_ref', 'error' FROM flagged WHERE page_ref < 1 OR page_ref > 3
  UNION ALL SELECT f.document_id, item_seq, 'line_total_mismatch', 'warning' FROM flagged f JOIN modes m USING (document_id)
    WHERE reason IS NULL AND NOT info AND f.provider_key <> 'schachermayer' AND ABS(line_total - ROUND(quantity * unit_price, 2)) > 0.02
), image_issues AS (
  SELECT document_id, item_seq, 'missing_image_assignment' AS code, 'warning' AS severity
  FROM flagged WHERE NOT non_visual AND NOT info AND allowed AND image_id IS NULL
  UNION ALL
  SELECT f.document_id, f.item_seq, 'image_before_item_page', 'warning' FROM flagged f JOIN images i ON i.image_id = f.image_id AND i.document_id = f.document_id
  WHERE NOT package AND i.page_ref < f.page_ref
), doubled AS (
  SELECT document_id, image_id FROM flagged WHERE position_no IS NOT NULL AND image_id IS NOT NULL
  GROUP BY document_id, image_id HAVING COUNT(DISTINCT position_no) > 1
), all_item_issues AS (
  SELECT * FROM item_issues UNION ALL SELECT * FROM image_issues
  UNION ALL SELECT DISTINCT document_id, item_seq, 'duplicate_image_assignment', 'error' FROM flagged JOIN doubled USING (document_id, image_id)
), resolved_issues AS (
  SELECT a.*, review_checked AND severity = 'warning' AS resolved FROM all_item_issues a JOIN checked USING (document_id, item_seq)
), odd_docs AS (
  SELECT document_id, CASE WHEN document_id % 31 = 0 THEN NULL ELSE supplier_name END AS supplier_name,
         CASE WHEN document_id % 37 = 0 THEN 'rechnung' ELSE document_type END AS document_type,
         CASE WHEN document_id % 41 = 0 THEN ' ' ELSE document_number END AS document_number, offer_reference, document_date,
         customer_name, project_ref, net_total,
         CASE WHEN document_id % 3 = 0 AND supplier_name = 'Koch Türen GmbH' THEN NULL ELSE vat_total END AS vat_total,
         CASE WHEN document_id % 3 = 0 AND supplier_name = 'Koch Türen GmbH' THEN NULL ELSE gross_total END AS gross_total
  FROM docs
), odd_flags AS (
  SELECT *, COALESCE(supplier_name = 'Koch Türen GmbH' AND document_type = 'angebot' AND net_total IS NOT NULL AND vat_total IS NULL AND gross_total IS NULL, FALSE) AS net_only
  FROM odd_docs
), field_issues AS (
  SELECT document_id, 'invalid_document_type' AS code, 'error' AS severity FROM odd_flags WHERE document_type = 'rechnung'
  UNION ALL SELECT document_id, 'missing_document_type', 'error' FROM odd_flags WHERE document_type = 'rechnung'
  UNION ALL SELECT document_id, 'missing_supplier_name', 'error' FROM odd_flags WHERE supplier_name IS NULL
  UNION ALL SELECT document_id, 'missing_document_number', 'error' FROM odd_flags WHERE trim(document_number) = ''
  UNION ALL SELECT document_id, 'missing_gross_total', 'error' FROM odd_flags WHERE NOT net_only AND gross_total IS NULL
  UNION ALL SELECT document_id, 'missing_customer', 'warning' FROM odd_flags WHERE customer_name IS NULL
  UNION ALL SELECT document_id, 'missing_project_ref', 'warning' FROM odd_flags WHERE project_ref IS NULL
  UNION ALL SELECT document_id, 'missing_net_total', 'warning' FROM odd_flags WHERE net_total IS NULL
  UNION ALL SELECT document_id, 'missing_vat_total', 'warning' FROM odd_flags WHERE NOT net_only AND vat_total IS NULL
), gross_issues AS (
  SELECT document_id, 'gross_mismatch' AS code, 'error' AS severity FROM odd_docs WHERE ABS(gross_total - (net_total + vat_total)) > 0.02
)"""

KEPT_AMOUNTS_SQL = """
, kept_amounts AS (
  SELECT * REPLACE (CASE WHEN document_id % 2 = 0 OR line_type IN ('net_total', 'vat', 'total') OR sort_order = 0 THEN line_type ELSE 'note' END AS line_type,
                    CASE WHEN document_id % 2 = 0 OR line_type IN ('net_total', 'vat', 'total') OR sort_order = 0 THEN label_raw ELSE 'Hinweis' END AS label_raw) FROM amount_lines
)"""
CHECKED_SQL = KEPT_AMOUNTS_SQL + CHECKED_SQL


def kept_amounts(t: Tables) -> DataFrame:
    """Odd orders print their conditions as mere notes, so their positions must add up strictly."""
    condition = (F.col("document_id") % 2 == 0) | F.col("line_type").isin("net_total", "vat", "total") | (F.col("sort_order") == 0)
    return t.amount_lines.withColumns({
        "line_type": F.when(condition, F.col("line_type")).otherwise("note"), "label_raw": F.when(condition, F.col("label_raw")).otherwise("Hinweis"),
    })


def odd_documents(t: Tables) -> DataFrame:
    key = F.col("document_id")
    bare = (key % 3 == 0) & F.coalesce(F.col("supplier_name") == "Koch Türen GmbH", F.lit(False))
    return t.documents.withColumns({
        "supplier_name": F.when(key % 31 != 0, F.col("supplier_name")),
        "document_type": F.when(key % 37 == 0, "rechnung").otherwise(F.col("document_type")),
        "document_number": F.when(key % 41 == 0, " ").otherwise(F.col("document_number")),
        "vat_total": F.when(~bare, F.col("vat_total")),
        "gross_total": F.when(~bare, F.col("gross_total")),
    })


def page_counts(t: Tables) -> DataFrame:
    return t.order_sums.select("document_id", F.lit(3).alias("page_count"))


@query("required_field_issues", "VAL-01", CHECKED_SQL + " SELECT document_id, code, severity FROM field_issues")
def _(t):
    return V.field_issues(odd_documents(t)).drop("field")


@query("gross_total_check", "VAL-02", CHECKED_SQL + """
SELECT document_id, CAST(net_total + vat_total AS DOUBLE) AS expected_gross, CAST(gross_total - (net_total + vat_total) AS DOUBLE) AS gross_delta,
       CASE WHEN net_total IS NOT NULL AND vat_total IS NOT NULL AND gross_total IS NOT NULL
            THEN CAST(ABS(gross_total - (net_total + vat_total)) <= 0.02 AS VARCHAR) END AS gross_matches
FROM odd_docs""")
def _(t):
    return V.totals_check(odd_documents(t)).select(
        "document_id", F.col("expected_gross").cast("double").alias("expected_gross"),
        F.col("gross_delta").cast("double").alias("gross_delta"), F.col("gross_matches").cast("string").alias("gross_matches"),
    )


def _modes(t: Tables) -> DataFrame:
    return V.component_mode(t.documents, kept_amounts(t))


@query("component_check_modes", "VAL-04", CHECKED_SQL + """
SELECT document_id, provider_key, CASE WHEN reason IS NULL THEN 'strict' ELSE 'heuristic' END AS mode, reason FROM modes""")
def _(t):
    return _modes(t)


@query("item_rule_issues", "VAL-03 FLT-09", CHECKED_SQL + " SELECT document_id, item_seq, code, severity FROM item_issues")
def _(t):
    return V.item_issues(checked_items(t), _modes(t), page_counts(t)).drop("field")


@query("item_flags", "FLT-08 FLT-09 FLT-10 FN-27", CHECKED_SQL + """
SELECT document_id, item_seq, non_visual, info, CASE provider_key WHEN 'sr_schauraum' THEN TRUE ELSE
       CASE WHEN provider_key = 'alu_one' AND COALESCE(lower(description_short) LIKE 'az - %', FALSE) THEN FALSE
            WHEN info THEN FALSE ELSE NOT is_alternative END END AS counted
FROM flagged""")
def _(t):
    items = checked_items(t)
    provider = F.col("provider_key")
    return items.join(_modes(t).select("document_id", "provider_key"), "document_id").select(
        "document_id", "item_seq", V.is_non_visual(items).alias("non_visual"),
        V.is_informational(provider).alias("info"), V.counts_in_sum(provider).alias("counted"),
    )


@query("image_rule_issues", "VAL-09", CHECKED_SQL + " SELECT document_id, item_seq, code, severity FROM image_issues")
def _(t):
    return V.image_issues(checked_items(t), t.images, _modes(t)).drop("field")


@query("duplicate_image_issues", "VAL-08", CHECKED_SQL + """
SELECT document_id, item_seq, 'duplicate_image_assignment' AS code FROM (SELECT DISTINCT document_id, item_seq FROM flagged JOIN doubled USING (document_id, image_id))
UNION ALL SELECT DISTINCT document_id, 0, 'duplicate_image_assignments' FROM doubled""")
def _(t):
    per_document, per_item = V.duplicate_image_issues(checked_items(t))
    return per_item.select("document_id", "item_seq", "code").unionByName(
        per_document.select("document_id", F.lit(0).alias("item_seq"), "code")
    )


@query("missing_drawings", "VAL-09", CHECKED_SQL + """
SELECT document_id, 'koch_detail_drawings_missing' AS code FROM docs d
WHERE supplier_name = 'Koch Türen GmbH' AND EXISTS (SELECT 1 FROM line_items i WHERE i.document_id = d.document_id)
  AND NOT EXISTS (SELECT 1 FROM images i WHERE i.document_id = d.document_id AND page_ref > 1)""")
def _(t):
    # drawings of page one belong to no document
    images = t.images.withColumn("document_id", F.when(F.col("page_ref") > 1, F.col("document_id")))
    return V.missing_drawings(t.documents, t.line_items, images).select("document_id", "code")


SUMS_SQL = """
, seq AS (
  -- subtotal, discount, subtotal, surcharge, subtotal: every step restarts at the printed subtotal
  SELECT k.document_id, MAX(CASE WHEN sort_order = 0 THEN amount END) AS s0, MAX(CASE WHEN sort_order = 1 THEN amount END) AS a1,
         MAX(CASE WHEN sort_order = 1 THEN percent END) AS p1, MAX(CASE WHEN sort_order = 2 THEN amount END) AS s1,
         MAX(CASE WHEN sort_order = 3 THEN amount END) AS a2, MAX(CASE WHEN sort_order = 3 THEN percent END) AS p2,
         MAX(CASE WHEN sort_order = 4 THEN amount END) AS s2
  FROM shifted k WHERE line_type <> 'note' GROUP BY k.document_id
), expected AS (
  SELECT *, CAST(-ROUND(CAST(s0 AS DECIMAL(20,2)) * CAST(p1 AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS e1,
            CAST(ROUND(CAST(s1 AS DECIMAL(20,2)) * CAST(p2 AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS e2 FROM seq
), sequence AS (
  SELECT document_id, s0 AS initial_subtotal, COALESCE(s2, s0) AS last_subtotal, CASE WHEN p1 IS NULL THEN 0 ELSE 2 END AS step_count,
         p1 IS NULL OR (ABS(a1 - e1) <= 0.02 AND ABS(s1 - (s0 + e1)) <= 0.02 AND ABS(a2 - e2) <= 0.02 AND ABS(s2 - (s1 + e2)) <= 0.02) AS sequence_matches
  FROM expected
)"""

SHIFTED_SQL = CHECKED_SQL + """
, shifted AS (
  SELECT document_id, sort_order, line_type, label_raw, percent,
         CASE WHEN document_id % 9 = 0 AND sort_order = 2 THEN CAST(amount + 7 AS DECIMAL(14,2)) ELSE amount END AS amount
  FROM kept_amounts
)"""


def _shifted(t: Tables) -> DataFrame:
    """Every ninth order prints a wrong middle subtotal."""
    wrong = (F.col("document_id") % 9 == 0) & (F.col("sort_order") == 2)
    return kept_amounts(t).withColumn(
        "amount", F.when(wrong, F.col("amount") + 7).otherwise(F.col("amount")).cast("decimal(14,2)")
    )


@query("printed_sequence_check", "VAL-06", SHIFTED_SQL + SUMS_SQL + """
SELECT document_id, CAST(initial_subtotal AS DOUBLE) AS initial_subtotal, CAST(last_subtotal AS DOUBLE) AS last_subtotal, step_count, sequence_matches FROM sequence""")
def _(t):
    return V.sequence_check(_shifted(t)).select(
        "document_id", F.col("initial_subtotal").cast("double").alias("initial_subtotal"),
        F.col("last_subtotal").cast("double").alias("last_subtotal"), "step_count", "sequence_matches",
    )


def _freight_amounts(t: Tables) -> DataFrame:
    """Surcharge rows as freight rows; a tenth of them are aggregates above their base."""
    key = F.col("document_id")
    return t.amount_lines.where("line_type = 'surcharge'").select(
        "document_id", "line_type", F.lit("Frachtkostenbeitrag").alias("label_raw"), "amount",
        F.when(key % 10 == 0, (F.col("amount") - 1)).otherwise(F.col("amount") + 1).cast("decimal(14,2)").alias("base_amount"),
    ).unionByName(
        t.amount_lines.where("line_type = 'discount'").select(
            "document_id", F.lit("surcharge").alias("line_type"), F.lit("Baustellenanlieferung").alias("label_raw"),
            F.abs("amount").cast("decimal(14,2)").alias("amount"), "base_amount",
        )
    )


@query("delivery_totals", "VAL-07 FLT-13", CHECKED_SQL + """
, fr AS (
  SELECT document_id, COUNT(*) FILTER (block) > 0 AS any_block, COALESCE(SUM(line_total) FILTER (block), 0) AS position_total,
         arg_min(printed_total, item_seq) FILTER (block AND printed_total IS NOT NULL) AS parser_total
  FROM checked GROUP BY document_id
), pr AS (
  SELECT document_id, CASE WHEN document_id % 10 = 0 THEN MAX(CASE WHEN line_type = 'surcharge' THEN amount END)
                           ELSE NULLIF(SUM(ABS(amount)), 0) END AS printed_total
  FROM amount_lines WHERE line_type IN ('surcharge', 'discount') GROUP BY document_id
)
SELECT document_id, CAST(CASE WHEN any_block THEN position_total ELSE 0 END AS DOUBLE) AS position_total, CAST(parser_total AS DOUBLE) AS parser_total,
       CAST(pr.printed_total AS DOUBLE) AS printed_total,
       CAST(COALESCE(parser_total, pr.printed_total, position_total) AS DOUBLE) AS delivery_total
FROM pr LEFT JOIN fr USING (document_id)""")
def _(t):
    return V.delivery_totals(checked_items(t), _freight_amounts(t)).select(
        "document_id", *[F.col(c).cast("double").alias(c) for c in ("position_total", "parser_total", "printed_total", "delivery_total")]
    )


COMPONENT_SQL = CHECKED_SQL + """
, it AS (
  SELECT document_id, COUNT(*) AS position_count,
         SUM(CASE WHEN NOT is_alternative THEN line_total END) AS main_sum,
         SUM(CASE WHEN counted THEN line_total END) AS component_sum,
         BOOL_OR(counted AND line_total IS NOT NULL AND pricing_applied AND NOT pricing_disabled) AS adjusted,
         COALESCE(SUM(line_total) FILTER (block), 0) AS freight, COUNT(*) FILTER (block) AS blocks,
         arg_min(printed_total, item_seq) FILTER (block AND printed_total IS NOT NULL) AS parser_total
  FROM (SELECT *, CASE WHEN provider_key = 'sr_schauraum' THEN TRUE
                       WHEN provider_key = 'alu_one' AND COALESCE(lower(description_short) LIKE 'az - %', FALSE) THEN FALSE
                       WHEN info THEN FALSE ELSE NOT is_alternative END AS counted FROM flagged)
  GROUP BY document_id
), am AS (
  SELECT document_id, COALESCE(SUM(amount) FILTER (line_type IN ('discount', 'surcharge')), 0) AS adjustments,
         arg_max(amount, sort_order) FILTER (line_type = 'subtotal') AS last_subtotal
  FROM kept_amounts GROUP BY document_id
), component AS (
  SELECT d.document_id, m.provider_key, COALESCE(apply_pricing_adjustments, TRUE) AS on_flag, m.reason, d.net_total,
         COALESCE(it.position_count, 0) AS position_count, COALESCE(main_sum, 0) AS main_sum, COALESCE(component_sum, 0) AS component_sum,
         COALESCE(adjusted, FALSE) AS adjusted, COALESCE(adjustments, 0) AS adjustments, last_subtotal,
         COALESCE(parser_total, freight, 0) AS delivery_total, COALESCE(freight, 0) > 0 AS delivery_present
  FROM docs d JOIN modes m USING (document_id) LEFT JOIN it USING (document_id) LEFT JOIN am USING (document_id)
), computed AS (
  SELECT *, provider_key = 'rieder' AND on_flag AND last_subtotal IS NOT NULL AS by_sequence FROM component
), component_result AS (
  SELECT *, CASE WHEN by_sequence THEN 'rieder_sequence'
                 WHEN NOT on_flag THEN CASE WHEN provider_key = 'rieder' THEN 'rieder_adjustments_disabled' ELSE 'pricing_adjustments_disabled' END
                 WHEN adjusted THEN provider_key || '_adjusted_positions'
                 WHEN reason IS NULL THEN 'strict' ELSE 'heuristic' END AS component_check_mode,
         CASE WHEN by_sequence THEN last_subtotal + delivery_total WHEN NOT on_flag OR adjusted THEN component_sum
              ELSE component_sum + adjustments END AS computed_net
  FROM computed
)"""


def _sums(t: Tables) -> DataFrame:
    return V.component_sums(t.documents, checked_items(t), kept_amounts(t))


@query("component_sums", "VAL-05 VAL-06 VAL-07", COMPONENT_SQL + """
SELECT document_id, component_check_mode, CAST(computed_net AS DOUBLE) AS computed_net, CAST(main_sum AS DOUBLE) AS main_sum,
       CAST(component_sum AS DOUBLE) AS component_sum, position_count,
       CASE WHEN net_total IS NOT NULL THEN CAST(ABS(net_total - computed_net) <= 0.02 AS VARCHAR) END AS matches_net
FROM component_result""")
def _(t):
    return _sums(t).select(
        "document_id", "component_check_mode", "position_count", F.col("matches_net").cast("string").alias("matches_net"),
        *[F.col(c).cast("double").alias(c) for c in ("computed_net", "main_sum", "component_sum")],
    )


@query("component_issues", "VAL-05", COMPONENT_SQL + """
SELECT document_id, 'net_component_mismatch' AS code FROM component_result
WHERE net_total IS NOT NULL AND position_count > 0 AND component_check_mode = 'strict' AND ABS(net_total - computed_net) > 0.02
UNION ALL SELECT document_id, 'rieder_pricing_sequence_mismatch' FROM component_result
WHERE net_total IS NOT NULL AND by_sequence AND (NOT delivery_present OR ABS(net_total - computed_net) > 0.02)""")
def _(t):
    return V.component_issues(_sums(t)).select("document_id", "code")


def _position_issues(t: Tables) -> DataFrame:
    return V.position_issues(checked_items(t), t.images, _modes(t), page_counts(t))


def _item_issues(t: Tables) -> DataFrame:
    return _position_issues(t).where("item_seq is not null")


@query("reviewed_issues", "VAL-11", CHECKED_SQL + " SELECT document_id, item_seq, code, resolved FROM resolved_issues")
def _(t):
    return _item_issues(t).select("document_id", "item_seq", "code", "resolved")


@query("item_status", "VAL-10 VAL-11", CHECKED_SQL + """
, s AS (
  SELECT document_id, item_seq, COUNT(*) FILTER (NOT resolved AND severity = 'error') AS errors,
         COUNT(*) FILTER (NOT resolved AND severity = 'warning') AS warnings, COUNT(*) FILTER (resolved) AS resolved
  FROM resolved_issues GROUP BY ALL
)
SELECT document_id, item_seq, COALESCE(errors, 0) AS errors, COALESCE(warnings, 0) AS warnings, COALESCE(resolved, 0) AS resolved,
       CASE WHEN errors > 0 THEN 'reject' WHEN warnings > 0 THEN 'review' WHEN resolved > 0 THEN 'manual_checked' ELSE 'auto_accept' END AS status
FROM checked LEFT JOIN s USING (document_id, item_seq)""")
def _(t):
    return V.item_status(checked_items(t), _item_issues(t))


STATUS_SQL = CHECKED_SQL + """
, stacked AS (
  SELECT document_id, severity, code IN ('missing_image_assignment', 'koch_detail_drawings_missing', 'missing_customer') AS soft, FALSE AS resolved
  FROM (SELECT * FROM field_issues UNION ALL SELECT * FROM gross_issues
        UNION ALL SELECT DISTINCT document_id, 'duplicate_image_assignments', 'error' FROM doubled)
  UNION ALL SELECT document_id, severity, code IN ('missing_image_assignment', 'koch_detail_drawings_missing'), resolved FROM resolved_issues
), counted AS (
  SELECT document_id, COUNT(*) FILTER (NOT resolved AND severity = 'error') AS error_count,
         COUNT(*) FILTER (NOT resolved AND severity = 'warning') AS warning_count,
         COUNT(*) FILTER (NOT resolved AND severity = 'warning' AND soft) AS soft_count, COUNT(*) FILTER (resolved) AS resolved_count
  FROM stacked GROUP BY document_id
), statuses AS (
  SELECT document_id, COALESCE(error_count, 0) AS error_count, COALESCE(warning_count, 0) AS warning_count, COALESCE(soft_count, 0) AS soft_count,
         COALESCE(resolved_count, 0) AS resolved_count,
         CASE WHEN error_count > 0 THEN 'reject' WHEN warning_count - soft_count > 0 THEN 'review'
              WHEN resolved_count + soft_count > 0 THEN 'manual_checked' ELSE 'auto_accept' END AS status
  FROM docs LEFT JOIN counted USING (document_id)
)"""


def _statuses(t: Tables) -> DataFrame:
    documents = odd_documents(t)
    return V.document_status(documents, V.document_issues(documents), _position_issues(t))


@query("document_status", "VAL-12", STATUS_SQL + " SELECT * FROM statuses")
def document_status(t):
    return _statuses(t)


@query("confidence_policy", "VAL-13", """
SELECT document_id, CASE WHEN parse_confidence >= 0.85 THEN 'auto_accept' WHEN parse_confidence >= 0.60 THEN 'review' ELSE 'reject' END AS policy FROM docs""")
def _(t):
    return t.documents.select("document_id", V.confidence_policy(F.col("parse_confidence")).alias("policy"))


@query("approval_gate", "VAL-14", STATUS_SQL + """
, j AS (
  SELECT d.document_id, d.status AS processing, s.status AS validation, d.document_id % 2 = 0 AS override,
         CASE WHEN d.document_id % 3 = 0 THEN ' ok ' END AS note FROM docs d JOIN statuses s USING (document_id)
), r AS (
  SELECT *, CASE WHEN processing <> 'processed' THEN 'not_processed'
                 WHEN validation NOT IN ('auto_accept', 'manual_checked') AND NOT override THEN 'blocked_by_validation' END AS reason FROM j
), f AS (SELECT *, reason IS NULL AND validation NOT IN ('auto_accept', 'manual_checked') AND override AS forced FROM r)
SELECT document_id, validation, reason IS NULL AS approved, reason, forced,
       CASE WHEN reason IS NULL THEN CASE WHEN forced THEN '⚠️ Freigabe trotz Blocker erzwungen (Status: ' || validation || ').' || COALESCE(' ' || trim(note), '')
            ELSE trim(note) END END AS approval_note
FROM f""")
def _(t):
    key = F.col("document_id")
    decisions = t.documents.select(
        "document_id", (key % 2 == 0).alias("override"), F.when(key % 3 == 0, " ok ").alias("note")
    )
    return V.approval_gate(t.documents, _statuses(t), decisions)


@query("export_gate", "VAL-15 VAL-16", """
SELECT d.document_id, d.status = 'processed' AND approval_status = 'approved' AND i.document_id IS NOT NULL AS may_export,
       CASE WHEN d.status <> 'processed' AND approval_status <> 'approved' THEN 'document_not_processed,document_not_approved'
            WHEN d.status <> 'processed' THEN 'document_not_processed' WHEN approval_status <> 'approved' THEN 'document_not_approved' ELSE '' END AS preconditions,
       CASE WHEN i.document_id IS NULL THEN 1 ELSE 0 END AS content_errors, FALSE AS override_used
FROM docs d LEFT JOIN (SELECT DISTINCT document_id FROM positions) i USING (document_id)""")
def _(t):
    return V.export_gate(t.documents, V.documents_without_positions(t.documents, t.positions))


@query("required_export_fields", "VAL-16", """
SELECT document_id, 'header' AS scope, 'missing_required_field' AS code, 'supplier_name' AS field FROM docs WHERE supplier_name IS NULL
UNION ALL SELECT document_id, 'header', 'missing_required_field', 'project_ref' FROM docs WHERE project_ref IS NULL
UNION ALL SELECT document_id, 'positions', 'no_positions', NULL FROM docs d WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = document_id)""")
def _(t):
    return V.required_export_issues(
        t.documents, ("supplier_name", "project_ref", "document_number"), "header", ["document_id"]
    ).unionByName(V.documents_without_positions(t.documents, t.positions))
