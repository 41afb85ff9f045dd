"""Queries: drawings and their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.operators import images as I
from offerlake.operators.items import merge_layout_hints, next_windows
from offerlake.plans.catalog import query
from offerlake.plans.views import Tables

FLAGS_SQL = """
, flags AS (
  SELECT *, COUNT(DISTINCT page_ref) OVER (PARTITION BY document_id, sha256) > 1 AS repeated, LEAST(width, height) AS lo, GREATEST(width, height) AS hi FROM images
), flagged_images AS (
  SELECT *, CASE WHEN width * height < 45000 AND bytes_size < 20000 THEN NOT (NOT repeated AND lo >= 60 AND hi::DOUBLE / lo <= 3.0)
       ELSE (hi < 180 AND bytes_size < 12000) OR (repeated AND hi::DOUBLE / lo >= 4.0 AND lo <= 360) OR (hi::DOUBLE / lo >= 4.5 AND lo <= 90 AND bytes_size < 30000) END AS decorative,
       ROW_NUMBER() OVER (PARTITION BY document_id, page_ref ORDER BY top_ratio, left_ratio, image_index, image_id) AS place
  FROM flags
)"""


@query("image_flags", "IMG-01 IMG-02 IMG-03", FLAGS_SQL + """
SELECT document_id, image_id, repeated AS is_repeated_across_pages, decorative AS is_probably_decorative, place AS page_place FROM flagged_images""")
def _(t):
    return I.reading_order(I.with_flags(t.images)).select(
        "document_id", "image_id", "is_repeated_across_pages", "is_probably_decorative", F.col("page_place").cast("long").alias("page_place")
    )


def placed_items(t: Tables) -> DataFrame:
    items = next_windows(t.described_items)
    part = F.col("part_key")
    return items.withColumns({
        "page_end_ref": F.when(part % 13 == 0, F.col("page_ref") + 1).otherwise(F.col("page_ref")),
        "stored_image_ids": F.when(part % 23 == 0, F.array((F.col("document_id") * 100 + 1).cast("bigint"))),
        "stored_source": F.when(part % 19 == 0, "manual"),
    })


@query("page_drawings", "IMG-07 IMG-08", FLAGS_SQL + """
, pg AS (
  SELECT document_id, page_ref, SUM(v) AS visual_items, SUM(w) AS viable FROM (
    SELECT document_id, page_ref, CASE WHEN COALESCE(lower(description_short) = 'lieferung' OR lower(description_short) LIKE 'vorbemerk%', FALSE) THEN 0 ELSE 1 END AS v, 0 AS w FROM described_items
    UNION ALL SELECT document_id, page_ref, 0, CASE WHEN decorative THEN 0 ELSE 1 END FROM flagged_images) GROUP BY ALL
), pn AS (
  SELECT p.*, COALESCE(b.visual_items > b.viable, FALSE) AS prev_short, COALESCE(n.viable, 0) AS next_viable, COALESCE(n.visual_items, 0) AS next_items
  FROM pg p LEFT JOIN pg b ON b.document_id = p.document_id AND b.page_ref = p.page_ref - 1 LEFT JOIN pg n ON n.document_id = p.document_id AND n.page_ref = p.page_ref + 1
), po AS (SELECT *, viable - CASE WHEN prev_short THEN GREATEST(0, viable - visual_items) ELSE 0 END AS own FROM pn)
SELECT document_id, page_ref, CAST(visual_items AS INTEGER) AS visual_items, CAST(own AS INTEGER) AS own,
       CAST(CASE WHEN visual_items > 0 AND own < visual_items THEN GREATEST(0, next_viable - next_items) ELSE 0 END AS INTEGER) AS neighbours FROM po""")
def _(t):
    pages = I.carryover(I.page_table(t.described_items, t.images))
    return pages.select("document_id", "page_ref", "visual_items", F.size("own").alias("own"), F.size("neighbours").alias("neighbours"))


@query("image_windows", "IMG-04 IMG-05 IMG-06", FLAGS_SQL + """
, w AS (
  SELECT document_id, item_seq, page_ref, item_top_ratio, width_mm, height_mm, LEAD(page_ref) OVER d AS np, LEAD(item_top_ratio) OVER d AS nt FROM line_items WINDOW d AS (PARTITION BY document_id ORDER BY item_seq)
), f AS (SELECT document_id, page_ref, MIN(item_top_ratio) AS ft FROM line_items GROUP BY ALL
), pairs AS (
  SELECT w.*, i.image_id, i.page_ref AS ip, i.center_y_ratio AS a, i.decorative, i.width, i.height,
         CASE WHEN np IS NOT NULL THEN
           CASE WHEN i.page_ref < w.page_ref OR i.page_ref > np THEN FALSE WHEN i.page_ref = w.page_ref AND i.center_y_ratio < GREATEST(0.0::DOUBLE, item_top_ratio - 0.01::DOUBLE) THEN FALSE
                WHEN np = w.page_ref OR i.page_ref = np THEN i.center_y_ratio < GREATEST(0.0::DOUBLE, nt - 0.01::DOUBLE) ELSE TRUE END
         WHEN i.page_ref = w.page_ref + 1 THEN TRUE WHEN i.center_y_ratio < GREATEST(0.0::DOUBLE, item_top_ratio - 0.01::DOUBLE) THEN FALSE ELSE TRUE END AS inside,
         GREATEST(width_mm, height_mm)::DOUBLE / LEAST(width_mm, height_mm)::DOUBLE AS ir, GREATEST(width, height)::DOUBLE / LEAST(width, height) AS mr
  FROM w JOIN flagged_images i ON i.document_id = w.document_id AND i.page_ref BETWEEN w.page_ref AND w.page_ref + 1
)
SELECT document_id, item_seq, COUNT(*) AS near_images, COUNT(*) FILTER (inside) AS inside, COUNT(*) FILTER (inside AND (NOT decorative OR (ir >= 4 AND mr >= 4 AND width >= 500 AND height >= 100))) AS viable,
       ROUND(MIN(ABS(ir - mr)), 6) AS best_aspect_gap
FROM pairs GROUP BY ALL""")
def _(t):
    items = next_windows(t.line_items).withColumn("item_ratio", I.item_ratio(F.col("width_mm"), F.col("height_mm")))
    # an image meets the positions of its own page and of the page before it
    drawn = I.with_flags(t.images).select(
        "document_id", F.struct(*I.IMAGE_CELLS).alias("image"), F.explode(F.array(F.col("page_ref"), F.col("page_ref") - 1)).alias("page_ref")
    )
    image = F.col("image")
    pairs = items.join(drawn, ["document_id", "page_ref"])
    return pairs.groupBy("document_id", "item_seq").agg(
        F.count("*").alias("near_images"), F.count_if(I.within_window(image)).alias("inside"), F.count_if(I.is_viable_for_item(image)).alias("viable"),
        F.round(F.min(I.aspect_difference(image)), 6).alias("best_aspect_gap"),
    )


@query("page_assignments", "IMG-07 IMG-08 IMG-09 IMG-10 IMG-11 IMG-20")
def page_assignments(t):
    out = I.assign_by_page(placed_items(t), t.images, t.described_items)
    texts = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("image_ids", "image_candidate_ids")}
    return out.select(
        "document_id", "item_seq", *[v.alias(c) for c, v in texts.items()], "image_next_page_allowed", "image_prefers_next_page",
        "image_assignment_source", "image_assignment_reason", "image_auto_match_allowed",
    )


def _matches(t: Tables) -> DataFrame:
    assigned = I.assign_by_page(placed_items(t), t.images, t.described_items)
    return I.select_matches(I.score_candidates(assigned))


@query("image_matches", "IMG-12 IMG-13 IMG-14")
def image_matches(t):
    out = I.reset_automatic(_matches(t))
    return out.select(
        "document_id", "item_seq", F.array_join(F.col("ranked").cast("array<string>"), ",").alias("ranked"),
        F.array_join(F.col("selected_image_ids").cast("array<string>"), ",").alias("selected"), F.get("scores", F.lit(0))["score"].alias("best_score"),
        "selection_source", "selection_reason", "is_manual",
    )


@query("unique_image_matches", "IMG-15 IMG-16")
def unique_image_matches(t):
    out = I.written_assignments(I.resolve_conflicts(_matches(t)))
    return out.withColumn("image_ids", F.array_join(F.col("image_ids").cast("array<string>"), ","))


@query("image_usage", "IMG-17", """
, u AS (SELECT document_id, item_seq, CASE WHEN part_key % 37 = 0 THEN document_id * 100 + 1 ELSE line_item_id END AS image_id FROM line_items WHERE part_key % 5 <> 0)
SELECT document_id, image_id, COUNT(*) AS match_count, COUNT(DISTINCT item_seq) AS position_count, MIN(item_seq) AS first_item_seq FROM u GROUP BY ALL""")
def _(t):
    part = F.col("part_key")
    first = (F.col("document_id") * 100 + 1).cast("bigint")
    items = t.line_items.withColumn("image_ids", F.when(part % 5 == 0, F.array().cast("array<bigint>")).when(part % 37 == 0, F.array(first)).otherwise(F.array("line_item_id")))
    return I.image_usage(items)


@query("usable_images", "FLT-14", """
, keyed AS (
  SELECT i.*, CASE i.document_id % 5 WHEN 0 THEN 'koch_detail' WHEN 1 THEN 'schlotterer' WHEN 2 THEN 'koch' ELSE 'newo' END AS template, document_type FROM images i JOIN docs USING (document_id)
)
SELECT document_id, image_id FROM keyed WHERE CASE template WHEN 'koch_detail' THEN NOT (width >= 500 AND height <= 220) AND GREATEST(width, height) >= 700
  WHEN 'schlotterer' THEN FALSE WHEN 'koch' THEN image_index % 2 = 0 ELSE TRUE END""")
def _(t):
    key = F.col("document_id") % 5
    documents = t.documents.withColumn("template", F.when(key == 0, "koch_detail").when(key == 1, "schlotterer").when(key == 2, "koch").otherwise("newo"))
    images = t.images.withColumns({
        "layout_source": F.when(F.col("image_index") % 2 == 1, "vector_strip_band").otherwise("block"), "width_ratio": F.lit(0.3), "height_ratio": F.lit(0.2),
    })
    return I.usable_images(images, documents).select("document_id", "image_id")


@query("layout_hint_merge", "LI-18", """
, h AS (SELECT document_id, item_seq, item_top_ratio, CASE WHEN part_key % 6 <> 0 THEN CASE WHEN part_key % 7 = 0 THEN 0 ELSE item_seq END END AS hint_no FROM line_items
), r AS (SELECT *, COALESCE(hint_no > COALESCE(LAG(hint_no) OVER w, CASE WHEN ROW_NUMBER() OVER w = 1 THEN -1 END), FALSE) AS rises FROM h WINDOW w AS (PARTITION BY document_id ORDER BY item_seq)
), m AS (SELECT *, BOOL_AND(rises) OVER (PARTITION BY document_id ORDER BY item_seq ROWS UNBOUNDED PRECEDING) AS kept FROM r)
SELECT document_id, item_seq, CASE WHEN kept THEN item_top_ratio END AS item_top_ratio FROM m""")
def _(t):
    part = F.col("part_key")
    # some hints name no position
    hints = t.line_items.select(
        "document_id", F.when(part % 6 != 0, F.col("position_no")).alias("position_no"), "page_ref", F.when(part % 7 == 0, 0).otherwise(F.col("item_seq")).alias("hint_no"), "item_top_ratio"
    )
    return merge_layout_hints(t.line_items, hints).select("document_id", "item_seq", "item_top_ratio")
