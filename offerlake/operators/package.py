"""Document packages: one main document plus drawing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.operators.validate import DOC_TYPES


def main_documents(members: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """The one offer or confirmation with positions of every package; otherwise an error code.

    ``members``: package_id, document_id.
    """
    with_items = documents.where(X.comparison_text(F.col("document_type")).isin(*DOC_TYPES)).join(
        items.select("document_id"), "document_id", "left_semi"
    ).select("document_id", F.col("document_id").alias("candidate"))
    counted = members.join(with_items, "document_id", "left").groupBy("package_id").agg(
        F.count("candidate").alias("candidates"), F.max("candidate").alias("candidate")
    )
    return counted.select(
        "package_id",
        F.when(F.col("candidates") == 1, F.col("candidate")).alias("main_document_id"),
        F.when(F.col("candidates") == 0, "no_main_document").when(F.col("candidates") > 1, "several_main_documents").alias("error"),
    )


def position_drawings(members: DataFrame, mains: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """Drawings of the other package documents, one row per position they name.

    ``images`` carries source_position_numbers and source_detail_type.
    """
    usable = mains.where("main_document_id is not null").select("package_id", "main_document_id")
    others = members.join(usable, "package_id").where("document_id <> main_document_id")
    named = others.join(documents.select("document_id", "project_ref"), "document_id").join(
        images.select("document_id", "image_id", "page_ref", "image_index", "source_position_numbers", "source_detail_type"), "document_id"
    )
    kind = F.lower(F.coalesce(X.clean_optional(F.col("source_detail_type")), F.col("project_ref"), F.lit("")))
    priority = F.when(kind.contains("visualisierung"), 0).when(kind.contains("system"), 1).otherwise(2)
    positions = F.filter(
        F.array_distinct(F.transform("source_position_numbers", X.strip)), lambda p: p != ""
    )
    return named.select(
        "package_id", "main_document_id", "document_id", "image_id",
        F.struct(priority.alias("priority"), F.col("page_ref"), F.col("image_index"), F.col("document_id"), F.col("image_id")).alias("rank"),
        F.explode(positions).alias("position_no"),
    )


def package_assignments(drawings: DataFrame, items: DataFrame) -> DataFrame:
    """Best drawing per position of the main document; null where a position has none.

    The best one is a minimum, so drawings of one position are never gathered.
    """
    best = drawings.groupBy("main_document_id", "position_no").agg(
        F.min("rank")["image_id"].alias("image_id"), F.countDistinct("image_id").alias("candidate_count")
    )
    mains = drawings.select("main_document_id").distinct()
    positions = items.select(
        F.col("document_id").alias("main_document_id"), "item_seq", X.strip(F.col("position_no")).alias("position_no")
    ).join(mains, "main_document_id", "left_semi")
    return positions.join(best, ["main_document_id", "position_no"], "left")


def missing_positions(drawings: DataFrame, items: DataFrame) -> DataFrame:
    mains = drawings.select("main_document_id").distinct()
    positions = items.select(F.col("document_id").alias("main_document_id"), X.strip(F.col("position_no")).alias("position_no"))
    return positions.where("position_no <> ''").join(mains, "main_document_id", "left_semi").join(
        drawings.select("main_document_id", "position_no"), ["main_document_id", "position_no"], "left_anti"
    )
