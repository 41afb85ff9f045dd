"""Document texts, pages and lines; upload admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X


def text_rejects(doc_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with content, rejected rows with a reason)."""
    filled = X.has_text(doc_text["text"])
    return doc_text.where(filled), doc_text.where(~filled).select("document_id", F.lit("empty_text").alias("reason"))


def page_lines(doc_text: DataFrame) -> DataFrame:
    """One row per line: page, line number on the page, text. Two explodes, no shuffle."""
    pages = doc_text.select("document_id", F.posexplode(X.split_pages(F.col("text"))).alias("page0", "page"))
    rows = pages.select("document_id", "page0", F.posexplode(X.split_lines(F.col("page"))).alias("line0", "line"))
    return rows.select(
        "document_id", (F.col("page0") + 1).alias("page_ref"), (F.col("line0") + 1).alias("line_no"), "line"
    )


def page_count(text: Column) -> Column:
    """Pages of a stored text; none for an empty one."""
    clean = X.strip(text)
    return F.when(clean != "", F.regexp_count(clean, F.lit("\f")) + 1)


def line_top_ratio(line_index: Column, line_count: Column) -> Column:
    """Vertical place of a line on its page, kept off the edges."""
    share = line_index.cast("double") / F.greatest(line_count, F.lit(1)).cast("double")
    return F.least(F.lit(0.98), F.greatest(F.lit(0.02), share))


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """Accepts non-empty .pdf files and gives them a safe stored name; the others keep a reason."""
    name = F.col("file_name")
    reason = (
        F.when(F.coalesce(X.strip(name), F.lit("")) == "", "missing_name")
        .when(~F.lower(name).endswith(".pdf"), "not_a_pdf")
        .when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "empty_file")
    )
    base = X.strip(F.substring_index(name, "/", -1))
    safe = F.btrim(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    stored = F.when(safe == "", "upload.pdf").otherwise(safe)
    return uploads.withColumns({
        "accepted": reason.isNull(), "reason": reason, "stored_name": F.when(reason.isNull(), stored)
    })
