"""Position extraction: cut a text into blocks, shape blocks into typed item rows.

A document stays one row until its positions are exploded, so extraction is a
narrow plan without any exchange, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.numbers import eu_decimal
from offerlake.operators.lines import line_top_ratio
from offerlake.operators.windows import per_document
from offerlake.rules.base import RuleSet

MARK, SEP, CARRY = "\u0001", "\u0002", "\u0003"

RAW_ITEM = {
    "position_no": "string", "lv_pos": "string", "is_alternative": "boolean", "quantity_raw": "string", "unit": "string",
    "width_raw": "string", "height_raw": "string", "description_short": "string", "description_long": "string",
    "unit_price_raw": "string", "line_total_raw": "string", "page_ref": "int", "page_end_ref": "int",
    "item_top_ratio": "double", "image_required": "boolean", "image_auto_match_allowed": "boolean",
    "referenced_lv_pos": "string", "pricing_source": "string", "printed_total": "decimal(14,2)",
    "alternative_parent_position_no": "string", "sequential_alternative": "boolean",
    "components": "array<struct<label:string,amount_raw:string>>",
}


def _marked_page(rule: RuleSet, page: Column, page_ref: Column) -> Column:
    """A page as one text in which every position start carries its page and line place."""

    def mark(lines: Column) -> Column:
        def line_mark(line: Column, i: Column) -> Column:
            following = F.coalesce(F.get(lines, i + 1), F.lit(""))
            place = F.concat_ws(SEP, page_ref.cast("string"), i.cast("string"), F.size(lines).cast("string"), F.lit(""))
            return F.when(rule.is_start(line, following), F.concat(F.lit(MARK), place, line)).otherwise(line)

        return X.join_lines(F.transform(lines, line_mark))

    lines = X.filled_lines(page) if rule.filled_only else X.split_lines(page)
    body = X.let(lines, mark)
    if rule.carry:
        return F.concat(F.lit(CARRY), body)
    if rule.per_page:
        head = F.concat_ws(SEP, page_ref.cast("string"), F.lit("-"), F.lit("-"), F.lit(""))
        return F.concat(F.lit(MARK), head, body)
    return body


def blocks(doc_text: DataFrame, rule: RuleSet) -> DataFrame:
    """Blocks of a rule set: one row per position start, plus page heads where blocks end at pages.

    block: text from the start to the next one; carried, where the rule set asks for it: the heads of the pages up to the next start; before, where the rule set asks for it: up to
    six blocks before it, joined (for headings that precede a position).
    """
    text = X.normalize_text(F.col("text"))
    if rule.prepare is not None:
        text = rule.prepare(text)
    pages = F.transform(X.split_pages(text), lambda page, i: _marked_page(rule, page, i + 1))
    cut = doc_text.select("document_id", F.split(F.array_join(pages, "\f"), MARK, -1).alias("parts"))

    if rule.headings:
        # a block stands before up to six others: its place is taken off once
        bare = F.transform("parts", lambda p: F.regexp_replace(p, f"^[^{SEP}]*{SEP}[^{SEP}]*{SEP}[^{SEP}]*{SEP}", ""))
        cut = cut.withColumn("bodies", bare)

    def entry(part: Column, i: Column) -> Column:
        cells = F.split(part, SEP, 4)
        text = F.get(cells, F.lit(3))
        pieces = F.split(text, CARRY, -1)
        fields = [
            i.alias("block_no"),
            F.get(cells, F.lit(0)).try_cast("int").alias("page_ref"),
            F.get(cells, F.lit(1)).try_cast("int").alias("line_index"),
            F.get(cells, F.lit(2)).try_cast("int").alias("line_count"),
            (F.get(pieces, F.lit(0)) if rule.carry else text).alias("block"),
        ]
        if rule.carry:
            fields.append(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("carried"))
        if rule.headings:
            fields.append(F.array_join(F.slice(F.col("bodies"), F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6))), "").alias("before"))
        return F.struct(*fields)

    listed = cut.select("document_id", F.inline(F.slice(F.transform("parts", entry), F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))))
    return listed.withColumn("page_end_ref", F.col("page_ref") + F.regexp_count(F.expr("left(block, greatest(length(block) - 1, 0))"), F.lit("\f")))


def raw_items(doc_text: DataFrame, rule: RuleSet) -> DataFrame:
    """Item rows of one rule set as printed text, numbered in text order."""
    rows = shaped_items(doc_text, rule)
    return rows if rule.after is None else rule.after(rows)


def shaped_items(doc_text: DataFrame, rule: RuleSet) -> DataFrame:
    """``raw_items`` before the rule set's last step over all rows, such as pairing; a narrow plan."""
    if rule.custom is not None:
        shaped = rule.custom(doc_text)
    elif rule.shape is None:
        return _empty(doc_text)
    else:
        shaped = rule.shape(blocks(doc_text, rule))
    missing = {c: F.lit(None).cast(t) for c, t in RAW_ITEM.items() if c not in shaped.columns}
    shaped = shaped.withColumns(missing) if missing else shaped
    return shaped.select(
        "document_id", "block_no",
        *[F.col(c).cast(t).alias(c) for c, t in RAW_ITEM.items() if c != "is_alternative"],
        F.coalesce("is_alternative", F.lit(False)).alias("is_alternative"),
    )


def _empty(doc_text: DataFrame) -> DataFrame:
    cells = [F.lit(None).cast(t).alias(c) for c, t in RAW_ITEM.items()]
    return doc_text.where(F.lit(False)).select("document_id", F.lit(0).alias("block_no"), *cells)


def numbered(rows: DataFrame) -> DataFrame:
    """Dense item_seq per document in text order."""
    return rows.withColumn("item_seq", F.row_number().over(per_document("block_no"))).drop("block_no")


def typed_items(rows: DataFrame) -> DataFrame:
    """Decimals beside the printed texts, and the item confidence."""
    money = "decimal(14,2)"
    typed = rows.withColumns({
        "quantity": eu_decimal(F.col("quantity_raw"), "decimal(14,4)"),
        "width_mm": eu_decimal(F.col("width_raw"), "decimal(12,2)"),
        "height_mm": eu_decimal(F.col("height_raw"), "decimal(12,2)"),
        "unit_price": eu_decimal(F.col("unit_price_raw"), money),
        "line_total": eu_decimal(F.col("line_total_raw"), money),
        "spans_page_break": F.col("page_end_ref") > F.col("page_ref"),
    })
    return typed.withColumn(
        "confidence", F.when(F.col("line_total").isNotNull(), F.lit("0.85")).otherwise("0.70").cast("decimal(5,4)")
    )


def component_rows(items: DataFrame) -> DataFrame:
    """The priced components of positions, one row each in printed order."""
    listed = items.select("document_id", "item_seq", F.posexplode("components").alias("place", "component"))
    return listed.select(
        "document_id", "item_seq", (F.col("place") + 1).alias("component_no"), F.col("component.label").alias("label"),
        eu_decimal(F.col("component.amount_raw"), "decimal(14,2)").alias("amount"),
    )


def with_room_label(items: DataFrame) -> DataFrame:
    """Puts the room label in front of the long text unless it already leads it."""
    label = X.strip(F.coalesce("lv_pos", F.lit("")))
    long_text = F.coalesce("description_long", F.lit(""))
    leads = X.strip(F.regexp_extract(long_text, r"^([^\n]*)", 1)) == label
    joined = F.when(long_text == "", label).otherwise(F.concat_ws("\n", label, long_text))
    return items.withColumn(
        "description_long",
        F.when((label == "") | leads, F.col("description_long")).otherwise(joined),
    )


def next_windows(items: DataFrame) -> DataFrame:
    """Where the following position begins: in the document, on the page, on the next used page.

    Only positions with a top ratio take part.
    """
    cells = {
        "next_position_page_ref": F.lead("page_ref").over(_placed_window("item_seq")),
        "next_position_top_ratio": F.lead("item_top_ratio").over(_placed_window("item_seq")),
        "next_item_top_ratio": F.when(F.lead("page_ref").over(_placed_window("page_ref", "item_top_ratio", "item_seq")) == F.col("page_ref"),
                                      F.lead("item_top_ratio").over(_placed_window("page_ref", "item_top_ratio", "item_seq"))),
        # in this order the last of a page is followed by the first of the next used page
        "next_page_first_item_top_ratio": F.when(F.lead("page_ref").over(_placed_window("page_ref", "item_top_ratio", F.desc("item_seq"))) != F.col("page_ref"),
                                                 F.lead("item_top_ratio").over(_placed_window("page_ref", "item_top_ratio", F.desc("item_seq")))),
    }
    kept = [c for c in items.columns if c not in cells]
    marked = items.select(*kept, (F.col("item_top_ratio").isNotNull() & F.col("page_ref").isNotNull()).alias("_placed"))
    return marked.select(*kept, *[F.when(F.col("_placed"), value).alias(c) for c, value in cells.items()])


def _placed_window(*order):
    # partitioned by document at the exchange, so that all orders share it
    return Window.partitionBy("document_id", "_placed").orderBy(*order)


def merge_layout_hints(items: DataFrame, hints: DataFrame) -> DataFrame:
    """Top ratios from layout hints, taken in order; one position without a hint ends the merge.

    ``hints``: document_id, hint_no, position_no, page_ref, item_top_ratio, one per
    (page, position). A position keeps its hint only if all positions before it have
    hints with rising numbers, which is what a single forward pass would find.
    """
    joined = items.drop("item_top_ratio").join(
        hints.select("document_id", "position_no", "page_ref", "hint_no", "item_top_ratio"),
        ["document_id", "position_no", "page_ref"], "left",
    )
    by_seq = per_document("item_seq")
    before = F.lag("hint_no").over(by_seq)
    first = F.row_number().over(by_seq) == 1
    rises = F.coalesce(F.col("hint_no") > F.when(first, F.lit(-1)).otherwise(before), F.lit(False))
    joined = joined.withColumn("_rises", rises)
    so_far = F.min("_rises").over(by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("item_top_ratio", F.when(so_far, F.col("item_top_ratio"))).drop("_rises", "hint_no")


def block_top_ratio() -> Column:
    return line_top_ratio(F.col("line_index"), F.col("line_count"))
