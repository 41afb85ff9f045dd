"""Amount lines: extraction from text, table build, selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.operators.windows import per_document
from offerlake.functions.keys import ascii_key
from offerlake.functions.numbers import eu_decimal, eu_format


# Words that make a line an amount line.
TRIGGER_WORDS = (
    "summe", "gesamtbetrag", "endbetrag", "gesamtpreis", "nettowert", "gesamt eur", "bruttobetrag",
    "mehrwertsteuer", "ust.", "mwst", "umsatzsteuer", "rabatt", "zuschlag", "frachtkosten",
    "baustellenanlieferung", "zustellung",
)
GRAND_TOTAL_WORDS = ("angebotssumme", "gesamtsumme", "gesamt eur", "bruttobetrag", "summe brutto")
RATE_WORDS = ("%", "rabatt", "zuschlag", "mehrwertsteuer", "ust.", "mwst")
NET_WORDS = (
    "gesamtbetrag netto", "gesamtbetrag (netto)", "summe positionen", "gesamtpreis positionen",
    "gesamtpreis ohne mwst", "gesamtpreis ohne ust", "nettosumme", "nettowert", "summe netto",
)
TOTAL_WORDS = (
    "endbetrag", "gesamtbetrag", "gesamtpreis incl. mwst", "gesamtpreis inkl. mwst", "angebotssumme",
    "gesamtsumme", "gesamt eur", "bruttobetrag", "summe brutto",
)
SUBTOTAL_WORDS = ("zwischensumme", "summe ohne montagekosten", "summe der positionen")
SURCHARGE_WORDS = ("zuschlag", "frachtkosten", "zustellung", "baustellenanlieferung")
UST = r"(?U)\bust\.?\b"
ITEM_DISCOUNT = r"(?iU)\b[0-9]+(?:[.,][0-9]+)?-\s*%\s*Rabatt\b"
PERCENT = r"([0-9]+(?:[.,][0-9]+)?)\s*%"


def has_vat_word(low: Column) -> Column:
    return X.contains_any(low, ("mehrwertsteuer", "mwst", "umsatzsteuer")) | F.regexp_like(low, F.lit(UST))


def is_amount_head(line: Column) -> Column:
    """Column heads of price tables."""
    low = F.lower(line)
    return (low.contains("einzelpreis") & low.contains("gesamtpreis")) | (
        low.contains("preis/me") & low.contains("nettobetrag")
    )


def is_amount_trigger(line: Column) -> Column:
    return X.let(F.lower(line), lambda low: _triggers(line, low))


def _triggers(line: Column, low: Column) -> Column:
    item_discount = F.regexp_like(line, F.lit(ITEM_DISCOUNT)) & ~X.starts_with_any(
        low, ("abzüglich", "zuzüglich", "rabatt", "zuschlag")
    )
    return (
        ~is_amount_head(line)
        & ~low.contains("inklusive rabatte")
        & ~low.startswith("der sonderrabatt ist")
        & ~item_discount
        & (X.contains_any(low, TRIGGER_WORDS) | F.regexp_like(low, F.lit(UST)))
    )


def amount_class(label: Column) -> Column:
    """Kind of an amount line; the first rule that fits wins."""
    low = F.lower(label)
    return (
        F.when(X.contains_any(low, NET_WORDS), "net_total")
        .when(X.contains_any(low, TOTAL_WORDS), "total")
        .when(X.contains_any(low, SUBTOTAL_WORDS) | low.startswith("summe"), "subtotal")
        .when(has_vat_word(low), "vat")
        .when(low.contains("rabatt") | low.contains("abzug"), "discount")
        .when(X.contains_any(low, SURCHARGE_WORDS), "surcharge")
        .otherwise("other")
    )


def _last(tokens: Column, back: int = 1) -> Column:
    return F.get(tokens, F.size(tokens) - back)


def extract_amount_lines(doc_text: DataFrame) -> DataFrame:
    """One row per amount line of a text, in text order.

    Works inside the row: the lines of a document are an array, every line looks at
    most seven lines ahead, and only the found amount lines are exploded. No shuffle.
    """
    lines = F.transform(
        X.normal_lines(F.col("text")),
        lambda line: F.struct(line.alias("line"), is_amount_trigger(line).alias("trigger")),
    )
    prepared = doc_text.select("document_id", lines.alias("lines"))

    def ahead(all_lines: Column, i: Column, count: int) -> Column:
        """Following lines up to the next amount line."""
        window = F.slice(all_lines, i + 2, F.lit(count))
        open_part = X.lines_before(window, lambda w: (w["line"] != "") & w["trigger"])
        return F.filter(F.transform(open_part, lambda w: w["line"]), lambda text: text != "")

    marked = F.transform(
        F.col("lines"),
        lambda row, i: F.struct(
            i.alias("line_no"), row["line"].alias("line"), row["trigger"].alias("trigger"),
            F.when(row["trigger"], ahead(F.col("lines"), i, 3)).alias("near"),
            F.when(row["trigger"], ahead(F.col("lines"), i, 7)).alias("far"),
        ),
    )
    found = prepared.select(
        "document_id", F.inline(F.filter(marked, lambda row: row["trigger"] & (row["line"] != "")))
    )
    low = F.lower("line")
    grand, rate = X.contains_any(low, GRAND_TOTAL_WORDS), X.contains_any(low, RATE_WORDS)
    found = found.select(
        "document_id", "line_no", "line",
        X.amount_tokens(F.col("line")).alias("own"),
        F.when(F.size("near") > 0, X.amount_tokens(F.concat_ws(" ", F.col("line"), F.array_join("near", " ")))).alias("merged"),
        F.flatten(F.transform("far", X.amount_tokens)).alias("later"),
    )
    has_own, has_merged = F.size("own") > 0, F.coalesce(F.size("merged") > 0, F.lit(False))
    amount = (
        F.when(has_own, _last(F.col("own")))
        .when(has_merged, F.when(grand, _last(F.col("merged"))).otherwise(F.get("merged", F.lit(0))))
        .otherwise(F.when(grand, _last(F.col("later"))).otherwise(F.get("later", F.lit(0))))
    )
    base = F.when(has_own, _last(F.col("own"), 2)).when(
        has_merged,
        F.when(grand, None).when(rate, F.get("merged", F.lit(1))).otherwise(_last(F.col("merged"), 2)),
    )
    typed = found.select(
        "document_id", "line_no", F.col("line").alias("label_raw"),
        amount_class(F.col("line")).alias("line_type"), amount.alias("amount_raw"), base.alias("base_amount_raw"),
        X.group(F.col("line"), PERCENT).alias("percent_raw"),
    ).where("amount_raw is not null")
    return signed(typed)


def signed(rows: DataFrame) -> DataFrame:
    """Discount amounts always carry a minus."""
    negative = F.concat(F.lit("-"), X.strip(F.col("amount_raw")))
    return rows.withColumn(
        "amount_raw",
        F.when((F.col("line_type") == "discount") & ~F.col("amount_raw").startswith("-"), negative)
        .otherwise(F.col("amount_raw")),
    )


def first_of_equal(rows: DataFrame) -> DataFrame:
    """Keeps the first of equal (label, amount, kind) rows of a document.

    An aggregate, so repeats collapse before the shuffle.
    """
    rest = [c for c in rows.columns if c not in ("document_id", "line_no")]
    return (
        rows.groupBy("document_id", F.lower("label_raw").alias("_label"), F.col("amount_raw").alias("_amount"),
                     F.col("line_type").alias("_type"))
        .agg(F.min_by(F.struct(*rest), "line_no").alias("_row"), F.min("line_no").alias("line_no"))
        .select("document_id", "line_no", "_row.*")
    )


def resequence(rows: DataFrame, order: list[str], name: str = "sort_order") -> DataFrame:
    """Dense numbers from 0 per document in the given order."""
    ranked = F.row_number().over(per_document(*order)) - 1
    return rows.withColumn(name, ranked.cast("int"))


def amount_rows(extracted: DataFrame, templates: DataFrame) -> DataFrame:
    """Typed amount rows with the supplier-specific filters and relabelling."""
    joined = resequence(first_of_equal(extracted), ["line_no"]).join(
        templates.select("document_id", "template"), "document_id"
    )
    low = X.strip(F.lower("label_raw"))
    kind = F.when((F.col("template") == "schuchter") & low.contains("summe positionen"), "subtotal").otherwise(
        F.col("line_type")
    )
    return (
        joined.where((F.col("template") != "alu_one") | F.col("line_type").isin("net_total", "vat", "total"))
        .select(
            "document_id", kind.alias("line_type"), "label_raw",
            eu_decimal(F.col("percent_raw"), "decimal(8,4)").alias("percent"),
            eu_decimal(F.col("base_amount_raw"), "decimal(14,2)").alias("base_amount"),
            eu_decimal(F.col("amount_raw"), "decimal(14,2)").alias("amount"),
            F.col("sort_order").cast("decimal(12,2)").alias("sort_order"),
        )
        .where("amount is not null")
    )


# Labels of total rows that a text does not print.
TOTAL_LABELS = (("net_total", "Nettosumme"), ("vat", "Mehrwertsteuer"), ("total", "Angebotssumme"))


def upsert_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Net, VAT (20 %) and gross replace the first row of their kind or are appended.

    ``totals`` holds net_total, vat_total, gross_total per document; a null total
    changes nothing. Appended rows come after the existing ones.
    """
    stacked = totals.select(
        "document_id",
        F.inline(F.array(
            F.struct(F.lit("net_total").alias("line_type"), F.col("net_total").alias("new_amount"), F.lit(0).alias("step")),
            F.struct(F.lit("vat").alias("line_type"), F.col("vat_total").alias("new_amount"), F.lit(1).alias("step")),
            F.struct(F.lit("total").alias("line_type"), F.col("gross_total").alias("new_amount"), F.lit(2).alias("step")),
        )),
    ).where("new_amount is not null")
    firsts = rows.groupBy("document_id", "line_type").agg(F.min("sort_order").alias("first_order"))
    counts = rows.groupBy("document_id").agg(F.count("*").alias("row_count"))
    plan = stacked.join(firsts, ["document_id", "line_type"], "left")
    replaced = (
        rows.join(plan.where("first_order is not null").select("document_id", "line_type", "new_amount", "first_order"),
                  ["document_id", "line_type"], "left")
        .withColumn("_hit", F.coalesce(F.col("sort_order") == F.col("first_order"), F.lit(False)))
        .select(
            "document_id", "line_type", "label_raw",
            F.when(F.col("_hit") & (F.col("line_type") == "vat"), F.lit(20)).otherwise(F.col("percent"))
            .cast("decimal(8,4)").alias("percent"),
            F.when(F.col("_hit"), None).otherwise(F.col("base_amount")).cast("decimal(14,2)").alias("base_amount"),
            F.when(F.col("_hit"), F.col("new_amount")).otherwise(F.col("amount")).cast("decimal(14,2)").alias("amount"),
            F.col("sort_order").cast("decimal(12,2)").alias("sort_order"),
        )
    )
    labels = F.create_map(*[F.lit(v) for pair in TOTAL_LABELS for v in pair])
    missing = plan.where("first_order is null").join(counts, "document_id", "left")
    earlier = F.count("*").over(Window.partitionBy("document_id").orderBy("step")) - 1
    appended = missing.select(
        "document_id", "line_type", F.try_element_at(labels, F.col("line_type")).alias("label_raw"),
        F.when(F.col("line_type") == "vat", F.lit(20)).cast("decimal(8,4)").alias("percent"),
        F.lit(None).cast("decimal(14,2)").alias("base_amount"),
        F.col("new_amount").cast("decimal(14,2)").alias("amount"),
        (F.coalesce("row_count", F.lit(0)) + earlier).cast("decimal(12,2)").alias("sort_order"),
    )
    return resequence(replaced.unionByName(appended), ["sort_order", "line_type"])


GROUP_ROW = (
    r"(?iu)^\s*([A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß0-9 /+._-]*?)\s+"
    rf"({X.MONEY})\s+([0-9]+(?:[,.][0-9]+)?)\s*%\s+(-?\s*{X.MONEY})"
)


def discount_groups(doc_text: DataFrame) -> DataFrame:
    """Printed discount groups of a text: label, base, percent, amount; repeats dropped."""
    lines = F.transform(X.split_lines(F.col("text")), X.collapse)
    hits = F.filter(lines, lambda line: F.regexp_like(line, F.lit(GROUP_ROW)))

    def parsed(line: Column, place: Column) -> Column:
        # all cells of a line by one match; none can hold the sign between them
        return X.let(F.split(F.regexp_replace(line, GROUP_ROW + ".*$", "$1\u0001$2\u0001$3\u0001$4"), "\u0001", -1), lambda cells: X.let(
            X.strip(F.get(cells, F.lit(0))), lambda label: F.struct(
                place.alias("group_order"), label.alias("label"), eu_decimal(F.get(cells, F.lit(1)), "decimal(14,2)").alias("base_amount"),
                eu_decimal(F.get(cells, F.lit(2)), "decimal(8,4)").alias("percent"),
                (-F.abs(eu_decimal(F.get(cells, F.lit(3)), "decimal(14,2)"))).alias("discount_amount"), ascii_key(label).alias("label_key"),
            )))

    def counts(row: Column) -> Column:
        skipped = X.starts_with_any(row["label_key"], ("rabatte", "summe", "gesamt", "mwst", "unrabattierte"))
        return ~skipped & row["base_amount"].isNotNull() & row["percent"].isNotNull() & row["discount_amount"].isNotNull()

    kept = doc_text.select("document_id", F.inline(F.filter(F.transform(hits, parsed), counts)))
    return (
        kept.groupBy("document_id", "label_key", "base_amount", "percent")
        .agg(F.min("group_order").alias("group_order"), F.min_by("label", "group_order").alias("label"),
             F.min_by("discount_amount", "group_order").alias("discount_amount"))
    )


def expand_group_discounts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Replaces the collapsed discount row by one row per printed group, in its place."""
    with_groups = groups.select("document_id").distinct().withColumn("_grouped", F.lit(True))
    low = X.strip(F.lower("label_raw"))
    joined = rows.join(with_groups, "document_id", "left").withColumn("_grouped", F.coalesce("_grouped", F.lit(False)))
    kind = F.when(F.col("_grouped") & low.contains("gesamtpreis positionen"), "subtotal").otherwise(F.col("line_type"))
    joined = joined.withColumn("line_type", kind)
    collapsed = F.col("_grouped") & (F.col("line_type") == "discount") & low.startswith("rabatte")
    dropped = collapsed | (F.col("_grouped") & low.startswith("summe:"))
    places = joined.groupBy("document_id").agg(
        F.max(F.when(collapsed, F.col("sort_order"))).alias("_at"),
        F.max(F.when(~dropped & (F.col("line_type") == "subtotal"), F.col("sort_order"))).alias("_sub"),
    )
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("group_order"))
    extra = (
        groups.join(places, "document_id", "left")
        .withColumn("_rank", rank)
        .select(
            "document_id", F.lit("discount").alias("line_type"),
            F.concat_ws(" ", F.col("label"), eu_format(F.col("base_amount")),
                        F.concat(eu_format(F.col("percent")), F.lit("%")), eu_format(F.col("discount_amount"))).alias("label_raw"),
            F.col("percent").cast("decimal(8,4)").alias("percent"), "base_amount",
            F.col("discount_amount").alias("amount"),
            (F.coalesce("_at", "_sub", F.lit(0)).cast("decimal(12,2)") + F.lit("0.10").cast("decimal(3,2)")
             + F.col("_rank") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)").alias("sort_order"),
        )
    )
    kept = joined.where(~dropped).drop("_grouped").withColumn("sort_order", F.col("sort_order").cast("decimal(12,2)"))
    return kept.unionByName(extra.select(*kept.columns))


def condition_profile(amount_lines: DataFrame) -> DataFrame:
    """Per document: its percent operations in order and the sums pricing aims at.

    The operations are the printed conditions of one document, a handful of rows;
    the sums are plain aggregates with partial aggregation.
    """
    kind, order = F.col("line_type"), F.col("sort_order")
    adjusts = kind.isin("discount", "surcharge")
    heads = amount_lines.groupBy("document_id").agg(
        F.min(F.when(kind == "net_total", order)).alias("net_order"),
        F.min_by("amount", F.when(kind == "net_total", order)).alias("net_total"),
        F.min(F.when(adjusts & F.col("percent").isNotNull(), order)).alias("first_adjustment"),
        F.array_sort(F.collect_list(F.when(
            adjusts & (F.col("percent") != 0),
            F.struct(order.cast("int").alias("sort_order"), kind.alias("line_type"),
                     F.col("percent").cast("decimal(8,4)").alias("percent")),
        ))).alias("operations"),
    )
    subtotals = (
        amount_lines.where(kind == "subtotal")
        .join(heads.select("document_id", "net_order", "first_adjustment"), "document_id")
        .where("net_order is null or sort_order < net_order")
        .groupBy("document_id")
        .agg(
            F.max_by("amount", order).alias("last_subtotal"),
            F.max_by("amount", F.when(order > F.col("first_adjustment"), order)).alias("last_adjusted_subtotal"),
        )
    )
    return heads.join(subtotals, "document_id", "left").drop("net_order", "first_adjustment")
