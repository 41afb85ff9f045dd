"""Validation rules as issue tables, roll-ups and gates.

Issues are rows (document_id, item_seq, code, severity, field); everything above
them is aggregation. Nothing is stored on the documents, so a rerun is a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.keys import pricing_enabled
from offerlake.functions.numbers import check_money
from offerlake.operators.headers import provider_key

DOC_TYPES = ("angebot", "auftragsbestaetigung")

# Words and codes of the rules.
NON_VISUAL_TEXTS = ("umfang", "lieferung", "montage", "fracht", "transport", "rabatt", "skonto")
COMPLEX_WORDS = (
    "rabatt", "zuschlag", "teuerungszuschlag", "objektrabatt", "sonderrabatt", "händlerrabatt", "haendlerrabatt",
)
HEURISTIC_SUPPLIERS = ("entholzer", "rekord_vomp", "rieder", "schlotterer", "schuchter")
SOFT_ITEM_CODES = ("missing_image_assignment", "koch_detail_drawings_missing")
SOFT_CODES = (*SOFT_ITEM_CODES, "missing_customer")
FREIGHT_WORDS = ("baustellenanlieferung", "frachtkostenbeitrag", "frachkostenbeitrag", "frachtkost")
SEVERITY_RANK = {"error": 2, "warning": 1}


def _dec(value: str) -> Column:
    return F.lit(value).cast("decimal(14,2)")


def _issue(code: str, severity: str, field: str, when: Column) -> Column:
    hit = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))
    return F.when(when, hit)


def _explode_issues(df: DataFrame, keys: list[str], issues: list[Column]) -> DataFrame:
    present = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return df.select(*keys, F.inline(present))


# --- predicates ---------------------------------------------------------------------------------

def is_non_visual(items: DataFrame) -> Column:
    """Positions that never carry a drawing."""
    text = X.comparison_text(F.col("description_short"))
    number = X.comparison_text(F.col("position_no"))
    code = X.comparison_text(F.col("lv_pos"))
    price_only = F.regexp_like(text, F.lit(r"(?U)^(?:€|eur)?\s*[-+]?\d{1,3}(?:[.\s]\d{3})*(?:,\d{2})?$"))
    named = (
        text.isin(*NON_VISUAL_TEXTS) | price_only
        | X.starts_with_any(text, ("vorbemerk", "az - ", "az-", "modul ", "optional", "aufpreis ", "mehrpreis ", "xx-lief-"))
        | X.contains_any(text, ("bereits in grundposition enthalten", "lieferung auf baustelle", "lkw-kran", "lkw kran"))
        | (code == "umfang")
        | (number.isin("000", "0") & text.isin("vorbemerkungen", "vorbemerkung"))
    )
    if "image_required" in items.columns:
        return named | ~F.coalesce(F.col("image_required"), F.lit(True))
    return named


def is_informational(provider: Column) -> Column:
    """Text-only rows of a supplier that carry no price of their own."""
    text = X.comparison_text(F.col("description_short"))
    long_text = X.comparison_text(F.col("description_long"))
    code = X.comparison_text(F.col("lv_pos"))
    number = X.comparison_text(F.col("position_no"))
    no_price = F.col("unit_price").isNull() & F.col("line_total").isNull()
    summary = X.contains_any(text, ("summe-umfang", "summe-rahmen")) | X.contains_any(long_text, ("summe-umfang", "summe-rahmen"))
    dated = F.coalesce(F.col("line_total") == 0, F.lit(False)) & F.regexp_like(text, F.lit(r"^\d{2}\.\d{2}\.\d{2}$"))
    return (
        F.when(provider == "alu_one", (text == "vorbemerkungen") | text.startswith("info ") | dated)
        .when(provider == "entholzer", (code == "system") & no_price)
        .when(provider == "newo", text.startswith("diese position") | long_text.startswith("diese position"))
        .when(provider == "rekord_vomp", (code == "umfang") | summary)
        .when(provider == "schlotterer", text == "auftragsinfo")
        .when(provider == "schuchter", F.regexp_like(number, F.lit(r"^\d+[a-z]$")) & no_price)
        .otherwise(F.lit(False))
    )


def counts_in_sum(provider: Column) -> Column:
    """Whether a position belongs to the component sum."""
    text = X.comparison_text(F.col("description_short"))
    return (
        F.when(provider == "sr_schauraum", F.lit(True))
        .when((provider == "alu_one") & text.startswith("az - "), F.lit(False))
        .when(is_informational(provider), F.lit(False))
        .otherwise(~F.coalesce(F.col("is_alternative"), F.lit(False)))
    )


def is_freight_line(label: Column) -> Column:
    return X.contains_any(X.comparison_text(label), FREIGHT_WORDS)


def _net_only_offer(provider: Column, kind: Column) -> Column:
    return (
        (provider == "koch") & (kind == "angebot") & F.col("net_total").isNotNull()
        & F.col("vat_total").isNull() & F.col("gross_total").isNull()
    )


# --- document rules -----------------------------------------------------------------------------

def field_issues(documents: DataFrame) -> DataFrame:
    """Required fields are errors, recommended ones warnings; one supplier's offers may print net only."""
    return _explode_issues(documents, ["document_id"], _field_rules())


def document_issues(documents: DataFrame) -> DataFrame:
    """``field_issues`` and ``gross_issues`` in one pass."""
    return _explode_issues(documents, ["document_id"], [
        *_field_rules(), _issue("gross_mismatch", "error", "gross_total", ~_gross_matches()),
    ])


def _field_rules() -> list[Column]:
    kind = X.comparison_text(F.col("document_type"))
    net_only = _net_only_offer(provider_key(F.col("supplier_name")), kind)
    known = kind.isin(*DOC_TYPES)
    return [
        _issue("invalid_document_type", "error", "document_type", ~known),
        _issue("missing_supplier_name", "error", "supplier_name", ~X.has_text(F.col("supplier_name"))),
        _issue("missing_document_type", "error", "document_type", ~known),
        _issue("missing_document_number", "error", "document_number", ~X.has_text(F.col("document_number"))),
        _issue("missing_document_date", "error", "document_date", F.col("document_date").isNull()),
        _issue("missing_gross_total", "error", "gross_total", ~net_only & F.col("gross_total").isNull()),
        _issue("missing_customer", "warning", "customer", ~X.has_text(F.col("customer_name"))),
        _issue("missing_project_ref", "warning", "project_ref", ~X.has_text(F.col("project_ref"))),
        _issue("missing_net_total", "warning", "net_total", F.col("net_total").isNull()),
        _issue("missing_vat_total", "warning", "vat_total", ~net_only & F.col("vat_total").isNull()),
        _issue("missing_offer_reference", "warning", "offer_reference",
               (kind == "auftragsbestaetigung") & ~X.has_text(F.col("offer_reference"))),
    ]


def _expected_gross() -> Column:
    return check_money(F.col("net_total") + F.col("vat_total"))


def _gross_matches() -> Column:
    return F.abs(F.col("gross_total") - _expected_gross()) <= _dec("0.02")


def totals_check(documents: DataFrame) -> DataFrame:
    """Net plus VAT against gross, within two cents, half-even."""
    return documents.select(
        "document_id",
        _expected_gross().alias("expected_gross"),
        (F.col("gross_total") - _expected_gross()).cast("decimal(14,2)").alias("gross_delta"),
        _gross_matches().alias("gross_matches"),
    )


def gross_issues(documents: DataFrame) -> DataFrame:
    return totals_check(documents).where("not gross_matches").select(
        "document_id", F.lit("gross_mismatch").alias("code"), F.lit("error").alias("severity"),
        F.lit("gross_total").alias("field"),
    )


def component_mode(documents: DataFrame, amount_lines: DataFrame) -> DataFrame:
    """Whether the positions of a document must add up strictly or only roughly."""
    kind, label = X.comparison_text(F.col("line_type")), X.comparison_text(F.col("label_raw"))
    adjusts = kind.isin("discount", "surcharge")
    counted = amount_lines.groupBy("document_id").agg(
        F.count_if(adjusts).alias("_adjustments"),
        F.count_if(kind == "subtotal").alias("_subtotals"),
        F.count_if(~adjusts & X.contains_any(label, COMPLEX_WORDS)).alias("_embedded"),
    )
    provider = provider_key(F.col("supplier_name"))
    by_supplier = provider.isin(*HEURISTIC_SUPPLIERS)
    by_lines = (F.col("_adjustments") > 0) | (F.col("_subtotals") > 1) | (F.col("_embedded") > 0)
    return (
        documents.select("document_id", "supplier_name")
        .join(counted, "document_id", "left")
        .select(
            "document_id", provider.alias("provider_key"),
            F.when(by_supplier | F.coalesce(by_lines, F.lit(False)), "heuristic").otherwise("strict").alias("mode"),
            F.when(by_supplier, "provider_complex_pricing")
            .when(F.coalesce(by_lines, F.lit(False)), "complex_pricing_breakdown").alias("reason"),
        )
    )


# --- positions ----------------------------------------------------------------------------------

def item_issues(items: DataFrame, modes: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """Ten rules per position. ``modes`` gives provider_key and mode per document."""
    return _explode_issues(_with_modes(items, modes, page_counts), ["document_id", "item_seq"], _item_rules())


def _with_modes(items: DataFrame, modes: DataFrame, page_counts: DataFrame | None) -> DataFrame:
    joined = items.join(modes.select("document_id", "provider_key", "mode"), "document_id", "left")
    if page_counts is None:
        joined = joined.withColumn("page_count", F.lit(None).cast("int"))
    else:
        joined = joined.join(page_counts.select("document_id", "page_count"), "document_id", "left")
    provider = F.coalesce(F.col("provider_key"), F.lit("generic"))
    return joined.withColumn("_info", is_informational(provider))


def _item_rules() -> list[Column]:
    provider = F.coalesce(F.col("provider_key"), F.lit("generic"))
    info, alternative = F.col("_info"), F.coalesce(F.col("is_alternative"), F.lit(False))
    quantity, unit, total, page = (F.col(c) for c in ("quantity", "unit_price", "line_total", "page_ref"))
    expected = check_money(quantity * unit)
    return [
        _issue("missing_position_no", "error", "position_no", ~X.has_text(F.col("position_no"))),
        _issue("missing_description_short", "warning", "description_short",
               ~X.has_text(F.col("description_short")) & ~info & ~X.has_text(F.col("description_long"))),
        _issue("missing_quantity", "warning", "quantity", quantity.isNull()),
        _issue("non_positive_quantity", "warning", "quantity", (quantity <= 0) & ~alternative & ~info),
        _issue("missing_unit_price", "warning", "unit_price", unit.isNull() & ~info),
        _issue("missing_line_total", "error", "line_total", total.isNull() & ~alternative & ~info),
        _issue("zero_line_total", "warning", "line_total", (total == 0) & ~alternative & ~info),
        _issue("missing_page_ref", "warning", "page_ref", page.isNull()),
        _issue("invalid_page_ref", "error", "page_ref",
               F.col("page_count").isNotNull() & ((page < 1) | (page > F.col("page_count")))),
        _issue("line_total_mismatch", "warning", "line_total",
               (F.col("mode") == "strict") & ~info & (provider != "schachermayer")
               & (F.abs(total - expected) > _dec("0.02"))),
    ]


def image_issues(items: DataFrame, images: DataFrame, modes: DataFrame, enforce: bool = True) -> DataFrame:
    """Missing drawings and drawings that lie before the page of their position.

    ``items`` carries image_ids, image_auto_match_allowed and image_assignment_source;
    a package document is exempt from the page rule.
    """
    provider = F.coalesce(F.col("provider_key"), F.lit("generic"))
    joined = items.join(modes.select("document_id", "provider_key"), "document_id", "left")
    visual = ~is_non_visual(items) & ~is_informational(provider)
    allowed = F.coalesce(F.col("image_auto_match_allowed"), F.lit(True))
    base = joined.select(
        "document_id", "item_seq", "page_ref", "image_ids", "image_assignment_source", (visual & allowed).alias("_wants")
    )
    if not enforce:
        with_images = images.select("document_id").distinct().withColumn("_any", F.lit(True))
        base = base.join(with_images, "document_id", "left").withColumn(
            "_wants", F.col("_wants") & F.coalesce("_any", F.lit(False))
        )
    missing = base.where(F.col("_wants") & (F.coalesce(F.size("image_ids"), F.lit(0)) < 1)).select(
        "document_id", "item_seq", F.lit("missing_image_assignment").alias("code"),
        F.lit("warning").alias("severity"), F.lit("image_ids").alias("field"),
    )
    assigned = base.where(F.coalesce("image_assignment_source", F.lit("")) != "document_package").select(
        "document_id", "item_seq", "page_ref", F.explode(F.array_distinct("image_ids")).alias("image_id")
    )
    early = (
        assigned.join(images.select("document_id", "image_id", F.col("page_ref").alias("image_page")), ["document_id", "image_id"])
        .where("image_page < page_ref")
        .groupBy("document_id", "item_seq")
        .agg(F.min("image_page").alias("first_page"))
        .select("document_id", "item_seq", F.lit("image_before_item_page").alias("code"),
                F.lit("warning").alias("severity"), F.lit("image_ids").alias("field"))
    )
    return missing.unionByName(early)


def duplicate_images(items: DataFrame) -> DataFrame:
    """Images that two or more different positions of a document use."""
    used = items.where(X.has_text(F.col("position_no"))).select(
        "document_id", X.strip(F.col("position_no")).alias("position_no"), F.explode("image_ids").alias("image_id")
    )
    return used.groupBy("document_id", "image_id").agg(
        F.countDistinct("position_no").alias("positions")
    ).where("positions > 1")


def duplicate_image_issues(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document issues, item issues) of images in double use."""
    doubled = duplicate_images(items)
    tail = [F.lit("error").alias("severity"), F.lit("image_ids").alias("field")]
    per_document = doubled.select("document_id").distinct().select(
        "document_id", F.lit("duplicate_image_assignments").alias("code"), *tail
    )
    used = items.select("document_id", "item_seq", F.explode("image_ids").alias("image_id"))
    per_item = used.join(doubled, ["document_id", "image_id"], "left_semi").select("document_id", "item_seq").distinct()
    return per_document, per_item.select(
        "document_id", "item_seq", F.lit("duplicate_image_assignment").alias("code"), *tail
    )


def position_issues(items: DataFrame, images: DataFrame, modes: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """``item_issues``, ``image_issues`` and ``duplicate_image_issues`` with ``resolved``.

    A position is read once for its rules and once for its drawings and brings its own review mark, so
    ``item_seq`` must be its own; issues of a whole document have none.
    """
    keys = ["document_id", "item_seq"]
    checked = F.coalesce(F.col("review_checked"), F.lit(False))
    wants = ~is_non_visual(items) & ~F.col("_info") & F.coalesce(F.col("image_auto_match_allowed"), F.lit(True))
    # the texts are looked at only where no drawing is
    missing = _issue("missing_image_assignment", "warning", "image_ids", (F.coalesce(F.size("image_ids"), F.lit(0)) < 1) & wants)
    joined = _with_modes(items, modes, page_counts).withColumn("_checked", checked)
    ruled = _explode_issues(joined, [*keys, "_checked"], [*_item_rules(), missing])

    uses = items.select(
        *keys, checked.alias("_checked"), "page_ref",
        (F.coalesce("image_assignment_source", F.lit("")) != "document_package").alias("_paged"),
        F.when(X.has_text(F.col("position_no")), X.strip(F.col("position_no"))).alias("_position"),
        F.explode(F.array_distinct("image_ids")).alias("image_id"), F.lit(True).alias("_used"),
    )
    pages = images.select("document_id", "image_id", F.col("page_ref").alias("_image_page"))
    image = Window.partitionBy("document_id", "image_id")
    marked = uses.unionByName(pages, allowMissingColumns=True).withColumns({
        "_first": F.min("_image_page").over(image),
        "_doubled": F.min("_position").over(image) != F.max("_position").over(image),
    }).where("_used")
    known = F.col("document_id").isNotNull() & F.col("image_id").isNotNull()
    early = known & F.col("_paged") & (F.col("_first") < F.col("page_ref"))

    def found(seq: Column, code: str, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(seq.alias("item_seq"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    nowhere = F.lit(None).cast(items.schema["item_seq"].dataType)
    drawn = F.filter(F.array(
        found(F.col("item_seq"), "image_before_item_page", "warning", early),
        found(F.col("item_seq"), "duplicate_image_assignment", "error", known & F.col("_doubled")),
        found(nowhere, "duplicate_image_assignments", "error", F.col("_doubled")),
    ), lambda i: i.isNotNull())
    drawn = marked.where(early | F.col("_doubled")).select("document_id", "_checked", F.inline(drawn))
    drawn = drawn.groupBy(*keys, "code", "severity").agg(F.max("_checked").alias("_checked")).withColumn("field", F.lit("image_ids"))
    resolved = F.col("_checked") & F.col("item_seq").isNotNull() & (F.col("severity") == "warning")
    return ruled.unionByName(drawn).withColumn("resolved", resolved).drop("_checked")


def missing_drawings(documents: DataFrame, items: DataFrame, images: DataFrame) -> DataFrame:
    """Door supplier documents with positions but without a single drawing."""
    kind = X.comparison_text(F.col("document_type"))
    doors = documents.where((provider_key(F.col("supplier_name")) == "koch") & kind.isin(*DOC_TYPES))
    return (
        doors.join(items.select("document_id"), "document_id", "left_semi")
        .join(images.select("document_id"), "document_id", "left_anti")
        .select("document_id", F.lit("koch_detail_drawings_missing").alias("code"),
                F.lit("warning").alias("severity"), F.lit("images").alias("field"))
    )


# --- sums ---------------------------------------------------------------------------------------

def delivery_totals(items: DataFrame, amount_lines: DataFrame) -> DataFrame:
    """Freight of a document: from positions, as reconstructed by the parser, as printed.

    Among the printed rows one that exceeds its own base amount is an aggregate and wins.
    """
    block = F.coalesce(F.col("pricing_source") == "delivery_block", F.lit(False))
    from_items = items.where(block).groupBy("document_id").agg(
        F.sum("line_total").alias("position_total"),
        F.min_by("printed_total", F.when(F.col("printed_total").isNotNull(), F.col("item_seq"))).alias("parser_total"),
    )
    freight = amount_lines.where((X.comparison_text(F.col("line_type")) == "surcharge") & is_freight_line(F.col("label_raw")))
    printed = freight.groupBy("document_id").agg(
        F.max(F.when(F.col("amount") > F.col("base_amount"), F.col("amount"))).alias("_aggregate"),
        F.sum("amount").alias("_sum"),
    ).select(
        "document_id", F.coalesce("_aggregate", F.when(F.col("_sum") > 0, F.col("_sum"))).alias("printed_total")
    )
    both = from_items.join(printed, "document_id", "full_outer")
    position = F.coalesce("position_total", _dec("0.00"))
    return both.select(
        "document_id", check_money(position).alias("position_total"), check_money(F.col("parser_total")).alias("parser_total"),
        check_money(F.col("printed_total")).alias("printed_total"),
        check_money(F.coalesce("parser_total", "printed_total", position)).alias("delivery_total"),
    )


def sequence_check(amount_lines: DataFrame) -> DataFrame:
    """Recomputes every printed condition from the last printed subtotal.

    Order-dependent: a printed subtotal resets the base of the next step. The amount
    rows of one document are a short list, folded inside the row.
    """
    row = F.struct(
        F.col("sort_order").cast("int").alias("at"), X.comparison_text(F.col("line_type")).alias("kind"),
        F.col("percent").cast("decimal(8,4)").alias("percent"), F.col("amount").cast("decimal(14,2)").alias("amount"),
    )
    listed = amount_lines.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    listed = listed.withColumn("subtotals", F.filter("rows", lambda r: r["kind"] == "subtotal"))
    listed = listed.where((F.size("subtotals") > 0) & F.get("subtotals", F.lit(0))["amount"].isNotNull())
    cut = X.first_true(F.transform("rows", lambda r: r["kind"] == "net_total"))
    open_rows = F.when(cut > 0, F.slice("rows", F.lit(1), cut - 1)).otherwise(F.col("rows"))
    steps = F.filter(open_rows, lambda r: r["kind"].isin("discount", "surcharge") & r["percent"].isNotNull())
    listed = listed.withColumn("steps", steps)
    start = F.struct(
        F.get("subtotals", F.lit(0))["amount"].alias("current"),
        F.get("subtotals", F.lit(0))["at"].alias("taken"),
        F.lit(0).alias("amount_misses"), F.lit(0).alias("subtotal_misses"),
    )

    def step(state: Column, op: Column) -> Column:
        sign = F.when(op["kind"] == "surcharge", F.lit(1)).otherwise(F.lit(-1))
        amount = (check_money(state["current"] * op["percent"] / F.lit(100)) * sign).cast("decimal(14,2)")
        subtotal = check_money(state["current"] + amount)
        later = F.filter(F.col("subtotals"), lambda s: s["at"] > F.greatest(state["taken"], op["at"]))
        printed = F.get(later, F.lit(0))
        miss_amount = ~F.coalesce(F.abs(op["amount"] - amount) <= _dec("0.02"), F.lit(False))
        miss_subtotal = ~F.coalesce(F.abs(printed["amount"] - subtotal) <= _dec("0.02"), F.lit(False))
        # without a later subtotal the list is used up for all following steps
        return F.struct(
            F.coalesce(printed["amount"], subtotal).cast("decimal(14,2)").alias("current"),
            F.coalesce(printed["at"], F.lit(2147483647)).alias("taken"),
            (state["amount_misses"] + miss_amount.cast("int")).alias("amount_misses"),
            (state["subtotal_misses"] + miss_subtotal.cast("int")).alias("subtotal_misses"),
        )

    folded = listed.withColumn("_end", F.aggregate("steps", start, step))
    return folded.select(
        "document_id",
        F.get("subtotals", F.lit(0))["amount"].alias("initial_subtotal"),
        F.col("_end")["current"].alias("last_subtotal"),
        F.size("steps").alias("step_count"),
        ((F.col("_end")["amount_misses"] == 0) & (F.col("_end")["subtotal_misses"] == 0)).alias("sequence_matches"),
    )


def component_sums(documents: DataFrame, items: DataFrame, amount_lines: DataFrame) -> DataFrame:
    """Net computed from the positions in the variant that fits the document.

    ``items`` carries pricing_applied, pricing_disabled, pricing_source and printed_total.
    """
    modes = component_mode(documents, amount_lines)
    flags = documents.select("document_id", "net_total", pricing_enabled(F.col("apply_pricing_adjustments")).alias("on"))
    provider = F.coalesce(F.col("provider_key"), F.lit("generic"))
    joined = items.join(modes, "document_id")
    counted = counts_in_sum(provider)
    included = F.coalesce(F.col("pricing_applied"), F.lit(False)) & ~F.coalesce(F.col("pricing_disabled"), F.lit(False))
    per_document = joined.groupBy("document_id").agg(
        F.sum(F.when(~F.col("is_alternative"), F.col("line_total"))).alias("main_sum"),
        F.sum(F.when(counted, F.col("line_total"))).alias("component_sum"),
        F.max(F.coalesce(counted & F.col("line_total").isNotNull() & included, F.lit(False))).alias("adjusted"),
        F.count("*").alias("position_count"),
    )
    kind = X.comparison_text(F.col("line_type"))
    adjustments = amount_lines.groupBy("document_id").agg(
        F.sum(F.when(kind == "discount", F.col("amount"))).alias("discount_sum"),
        F.sum(F.when(kind == "surcharge", F.col("amount"))).alias("surcharge_sum"),
    )
    zero = _dec("0.00")
    merged = (
        flags.join(modes, "document_id").join(per_document, "document_id", "left").join(adjustments, "document_id", "left")
        .join(sequence_check(amount_lines), "document_id", "left")
        .join(delivery_totals(items, amount_lines), "document_id", "left")
        .fillna(False, ["adjusted"])
        .withColumns({
            c: F.coalesce(F.col(c), zero) for c in ("main_sum", "component_sum", "discount_sum", "surcharge_sum")
        })
    )
    rieder = F.col("provider_key") == "rieder"
    by_sequence = rieder & F.col("on") & F.col("last_subtotal").isNotNull()
    delivery = F.coalesce("delivery_total", zero)
    variant = (
        F.when(by_sequence, "rieder_sequence")
        .when(~F.col("on"), F.when(rieder, "rieder_adjustments_disabled").otherwise("pricing_adjustments_disabled"))
        .when(F.col("adjusted"), F.concat(F.col("provider_key"), F.lit("_adjusted_positions")))
        .otherwise(F.col("mode"))
    )
    computed = (
        F.when(by_sequence, check_money(F.col("last_subtotal") + delivery))
        .when(~F.col("on") | F.col("adjusted"), check_money(F.col("component_sum")))
        .otherwise(check_money(F.col("component_sum") + F.col("discount_sum") + F.col("surcharge_sum")))
    )
    return merged.select(
        "document_id", "provider_key", variant.alias("component_check_mode"), computed.alias("computed_net"), "net_total",
        F.coalesce("position_count", F.lit(0)).alias("position_count"), check_money(F.col("main_sum")).alias("main_sum"),
        check_money(F.col("component_sum")).alias("component_sum"),
        (F.abs(F.col("net_total") - computed) <= _dec("0.02")).alias("matches_net"),
        by_sequence.alias("by_sequence"), F.col("sequence_matches"),
        F.coalesce(F.col("position_total") > 0, F.lit(False)).alias("delivery_present"),
    )


def component_issues(sums: DataFrame) -> DataFrame:
    """Net mismatch of strict documents and of printed condition sequences."""
    strict = (
        F.col("net_total").isNotNull() & (F.col("position_count") > 0)
        & (F.col("component_check_mode") == "strict") & ~F.col("matches_net")
    )
    sequence = F.col("net_total").isNotNull() & F.col("by_sequence") & (
        ~F.col("sequence_matches") | ~F.col("delivery_present") | ~F.col("matches_net")
    )
    return _explode_issues(sums, ["document_id"], [
        _issue("net_component_mismatch", "warning", "net_total", strict),
        _issue("rieder_pricing_sequence_mismatch", "warning", "net_total", sequence),
    ])


# --- roll-up ------------------------------------------------------------------------------------

def status_of(errors: Column, warnings: Column, resolved: Column) -> Column:
    return (
        F.when(errors > 0, "reject").when(warnings > 0, "review")
        .when(resolved > 0, "manual_checked").otherwise("auto_accept")
    )


def resolve_reviewed(issues: DataFrame, items: DataFrame) -> DataFrame:
    """A checked position resolves its warnings, never its errors."""
    checked = items.where(F.coalesce(F.col("review_checked"), F.lit(False))).select("document_id", "item_seq").distinct()
    joined = issues.join(checked.withColumn("_checked", F.lit(True)), ["document_id", "item_seq"], "left")
    resolved = F.coalesce(F.col("_checked"), F.lit(False)) & (F.col("severity") == "warning")
    return joined.withColumn("resolved", resolved).drop("_checked")


def item_status(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Status and open counts per position; ``issues`` carries ``resolved``."""
    counted = issues.groupBy("document_id", "item_seq").agg(
        F.count_if(~F.col("resolved") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~F.col("resolved") & (F.col("severity") == "warning")).alias("warnings"),
        F.count_if(F.col("resolved")).alias("resolved"),
    )
    joined = items.select("document_id", "item_seq").join(counted, ["document_id", "item_seq"], "left").fillna(0)
    return joined.withColumn("status", status_of(F.col("errors"), F.col("warnings"), F.col("resolved")))


def document_status(documents: DataFrame, document_issues: DataFrame, issues: DataFrame) -> DataFrame:
    """reject, review, manual_checked or auto_accept per document.

    Soft codes stay visible as warnings but do not block; the list differs between
    positions and documents.
    """
    soft_item = F.col("code").isin(*SOFT_ITEM_CODES)
    soft_document = F.col("code").isin(*SOFT_CODES)
    stacked = document_issues.select(
        "document_id", "severity", soft_document.alias("soft"), F.lit(False).alias("resolved")
    ).unionByName(issues.select("document_id", "severity", soft_item.alias("soft"), "resolved"))
    open_ = ~F.col("resolved")
    counted = stacked.groupBy("document_id").agg(
        F.count_if(open_ & (F.col("severity") == "error")).alias("error_count"),
        F.count_if(open_ & (F.col("severity") == "warning")).alias("warning_count"),
        F.count_if(open_ & (F.col("severity") == "warning") & F.col("soft")).alias("soft_count"),
        F.count_if(F.col("resolved")).alias("resolved_count"),
    )
    joined = documents.select("document_id").join(counted, "document_id", "left").fillna(0)
    blocking = F.col("warning_count") - F.col("soft_count")
    return joined.withColumn(
        "status", status_of(F.col("error_count"), blocking, F.col("resolved_count") + F.col("soft_count"))
    )


def confidence_policy(confidence: Column) -> Column:
    """Diagnostic only."""
    return (
        F.when(confidence.isNull(), "unknown").when(confidence >= _dec("0.85"), "auto_accept")
        .when(confidence >= _dec("0.60"), "review").otherwise("reject")
    )


# --- gates --------------------------------------------------------------------------------------

def approval_gate(documents: DataFrame, statuses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approvals that go through, with their note, and those that do not, with the reason.

    ``decisions``: document_id, override, note.
    """
    joined = (
        decisions.join(documents.select("document_id", F.col("status").alias("processing")), "document_id")
        .join(statuses.select("document_id", F.col("status").alias("validation")), "document_id", "left")
        .withColumn("validation", F.coalesce("validation", F.lit("unknown")))
    )
    blocked = ~F.col("validation").isin("auto_accept", "manual_checked")
    reason = (
        F.when(F.lower("processing") != "processed", "not_processed")
        .when(blocked & ~F.col("override"), "blocked_by_validation")
    )
    forced = reason.isNull() & blocked & F.col("override")
    marker = F.concat(F.lit("⚠️ Freigabe trotz Blocker erzwungen (Status: "), F.col("validation"), F.lit(")."))
    note = X.clean_optional(F.col("note"))
    return joined.select(
        "document_id", "validation", reason.isNull().alias("approved"), reason.alias("reason"), forced.alias("forced"),
        F.when(reason.isNull(), F.when(forced, F.concat_ws(" ", marker, note)).otherwise(note)).alias("approval_note"),
    )


def export_gate(documents: DataFrame, content_errors: DataFrame, override: bool = False) -> DataFrame:
    """Live export: technical conditions are hard, content errors can be overridden."""
    errors = content_errors.groupBy("document_id").agg(F.count("*").alias("content_errors"))
    joined = documents.select("document_id", "status", "approval_status").join(errors, "document_id", "left").fillna(0, ["content_errors"])
    hard = F.filter(
        F.array(
            F.when(F.lower("status") != "processed", F.lit("document_not_processed")),
            F.when(F.lower("approval_status") != "approved", F.lit("document_not_approved")),
        ),
        lambda code: code.isNotNull(),
    )
    joined = joined.withColumn("hard", hard)
    content_blocks = (F.col("content_errors") > 0) & F.lit(not override)
    return joined.select(
        "document_id",
        (~((F.size("hard") > 0) | content_blocks)).alias("may_export"),
        F.array_join("hard", ",").alias("preconditions"),
        "content_errors",
        ((F.size("hard") == 0) & (F.col("content_errors") > 0) & F.lit(override)).alias("override_used"),
    )


def required_export_issues(df: DataFrame, required: tuple[str, ...], scope: str, keys: list[str]) -> DataFrame:
    """One row per required field that is null or empty."""
    issues = [
        F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.struct(F.lit("missing_required_field").alias("code"), F.lit(c).alias("field")))
        for c in required
    ]
    present = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return df.select(*keys, F.lit(scope).alias("scope"), F.inline(present))


def documents_without_positions(documents: DataFrame, positions: DataFrame) -> DataFrame:
    return documents.select("document_id").join(positions.select("document_id"), "document_id", "left_anti").select(
        "document_id", F.lit("positions").alias("scope"), F.lit("no_positions").alias("code"), F.lit(None).cast("string").alias("field")
    )
