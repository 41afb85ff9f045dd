"""Purchase prices from chains of discounts and surcharges.

Items carry ``document_id, item_seq, is_alternative, quantity, unit_price,
line_total``; conditions come as one profile row per document (amounts.py).
All steps of one document share one exchange on ``document_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.operators.windows import per_document
from offerlake.functions.keys import ascii_key, pricing_enabled
from offerlake.functions.numbers import eu_decimal, money, unit_from_total
from offerlake.rules.suppliers import CHAIN_SUPPLIERS

CHAIN_VALUE = "decimal(30,16)"
FACTOR = "decimal(7,6)"
DELTA_LIMIT = "0.10"
GROUP_DELTA_LIMIT = "0.25"
NO_OPERATIONS = "array<struct<sort_order:int,line_type:string,percent:decimal(8,4)>>"
EXPORT_SENTINEL = 999999.0


def factor(line_type: Column, percent: Column) -> Column:
    share = (percent / F.lit(100)).cast(FACTOR)
    one = F.lit(1).cast(FACTOR)
    return F.when(line_type == "surcharge", one + share).otherwise(one - share).cast(FACTOR)


def apply_chain(price: Column, operations: Column) -> Column:
    """All percents in order on a price, rounded once at the end."""
    chained = F.aggregate(
        operations,
        price.cast(CHAIN_VALUE),
        lambda value, op: (value * factor(op["line_type"], op["percent"])).cast(CHAIN_VALUE),
    )
    return money(chained)


def is_site_delivery(items: DataFrame) -> Column:
    """Unrebated freight positions of one supplier: small and named as site delivery."""
    fields = ["position_no", "lv_pos", "description_short", "description_long"]
    words = F.lower(F.concat_ws(" ", *[F.col(c) for c in fields if c in items.columns]))
    named = words.contains("xx-lief-baus") | (words.contains("lieferung") & words.contains("baustelle"))
    return named & (F.col("line_total") <= F.lit("300.01").cast("decimal(14,2)"))


def is_unrebated(items: DataFrame) -> Column:
    """Information and packaging rows that no group discount touches."""
    fields = ["position_no", "lv_pos", "description_short"]
    words = F.lower(F.concat_ws(" ", *[F.col(c) for c in fields if c in items.columns]))
    # plain searches, as an alternation tries every word at every sign
    return words.contains("auftragsinfo") | words.contains("verpackungsbeitrag") | words.contains("web erfasser")


def takes_discount(items: DataFrame) -> Column:
    return F.col("line_total").isNotNull() & ~is_unrebated(items)


def _with_result(items: DataFrame, applied: Column, total: Column, unit: Column, source: Column) -> DataFrame:
    """Sets the new prices and keeps the old ones beside them."""
    return items.select(
        *[F.col(c) for c in items.columns if c not in ("line_total", "unit_price")],
        F.when(applied, F.col("line_total")).alias("original_line_total"),
        F.when(applied, F.col("unit_price")).alias("original_unit_price"),
        total.cast("decimal(14,2)").alias("line_total"),
        unit.cast("decimal(14,2)").alias("unit_price"),
        applied.alias("pricing_applied"),
        F.when(applied, source).alias("pricing_adjustment_source"),
    )


def _settle_delta(priced: DataFrame, target: Column, in_sum: Column, candidate: Column, limit: str) -> DataFrame:
    """Puts the cent difference between printed and computed sum on the last candidate."""
    current = F.coalesce(F.sum(F.when(in_sum, F.col("line_total"))).over(per_document()), F.lit(0))
    delta = money(target - current)
    last = F.coalesce(
        F.max(F.when(candidate, F.col("item_seq"))).over(per_document()),
        F.max(F.when(in_sum, F.col("item_seq"))).over(per_document()),
    )
    settled = priced.withColumns({"_delta": delta, "_last": last})
    hit = F.coalesce(
        (F.col("item_seq") == F.col("_last"))
        & (F.col("_delta") != 0)
        & (F.abs(F.col("_delta")) <= F.lit(limit).cast("decimal(14,2)")),
        F.lit(False),
    )
    total = F.when(hit, money(F.col("line_total") + F.col("_delta"))).otherwise(F.col("line_total"))
    settled = settled.withColumns({
        "rounding_delta": F.when(hit, F.col("_delta")),
        "line_total": total,
    })
    unit = F.when(F.col("rounding_delta").isNotNull(), unit_from_total(F.col("line_total"), F.col("quantity")))
    return settled.withColumn("unit_price", F.coalesce(unit, F.col("unit_price"))).drop("_delta", "_last")


def price_by_chain(items: DataFrame, profile: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Percent chains of all chain suppliers in one pass.

    The suppliers differ in the printed sum they must meet and in which rows stay
    out: a freight block row counts nowhere, a small site delivery row keeps its
    price but counts towards the sum.
    """
    joined = (
        items.join(suppliers.select("document_id", "provider_key"), "document_id", "left")
        .join(
            profile.select("document_id", "operations", "last_subtotal", "last_adjusted_subtotal", "net_total"),
            "document_id", "left",
        )
    )
    provider = F.col("provider_key")
    operations = F.coalesce(F.col("operations"), F.array().cast(NO_OPERATIONS))
    joined = joined.withColumn("operations", operations)
    chained = provider.isin(*CHAIN_SUPPLIERS) & (F.size("operations") > 0) & F.col("line_total").isNotNull()
    source = F.col("pricing_source") if "pricing_source" in items.columns else F.lit(None).cast("string")
    freight_block = F.coalesce((provider == "rieder") & (source == "delivery_block"), F.lit(False))
    site_delivery = F.coalesce((provider == "rekord_vomp") & is_site_delivery(items), F.lit(False))
    joined = joined.withColumns({
        "_chained": F.coalesce(chained, F.lit(False)),
        "_block": freight_block,
        "_site": site_delivery,
    })
    applied = F.col("_chained") & ~F.col("_block") & ~F.col("_site")
    total = F.when(applied, apply_chain(F.col("line_total"), F.col("operations"))).otherwise(F.col("line_total"))
    unit = F.when(applied, unit_from_total(total, F.col("quantity"))).otherwise(F.col("unit_price"))
    priced = _with_result(joined, applied, total, unit, F.concat(provider, F.lit("_amount_lines")))
    target = (
        F.when(provider == "rieder", F.col("last_subtotal"))
        .when(provider == "entholzer", F.col("last_adjusted_subtotal"))
        .otherwise(F.col("net_total"))
    )
    main = ~F.col("is_alternative")
    in_sum = F.col("_chained") & ~F.col("_block") & main
    candidate = F.col("pricing_applied") & main
    settled = _settle_delta(priced, target, in_sum, candidate, DELTA_LIMIT)
    return settled.drop("_chained", "_block", "_site", "last_subtotal", "last_adjusted_subtotal", "net_total")


def price_by_line_discount(items: DataFrame) -> DataFrame:
    """Discount inferred per row where quantity times price exceeds the printed total."""
    full = money(F.col("unit_price") * F.col("quantity"))
    applied = F.coalesce(
        (F.col("quantity") != 0) & (full > 0)
        & (F.abs(full - F.col("line_total")) > F.lit("0.01").cast("decimal(14,2)")),
        F.lit(False),
    )
    unit = F.when(applied, money(F.col("line_total") / F.nullif(F.col("quantity"), F.lit(0)))).otherwise(F.col("unit_price"))
    share = F.lit(1) - F.col("line_total") / F.nullif(full, F.lit(0))
    return items.select(
        *[F.col(c) for c in items.columns if c not in ("unit_price",)],
        F.when(applied, full).alias("original_line_total"),
        F.when(applied, F.col("unit_price")).alias("original_unit_price"),
        unit.alias("unit_price"),
        applied.alias("pricing_applied"),
        F.when(applied, F.lit("schachermayer_line_discount")).alias("pricing_adjustment_source"),
        F.when(applied, money(share * 100)).alias("discount_percent"),
    )


def group_key(label: Column) -> Column:
    """Discount group of a printed group label."""
    key = ascii_key(label)
    return (
        F.when(key.contains("motor"), "motor")
        .when((key == "igi") | key.startswith("igi "), "igi")
        .when(key.contains("zubehoer") | key.contains("panzer"), "panzer")
        .otherwise(key)
    )


def row_group(text: Column, keys: Column) -> Column:
    """Discount group of a position by the key of its text: two special words first, then the
    first group whose name equals, opens or is opened by the text."""
    named = F.filter(
        keys,
        lambda key: ~key.isin("motor", "igi", "panzer")
        & ((text == key) | text.startswith(F.concat(key, F.lit(" "))) | key.startswith(F.concat(text, F.lit(" ")))),
    )
    return (
        F.when(text == "", None)
        .when(F.array_contains(keys, "igi") & text.startswith("igi"), "igi")
        .when(F.array_contains(keys, "panzer")
              & (text.contains("panzer") | text.contains("artikel mit bearbeitung")), "panzer")
        .otherwise(F.get(named, F.lit(0)))
    )


def document_groups(groups: DataFrame) -> DataFrame:
    """One row per document: group names in printed order and the last percent per name."""
    per_key = groups.groupBy("document_id", "key").agg(
        F.min("group_order").alias("first_order"), F.max_by("percent", "group_order").alias("percent")
    )
    listed = per_key.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("first_order", "key", "percent"))).alias("groups")
    )
    return listed.select(
        "document_id",
        F.transform("groups", lambda g: g["key"]).alias("group_keys"),
        F.map_from_entries(F.transform("groups", lambda g: F.struct(g["key"], g["percent"]))).alias("group_percents"),
    )


def motor_share(components: Column, quantity: Column) -> Column:
    """Sum of the motor components of a position times its quantity."""
    amounts = F.transform(
        F.filter(components, lambda c: ascii_key(c["label"]).contains("motor")),
        lambda c: F.coalesce(eu_decimal(c["amount_raw"], "decimal(14,2)"), F.lit(0).cast("decimal(14,2)")),
    )
    total = F.aggregate(amounts, F.lit(0).cast("decimal(18,2)"), lambda a, b: (a + b).cast("decimal(18,2)"))
    times = F.when(quantity != 0, quantity).otherwise(F.lit(1)).cast("decimal(14,4)")
    return F.coalesce(money(total * F.coalesce(times, F.lit(1))), F.lit(0).cast("decimal(14,2)"))


def price_by_groups(items: DataFrame, profile: DataFrame, groups: DataFrame) -> DataFrame:
    """Discounts per product group; per document all or nothing."""
    offered = group_offers(items, groups).join(profile.select("document_id", "net_total"), "document_id", "left")
    return accept_groups(offered).drop("net_total", "offer_open")


def group_offers(items: DataFrame, groups: DataFrame) -> DataFrame:
    """What every position costs by its group, whatever net is printed: ``offer_open`` to a discount,
    ``offer_applied``, ``offer_total`` and, per document, ``offer_changes`` a main position and ``offer_sum`` of the main positions."""
    # a column of its own, as the names of the groups are tried against it one by one
    keyed = items.withColumn("_text", ascii_key(F.col("description_short")))
    joined = keyed.join(document_groups(groups), "document_id", "left").withColumn(
        "offer_open", takes_discount(items)
    )
    percent_type = "decimal(8,4)"
    group = F.when(F.col("offer_open"), row_group(F.col("_text"), F.col("group_keys")))
    joined = joined.withColumn("_group", group)
    zero = F.lit(0).cast("decimal(14,2)")
    motor_percent = F.try_element_at("group_percents", F.lit("motor")).cast(percent_type)
    motor = F.when(
        motor_percent.isNotNull() & F.col("_group").isNotNull(),
        motor_share(F.col("components"), F.col("quantity")),
    ).otherwise(zero)
    joined = joined.withColumn("_motor0", motor).withColumn(
        "_motor",
        F.when((F.col("_motor0") > 0) & (F.col("_motor0") <= F.col("line_total") + F.lit("0.01").cast("decimal(14,2)")),
               F.col("_motor0")).otherwise(zero),
    )
    rest = F.when(F.col("_motor") > 0, money(F.col("line_total") - F.col("_motor"))).otherwise(F.col("line_total"))
    joined = joined.withColumn("_rest", rest)
    own_percent = F.try_element_at("group_percents", F.col("_group")).cast(percent_type)
    motor_leg = F.when(F.col("_motor") > 0, money(F.col("_motor") * factor(F.lit("discount"), motor_percent))).otherwise(zero)
    own_leg = F.when(F.col("_rest") > 0, money(F.col("_rest") * factor(F.lit("discount"), own_percent))).otherwise(zero)
    applied = F.coalesce(
        F.col("_group").isNotNull() & ((F.col("_motor") > 0) | (F.col("_rest") > 0)), F.lit(False)
    )
    joined = joined.withColumn("offer_applied", applied)
    new_total = F.when(F.col("offer_applied"), money(motor_leg + own_leg)).otherwise(F.col("line_total"))
    priced = joined.withColumn("offer_total", new_total).select(*items.columns, "offer_open", "offer_applied", "offer_total")
    main = ~F.col("is_alternative")
    return priced.withColumns({
        "offer_changes": F.max(F.when(main, F.col("offer_applied")).otherwise(F.lit(False))).over(per_document()),
        "offer_sum": F.sum(F.when(main, F.col("offer_total"))).over(per_document()),
    })


def accept_groups(offered: DataFrame) -> DataFrame:
    """Takes the offers of ``group_offers`` where a document's printed ``net_total`` allows them."""
    delta = money(F.col("net_total") - F.col("offer_sum"))
    accept = F.col("offer_changes") & (
        F.col("net_total").isNull() | (F.abs(delta) <= F.lit(GROUP_DELTA_LIMIT).cast("decimal(14,2)"))
    )
    joined = offered.withColumn("groups_accepted", F.coalesce(accept, F.lit(False)))
    take = F.col("groups_accepted") & F.col("offer_applied")
    total = F.when(take, F.col("offer_total")).otherwise(F.col("line_total"))
    unit = F.when(take, unit_from_total(total, F.col("quantity"))).otherwise(F.col("unit_price"))
    priced = _with_result(joined, take, total, unit, F.lit("schlotterer_discount_groups"))
    settled = _settle_delta(
        priced,
        F.when(F.col("groups_accepted"), F.col("net_total")),
        ~F.col("is_alternative"),
        F.col("pricing_applied") & ~F.col("is_alternative"),
        GROUP_DELTA_LIMIT,
    )
    return settled.drop("offer_applied", "offer_total", "offer_changes", "offer_sum")


def exact_share(amount: Column, goal: Column, whole: Column) -> Column:
    """amount * goal / whole in cents, half up; a quotient cut to some digits would miss half cents."""
    cents = lambda value: (F.abs(value) * 100).cast("decimal(16,0)")
    doubled = cents(amount) * cents(goal) * F.lit(2).cast("decimal(1,0)") + cents(whole)
    share = F.call_function("div", doubled, cents(whole) * F.lit(2).cast("decimal(1,0)"))
    return (F.signum(amount).cast("decimal(1,0)") * share.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(14,2)")


def price_by_effective_discount(items: DataFrame, profile: DataFrame) -> DataFrame:
    """One factor per document from the printed net; main positions define it, all take it."""
    printed = items.join(profile.select("document_id", "net_total"), "document_id", "left")
    return effective_discount(printed, takes_discount(items)).drop("net_total")


def effective_discount(printed: DataFrame, takes: Column) -> DataFrame:
    """``price_by_effective_discount`` of positions that carry ``net_total``; without one they keep their prices."""
    joined = printed.withColumn("_open", takes)
    main = ~F.col("is_alternative")
    eligible = F.coalesce(F.sum(F.when(F.col("_open") & main, F.col("line_total"))).over(per_document()), F.lit(0))
    exempt = F.coalesce(F.sum(F.when(~F.col("_open") & main, F.col("line_total"))).over(per_document()), F.lit(0))
    joined = joined.withColumns({
        "_eligible": eligible.cast("decimal(14,2)"), "_exempt": exempt.cast("decimal(14,2)"),
    })
    goal = (F.col("net_total") - F.col("_exempt")).cast("decimal(14,2)")
    joined = joined.withColumn("_goal", goal)
    ratio = (F.col("_goal") / F.nullif(F.col("_eligible"), F.lit(0))).cast("decimal(20,17)")
    usable = (
        (F.col("_eligible") > 0) & (F.col("_goal") > 0) & (F.col("_goal") <= 2 * F.col("_eligible"))
        & (F.abs(F.col("_eligible") + F.col("_exempt") - F.col("net_total")) > F.lit("0.01").cast("decimal(14,2)"))
    )
    joined = joined.withColumn("_factor", F.when(usable, ratio))
    applied = F.col("_open") & F.col("_factor").isNotNull()
    share = exact_share(F.col("line_total"), F.col("_goal"), F.col("_eligible"))
    total = F.when(applied, share).otherwise(F.col("line_total"))
    unit = F.when(applied, unit_from_total(total, F.col("quantity"))).otherwise(F.col("unit_price"))
    priced = _with_result(joined, applied, total, unit, F.lit("schlotterer_effective_discount"))
    priced = priced.withColumn("effective_factor", F.round("_factor", 6))
    candidate = F.col("pricing_applied") & main
    settled = _settle_delta(priced, F.when(F.col("_factor").isNotNull(), F.col("_goal")), candidate, candidate, DELTA_LIMIT)
    return settled.drop("_open", "_eligible", "_exempt", "_goal", "_factor")


def price_with_fallback(items: DataFrame, profile: DataFrame, groups: DataFrame) -> DataFrame:
    """Group discounts where a document accepts them, the effective discount elsewhere."""
    offered = group_offers(items, groups).join(profile.select("document_id", "net_total"), "document_id", "left")
    return fall_back(offered).drop("net_total", "groups_accepted", "offer_open")


def fall_back(offered: DataFrame) -> DataFrame:
    """``price_with_fallback`` of the offers of ``group_offers`` with ``net_total``, one pass over the positions of a document.

    A position without accepted groups keeps its prices, so the effective discount finds it as it was; the
    other documents print no net for it.
    """
    results = ("original_line_total", "original_unit_price", "pricing_applied", "pricing_adjustment_source", "rounding_delta")
    grouped = accept_groups(offered).withColumnsRenamed({"net_total": "_net", **{c: f"_group_{c}" for c in results}})
    rest = effective_discount(grouped.withColumn("net_total", F.when(~F.col("groups_accepted"), F.col("_net"))), F.col("offer_open"))
    taken = {c: F.when(F.col("groups_accepted"), F.col(f"_group_{c}")).otherwise(F.col(c)) for c in results}
    return rest.withColumns(taken).drop("net_total", *[f"_group_{c}" for c in results]).withColumnRenamed("_net", "net_total")


def with_pricing_mode(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Original prices where the document switches adjustments off; freight blocks keep theirs."""
    flags = documents.select("document_id", pricing_enabled(F.col("apply_pricing_adjustments")).alias("_on"))
    joined = items.join(flags, "document_id", "left")
    source = F.col("pricing_source") if "pricing_source" in items.columns else F.lit(None).cast("string")
    off = (
        ~F.coalesce(F.col("_on"), F.lit(True))
        & ~F.coalesce(source == "delivery_block", F.lit(False))
        & (F.col("original_line_total").isNotNull() | F.col("original_unit_price").isNotNull())
    )
    unit = F.coalesce(
        F.col("original_unit_price"), unit_from_total(F.col("original_line_total"), F.col("quantity"))
    )
    return joined.select(
        *[F.col(c) for c in items.columns if c not in ("line_total", "unit_price")],
        F.when(off, F.coalesce(F.col("original_line_total"), F.col("line_total"))).otherwise(F.col("line_total")).alias("line_total"),
        F.when(off, unit).otherwise(F.col("unit_price")).alias("unit_price"),
        F.col("unit_price").alias("purchase_price"),
        off.alias("pricing_disabled"),
    )


def export_prices(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Unit and purchase price of the export; the unit price is a sentinel while the flag is on."""
    flags = documents.select("document_id", pricing_enabled(F.col("apply_pricing_adjustments")).alias("_on"))
    joined = items.join(flags, "document_id", "left").withColumn("_on", F.coalesce("_on", F.lit(True)))
    original = F.coalesce(
        F.col("original_unit_price"),
        F.when(F.col("original_line_total").isNotNull(),
               unit_from_total(F.col("original_line_total"), F.col("quantity"))),
    )
    adjusted = F.coalesce(
        F.col("adjusted_unit_price"),
        F.when(F.col("adjusted_line_total").isNotNull(),
               unit_from_total(F.col("adjusted_line_total"), F.col("quantity"))),
    )
    both = original.isNotNull() & adjusted.isNotNull()
    purchase = F.when(both, adjusted).otherwise(F.coalesce(F.col("purchase_price"), F.col("unit_price")))
    unit = F.when(both, original).otherwise(F.col("unit_price")).cast("double")
    return joined.select(
        *[F.col(c) for c in items.columns if c not in ("unit_price", "purchase_price")],
        F.when(F.col("_on") & purchase.isNotNull(), F.lit(EXPORT_SENTINEL)).otherwise(unit).alias("unit_price"),
        purchase.cast("double").alias("purchase_price"),
    )
