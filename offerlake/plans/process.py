"""The document job: texts to headers, amount lines and priced positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.functions.numbers import german_date
from offerlake.operators import amounts, headers, items, links, pricing
from offerlake.operators.lines import text_rejects
from offerlake.rules.base import Registry
from offerlake.rules.registry import REGISTRY
from offerlake.session import cut_lineage, shared_folder


def stage_by_template(doc_text: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Writes the texts partitioned by template, so each rule set reads only its own.

    Without it every rule set would scan the whole corpus.
    """
    spark = doc_text.sparkSession
    path = shared_folder(spark, "texts")
    marked = doc_text.withColumn("template", headers.detect_template(F.col("text"), registry))
    marked.write.partitionBy("template").parquet(path)
    return spark.read.schema(marked.schema).parquet(path)  # also where no text is left


def extract_items(staged: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Raw items of all rule sets, each over its own partition of the staged texts; a template without positions gives none."""
    parts = []
    for rule in registry.rules:
        if rule.shape is None and rule.custom is None:
            continue
        texts = staged.where(F.col("template") == rule.key)
        rows = items.raw_items(texts, rule)
        if rule.delivery is not None:
            rows = rows.unionByName(rule.delivery(texts, rows), allowMissingColumns=True).fillna(False, ["is_alternative"])
        parts.append(rows.withColumn("template", F.lit(rule.key)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _priced(typed: DataFrame, profile: DataFrame, groups: DataFrame, registry: Registry) -> DataFrame:
    """Positions by the pricing of their rule set; a branch reads the rows of its own rule sets only."""
    own = lambda kind: typed.where(F.col("template").isin(*registry.keys(pricing=kind)))
    # the supplier of a position is known from its rule set
    chained = own("chain")
    suppliers = chained.select("document_id", F.col("template").alias("provider_key")).distinct()
    branches = [pricing.price_by_chain(chained, profile, suppliers)]
    if registry.keys(pricing="line"):
        branches.append(pricing.price_by_line_discount(own("line")))
    if registry.keys(pricing="groups"):
        branches.append(pricing.price_with_fallback(own("groups"), profile, groups))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def process_texts(doc_text: DataFrame, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
    """documents, amount_lines, line_items, components and rejects of a batch of texts."""
    texts, rejects = text_rejects(doc_text.select("document_id", "text"))
    staged = stage_by_template(texts, registry)
    head = headers.document_headers(staged, registry)
    # the amount lines and the documents read the totals, each of the steps behind them the raw amounts again
    totals = cut_lineage(headers.document_totals(staged))
    templates = staged.select("document_id", "template")
    grouped = F.col("template").isin(*registry.keys(pricing="groups")) if registry.keys(pricing="groups") else F.lit(False)
    groups = amounts.discount_groups(staged.where(grouped))
    groups = groups.withColumn("key", pricing.group_key(F.col("label")))
    raw_amounts = cut_lineage(amounts.amount_rows(amounts.extract_amount_lines(staged), templates))
    expanded = amounts.expand_group_discounts(raw_amounts, groups)
    # written once: pricing, counting and the tables read these several times
    amount_lines = cut_lineage(amounts.upsert_totals(expanded, totals))
    profile = amounts.condition_profile(amount_lines)

    typed = cut_lineage(items.typed_items(items.numbered(extract_items(staged, registry))))
    priced = _priced(typed, profile, groups, registry)
    if rooms := registry.keys(room_labels=True):
        labelled = F.col("template").isin(*rooms)
        priced = items.with_room_label(priced.where(labelled)).unionByName(priced.where(~labelled), allowMissingColumns=True)
    counts = typed.groupBy("document_id").agg(F.count("*").alias("position_count"))
    announced = staged.select("document_id", headers.position_count(F.col("text"), F.col("template"), registry).alias("announced"))
    has_totals = F.coalesce("net_total", "vat_total", "gross_total").isNotNull()
    names = {r.key: r.supplier_name for r in registry.rules}
    documents = (
        links.supplier_names(head, names).join(totals, "document_id").join(announced, "document_id").join(counts, "document_id", "left")
        .withColumn("position_count", F.coalesce("position_count", "announced"))
        .withColumn("document_date", german_date(F.col("document_date")))
        .withColumn("parse_confidence", headers.parse_confidence(F.col("template"), F.col("position_count"), has_totals))
        .withColumns({"status": F.lit("processed"), "approval_status": F.lit("pending")}).drop("announced")
    )
    return {
        "documents": documents, "amount_lines": amount_lines, "line_items": priced.drop("operations", "discount_percent", "effective_factor", "components"),
        "components": items.component_rows(typed), "rejects": rejects,
    }
