"""Links between confirmations, offers and predecessors; lookups; export journal reads.

Reference keys and suppliers can be held by any share of the documents, so every
link picks its one partner per key by an aggregate (partial before the shuffle)
and then joins one row per key; no pair list of a key is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.functions.keys import collapsed_lookup_key, reference_key
from offerlake.rules.suppliers import SUPPLIER_IDS, SUPPLIER_NAMES



def _type(name: str) -> Column:
    return X.comparison_text(F.col("document_type")) == name


def _supplier() -> Column:
    return X.clean_optional(F.col("supplier_name"))


def _recency() -> Column:
    """Sortable: dated before undated, newer higher, then the id."""
    return F.struct(
        F.col("document_date").isNotNull().alias("dated"),
        F.coalesce("document_date", F.lit("0001-01-01").cast("date")).alias("day"),
        F.col("document_id").alias("id"),
    )


def confirmation_links(documents: DataFrame, arrival_order: bool = False) -> DataFrame:
    """Offer of every confirmation: same reference key, same supplier if it names one; newest wins.

    With ``arrival_order`` (column processed_seq) an offer processed after the
    confirmation takes it over, the last such offer wins, whatever its date.
    """
    wanted = documents.where(_type("auftragsbestaetigung")).select(
        "document_id", _supplier().alias("supplier"), reference_key(F.col("offer_reference")).alias("key"),
        *(["processed_seq"] if arrival_order else []),
    )
    offers = documents.where(_type("angebot")).select(
        _supplier().alias("supplier"), reference_key(F.col("document_number")).alias("key"), _recency().alias("recency"),
        F.col("document_id").alias("offer_id"), *(["processed_seq"] if arrival_order else []),
    ).where("key is not null")
    aggregates = [F.max("recency")["id"].alias("newest")]
    if arrival_order:
        aggregates += [F.max("processed_seq").alias("last_seq"), F.max_by("offer_id", "processed_seq").alias("last")]
    # one row per (key, supplier); a null supplier row stands for offers without one
    per_supplier = offers.groupBy("key", "supplier").agg(*aggregates)
    per_key = offers.groupBy("key").agg(F.max("recency")["id"].alias("newest_any"))
    same = per_supplier.where("supplier is not null")
    joined = wanted.join(same, ["key", "supplier"], "left").join(per_key, "key", "left")
    by_date = F.when(F.col("supplier").isNull(), F.col("newest_any")).otherwise(F.col("newest"))
    if not arrival_order:
        return joined.select("document_id", by_date.alias("offer_id"))
    nameless = per_supplier.where("supplier is null").select(
        "key", F.col("last_seq").alias("nameless_seq"), F.col("last").alias("nameless_last")
    )
    joined = joined.join(nameless, "key", "left")
    late_own = F.when(F.col("last_seq") > F.col("processed_seq"), F.struct(F.col("last_seq").alias("seq"), F.col("last").alias("id")))
    late_any = F.when(F.col("nameless_seq") > F.col("processed_seq"), F.struct(F.col("nameless_seq").alias("seq"), F.col("nameless_last").alias("id")))
    takeover = F.array_max(F.array(late_own, late_any))
    return joined.select("document_id", F.coalesce(takeover["id"], by_date).alias("offer_id"))


def predecessor_links(documents: DataFrame) -> DataFrame:
    """Oldest approved offer with the same number key, whoever the supplier, never itself.

    The two oldest per key suffice: if the oldest is the document itself the second is it.
    """
    offers = documents.where(_type("angebot")).withColumn("key", reference_key(F.col("document_number"))).where("key is not null")
    oldest = Window.partitionBy("key").orderBy(F.col("document_date").asc_nulls_last(), "document_id")
    approved = offers.where("approval_status = 'approved'").select("key", "document_date", "document_id")
    two = approved.withColumn("rank", F.row_number().over(oldest)).where("rank <= 2")
    picks = two.groupBy("key").agg(
        F.max(F.when(F.col("rank") == 1, F.col("document_id"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("document_id"))).alias("second"),
    )
    joined = offers.select("document_id", "key").join(picks, "key", "left")
    pick = F.when(F.col("first") == F.col("document_id"), F.col("second")).otherwise(F.col("first"))
    return joined.select("document_id", pick.alias("offer_id"))


def automatic_links(documents: DataFrame) -> DataFrame:
    """The partner of every confirmation and offer: (document_id, offer_id)."""
    return confirmation_links(documents).unionByName(predecessor_links(documents))


def resolve_links(documents: DataFrame, automatic: DataFrame) -> DataFrame:
    """Manual decisions, "no link" included, win over the automatic link."""
    joined = documents.select("document_id", "offer_link_manual", "manual_offer_id").join(
        automatic.select("document_id", "offer_id"), "document_id", "left"
    )
    manual = F.coalesce(F.col("offer_link_manual"), F.lit(False))
    return joined.select(
        "document_id", F.when(manual, F.col("manual_offer_id")).otherwise(F.col("offer_id")).alias("linked_offer_document_id"),
        manual.alias("is_manual"),
    )


def check_manual_links(decisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Splits manual link decisions into accepted and refused with a reason.

    ``decisions``: document_id, linked_id (null is "no link"). Predecessor decisions of
    offers may cross suppliers, offer decisions of confirmations may not.
    """
    own = documents.select("document_id", X.comparison_text(F.col("document_type")).alias("own_type"),
                           X.comparison_text(F.col("supplier_name")).alias("own_supplier"))
    other = documents.select(F.col("document_id").alias("linked_id"), F.lit(True).alias("found"),
                             X.comparison_text(F.col("document_type")).alias("linked_type"),
                             X.comparison_text(F.col("supplier_name")).alias("linked_supplier"))
    joined = decisions.join(own, "document_id").join(other, "linked_id", "left")
    crosses = (
        (F.col("own_type") == "auftragsbestaetigung") & (F.col("own_supplier") != "") & (F.col("linked_supplier") != "")
        & (F.col("own_supplier") != F.col("linked_supplier"))
    )
    reason = F.when(
        F.col("linked_id").isNotNull(),
        F.when(F.col("linked_id") == F.col("document_id"), "self_link")
        .when(F.col("found").isNull(), "not_found")
        .when(F.col("linked_type") != "angebot", "not_an_offer")
        .when(crosses, "other_supplier"),
    )
    return joined.select("document_id", "linked_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def relations(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Related documents as rows: the linked offer and every document that points here."""
    compact = documents.select(
        F.col("document_id").alias("related_id"), "supplier_name", "document_type", "document_number", "document_date"
    )
    pairs = links.where("linked_offer_document_id is not null").select("document_id", "linked_offer_document_id")
    outgoing = pairs.select("document_id", F.lit("linked_offer").alias("relation"), F.col("linked_offer_document_id").alias("related_id"))
    incoming = pairs.select(
        F.col("linked_offer_document_id").alias("document_id"), F.lit("linked_order_confirmation").alias("relation"),
        F.col("document_id").alias("related_id"),
    )
    return outgoing.unionByName(incoming).join(compact, "related_id")


def offer_candidates(documents: DataFrame) -> DataFrame:
    """All offers in the order of the pick lists: per supplier, newest first.

    A range-partitioned sort; the list of one document is the slice of its supplier
    without itself (``candidates_for``).
    """
    offers = documents.where(_type("angebot")).withColumn("supplier_name", _supplier())
    return offers.select("supplier_name", "document_id", "document_number", "document_date", "project_ref", "status", "approval_status").orderBy(
        F.col("supplier_name").asc_nulls_first(), F.col("document_date").desc_nulls_last(), F.col("document_id").desc()
    )


def candidates_for(documents: DataFrame, document_id: int, supplier_name: str | None = None) -> DataFrame:
    """Pick list of one document; without a supplier it is the predecessor list over all suppliers."""
    offers = documents.where(_type("angebot")).where(F.col("document_id") != document_id)
    if supplier_name is not None:
        offers = offers.where(_supplier() == supplier_name.strip())
    return offers.select("document_id", "supplier_name", "document_number", "document_date", "project_ref", "status").orderBy(
        F.col("document_date").desc_nulls_last(), F.col("document_id").desc()
    )


def candidate_counts(documents: DataFrame) -> DataFrame:
    """Length of both pick lists of every document, from one count per supplier."""
    is_offer = _type("angebot")
    own = documents.select("document_id", _supplier().alias("supplier"), is_offer.cast("long").alias("own"))
    per_supplier = own.groupBy("supplier").agg(F.sum("own").alias("supplier_offers"))
    every = own.agg(F.sum("own").alias("all_offers"))
    joined = own.join(per_supplier, "supplier", "left").crossJoin(F.broadcast(every))
    offers = F.when(F.col("supplier").isNull(), F.lit(0)).otherwise(F.col("supplier_offers") - F.col("own"))
    return joined.select(
        "document_id", offers.cast("long").alias("offer_candidates"),
        (F.col("all_offers") - F.col("own")).alias("predecessor_candidates"),
    )


def supplier_names(templates: DataFrame, further: dict[str, str] | None = None) -> DataFrame:
    """Printed supplier name of a detected rule key; a few fixed rows as an expression."""
    names = F.create_map(*[F.lit(v) for pair in (SUPPLIER_NAMES | (further or {})).items() for v in pair])
    return templates.withColumn("supplier_name", F.try_element_at(names, F.col("template")))


def supplier_id(name: Column) -> Column:
    """Customer-system id of a supplier name: whole key first, then the first known name inside it."""
    key = collapsed_lookup_key(name)
    exact = F.create_map(*[F.lit(v) for pair in SUPPLIER_IDS for v in pair])
    inside = F.coalesce(*[F.when(key.contains(alias), F.lit(found)) for alias, found in SUPPLIER_IDS])
    return F.when(key != "", F.coalesce(F.try_element_at(exact, key), inside))


# --- export journal -----------------------------------------------------------------------------

def import_state(jobs: DataFrame) -> DataFrame:
    """Whether and when a document was exported live."""
    live = ~F.col("dry_run") & (F.col("status") == "exported")
    return jobs.groupBy("document_id").agg(
        F.max(live).alias("already_imported"), F.max(F.when(live, F.col("created_at"))).alias("latest_imported_at")
    )


def latest_job(jobs: DataFrame) -> DataFrame:
    """Newest journal row per document; an aggregate, so a document with many jobs is no hot spot."""
    rest = [c for c in jobs.columns if c != "document_id"]
    return jobs.groupBy("document_id").agg(F.max_by(F.struct(*rest), "job_id").alias("job")).select("document_id", "job.*")


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest journal rows per document; Spark keeps only ``limit`` per task before the shuffle."""
    newest = Window.partitionBy("document_id").orderBy(F.col("job_id").desc())
    return jobs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def document_list(documents: DataFrame, limit: int = 20) -> DataFrame:
    return documents.orderBy(F.col("document_id").desc()).limit(limit)
