"""Mixing sources to target weights: iterative proportional fitting, in DataFrame functions only.

Documents are summed into cells (source, language, topic) of tokens. Raking scales the cell weights to
the target share of every source, then language, then topic, for ``ROUNDS`` rounds. A cell's sampling
probability is its weight over its tokens, times one factor chosen so that the expected tokens are the
wanted share of all, with probabilities held at 1 at most. A document is sampled when a uniform number
made from its doc_id lies below the probability of its cell; so a repeated doc_id is sampled wholly or
not at all, and every run draws the same documents.

Only cells are raked; their number is that of the combinations, not of the documents. Sums are partial
before any shuffle, so a source with a third of all rows is no hot spot. Probabilities reach the
documents by a broadcast while the cells are few (``BROADCAST_CELLS``), else by a join that adaptive
execution splits.

Null sources and languages form cells of their own (named ""). Null and empty texts have no tokens and
probability 1 where their cell has no tokens. A null doc_id draws as the text "". An empty table
stays empty. Values without a target keep their share of the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import empty_text, stage

ROUNDS = 8
CALIBRATIONS = 12
BROADCAST_CELLS = 100_000
#: Values of a dimension up to which its factors are kept as one map.
FACTOR_VALUES = 200
#: Target share of a value: its share of the tokens to this power, made to sum to one.
FLATTENING = {"source": 0.5, "lang": 0.7, "topic": 0.5}
SHARE = 0.6
SEED = "mix"


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text, by its first match."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike(r"(?i)licen[cs]ed?|copyright|rights reserved"), "legal")
        .when(text.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+|[0-9]{3}[-) ]+[0-9]{3}"), "contact")
        .when(F.length(text) >= 4000, "long")
        .otherwise("short")
    )


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def flattened_targets(cells: DataFrame, dimension: str, power: float, tokens: str = "tokens") -> DataFrame:
    """Target shares: token shares to a power, summing to one."""
    sums = cells.groupBy(dimension).agg(F.sum(tokens).alias("_n")).select(dimension, F.pow(F.col("_n").cast("double"), F.lit(power)).alias("_p"))
    total = sums.agg(F.sum("_p").alias("s")).first()["s"] or 1.0
    return sums.select(dimension, (F.col("_p") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tokens: str = "tokens") -> DataFrame:
    """``cells`` with a column ``weight`` whose sums meet the target shares of every dimension.

    A cell's weight is its share times one factor for each of its values. Where every dimension has at most
    ``FACTOR_VALUES`` values, those factors are all that changes from round to round; with more, weights are a table.
    """
    total = cells.agg(F.sum(tokens).alias("s")).first()["s"] or 1
    start = stage(cells.withColumn("weight", F.col(tokens).cast("double") / F.lit(float(total))), "mixing-cells")
    few = all(start.select(d).distinct().limit(FACTOR_VALUES + 1).count() <= FACTOR_VALUES for d in targets)
    return _rake_factors(start, targets, rounds) if few else _rake_tables(start, targets, rounds)


def _rake_factors(start: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    wanted = {d: {r[d]: r["target"] for r in start.select(d).distinct().join(t, d).select(d, "target").collect()} for d, t in targets.items()}
    factors: dict[str, dict] = {d: {} for d in targets}

    def weight() -> Column:
        value = F.col("weight")
        for d, own in factors.items():
            if own:
                pairs = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
                value = value * F.coalesce(F.try_element_at(pairs, F.col(d)), F.lit(1.0))
        return value

    for _ in range(rounds):
        for d in targets:
            for row in start.groupBy(d).agg(F.sum(weight()).alias("s")).collect():  # a row for each value
                value, s = row[d], row["s"]
                if value is not None:
                    factors[d][value] = factors[d].get(value, 1.0) * (wanted[d].get(value, s) / s if s > 0 else 0.0)
    return start.withColumn("weight", weight())


def _rake_tables(raked: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    rest = [c for c in raked.columns if c != "weight"]
    for _ in range(rounds):
        for dimension, target in targets.items():
            sums = raked.groupBy(dimension).agg(F.sum("weight").alias("_sum")).join(target, dimension, "left")
            factor = F.when(F.col("_sum") > 0, F.coalesce(F.col("target"), F.col("_sum")) / F.col("_sum")).otherwise(F.lit(0.0))
            raked = raked.join(sums.select(dimension, factor.alias("_factor")), dimension).select(*rest, (F.col("weight") * F.col("_factor")).alias("weight"))
        raked = stage(raked, "mixing-cells")  # a plan of constant size, and nothing to compute anew
    return raked


def calibrate(cells: DataFrame, share: float, tokens: str = "tokens") -> DataFrame:
    """``cells`` with ``probability``: weights over tokens, scaled to the wanted share of all tokens."""
    ratio = F.when(F.col(tokens) > 0, F.col("weight") / F.col(tokens))
    total = float(cells.agg(F.sum(tokens).alias("s")).first()["s"] or 0)
    scale = share * total
    for _ in range(CALIBRATIONS):
        full = F.lit(scale) * ratio >= 1
        row = cells.agg(
            F.sum(F.when(full, F.col(tokens)).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not row["free"]:
            break
        scale = max(share * total - row["held"], 0.0) / row["free"]
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.lit(scale) * ratio), F.lit(1.0)))


def cell_columns(text: str = "text") -> dict[str, Column]:
    return {
        "source": F.coalesce(F.col("source"), F.lit("")), "lang": F.coalesce(F.col("lang"), F.lit("")),
        "topic": topic_of(empty_text(text)), "tokens": token_count(empty_text(text)),
    }


def mark(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the cell of every row and its tokens. This reads the texts; what follows does not."""
    own = cell_columns(text)
    return docs.select("*", F.struct(*(own[d].alias(d) for d in FLATTENING)).alias("_cell"), own["tokens"].alias("_own"))


def _weighed(marked: DataFrame, share: float, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    cells = stage(marked.groupBy(*(F.col(f"_cell.{d}").alias(d) for d in FLATTENING)).agg(F.sum("_own").alias("tokens")), "mixing-cells")
    wanted = {d: flattened_targets(cells, d, p) for d, p in FLATTENING.items()} | (targets or {})
    return calibrate(rake(cells, wanted), share)


def _drawn(marked: DataFrame, cells: DataFrame) -> DataFrame:
    side = cells.select(F.struct(*FLATTENING).alias("_cell"), F.struct("weight", "tokens", "probability").alias("_found"))
    if cells.count() <= BROADCAST_CELLS:
        side = F.broadcast(side)
    sampled = uniform(F.col("doc_id")) < F.col("_found.probability")
    kept = [F.col(c) for c in marked.columns if c not in ("_cell", "_own")]
    return marked.join(side, "_cell").select(*kept, F.struct(
        F.col("_cell.*"), F.col("_own").alias("tokens"), F.col("_found.weight").alias("weight"), F.col("_found.tokens").alias("cell_tokens"),
        F.col("_found.probability").alias("probability"), sampled.alias("sampled"),
    ).alias("_mix"))


def probabilities(docs: DataFrame, share: float = SHARE, targets: dict[str, DataFrame] | None = None, text: str = "text") -> DataFrame:
    """source, lang, topic, tokens, weight and probability of every cell."""
    return _weighed(mark(docs, text), share, targets)


def with_probabilities(docs: DataFrame, cells: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_mix``: the cell, its weight and probability, and the draw."""
    return _drawn(mark(docs, text), cells)


def draws(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id and ``_mix`` of every row. Texts are read once: their cells are staged."""
    marked = stage(mark(docs.select("doc_id", "text", "source", "lang")).select("doc_id", "_cell", "_own"), "mixing-rows")
    return _drawn(marked, _weighed(marked, share))


def sample(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The sampled rows of ``docs``, with their columns, whatever those are called. Texts are matched once, then staged with their cells."""
    whole = mark(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang")).select("row", "doc_id", "_cell", "_own")
    marked = stage(whole, "mixing-rows")
    return _drawn(marked, _weighed(marked, share)).where("_mix.sampled").select("row.*")


def oracle(table: str = "documents", share: float = SHARE) -> str:
    """The same as SQL of DuckDB: all rounds spelled out."""
    text = "coalesce(text, '')"
    topic = (
        f"CASE WHEN contains({text}, ' | ') THEN 'table' WHEN regexp_matches({text}, '(?i)licen[cs]ed?|copyright|rights reserved') THEN 'legal' "
        f"WHEN regexp_matches({text}, '[A-Za-z0-9._]+@[A-Za-z0-9.]+|[0-9]{{3}}[-) ]+[0-9]{{3}}') THEN 'contact' WHEN length({text}) >= 4000 THEN 'long' ELSE 'short' END"
    )
    parts = [
        f"own AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, "
        f"len(regexp_extract_all({text}, '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM {table})",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM own GROUP BY ALL)",
    ]
    for d, p in FLATTENING.items():
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(sum(n), {p}) / sum(pow(sum(n), {p})) OVER () AS target FROM cells GROUP BY {d})")
    parts.append("r0 AS MATERIALIZED (SELECT *, n / sum(n) OVER () AS weight FROM cells)")
    at = 0
    for _ in range(ROUNDS):
        for d in FLATTENING:
            parts.append(
                f"r{at + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.n, CASE WHEN sum(r.weight) OVER (PARTITION BY r.{d}) > 0 "
                f"THEN r.weight * t.target / sum(r.weight) OVER (PARTITION BY r.{d}) ELSE 0 END AS weight FROM r{at} r JOIN t_{d} t USING ({d}))"
            )
            at += 1
    parts.append(f"k0 AS MATERIALIZED (SELECT {share} * sum(n) AS k FROM cells)")
    for i in range(CALIBRATIONS):
        parts.append(
            f"k{i + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN full_ THEN 0 ELSE weight END) > 0 THEN greatest({share} * sum(n) - sum(CASE WHEN full_ THEN n ELSE 0 END), 0) "
            f"/ sum(CASE WHEN full_ THEN 0 ELSE weight END) ELSE any_value(k) END AS k FROM (SELECT *, coalesce(k * weight / nullif(n, 0) >= 1, false) AS full_ FROM r{at}, k{i}))"
        )
    return (
        "WITH " + ", ".join(parts) + f", p AS MATERIALIZED (SELECT source, lang, topic, weight, coalesce(least(1.0, k * weight / nullif(n, 0)), 1.0) AS probability FROM r{at}, k{CALIBRATIONS}) "
        "SELECT doc_id, source, lang, topic, tokens AS n_tokens, round(weight, 6) AS cell_weight, round(probability, 6) AS probability, "
        f"('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0 < probability AS sampled FROM own JOIN p USING (source, lang, topic)"
    )
