"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import bpe, divergence, extraction, jaccard, lempelziv, licenses, mixing, neighbours, quality, repair, tokenbin, toxicity, warc
from offerlake.llm.common import held_out, ship, stage_folder

RANKS_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.7, 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.Ranks.load(RANKS_FILE, public_tokenizers.PATTERN)
    decoded = bpe.decode(bpe.encode(table(spark, folder, "documents"), ranks), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_mixing", mixing.oracle())
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.draws(table(spark, folder, "documents")).select(
        "doc_id", "_mix.source", "_mix.lang", "_mix.topic", F.col("_mix.tokens").alias("n_tokens"),
        F.round("_mix.weight", 6).alias("cell_weight"), F.round("_mix.probability", 6).alias("probability"), "_mix.sampled",
    )


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), cut AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM own
), grams AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN ['=' || text] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM cut
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common)
), ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM own UNION SELECT r.a, l.b FROM reach r JOIN ends l ON l.a = r.b
), degree AS (SELECT a, count(*) AS n_links FROM ends GROUP BY a)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM reach r LEFT JOIN degree d ON d.a = r.a GROUP BY r.a
"""


@query("op4_ngram_join", NGRAM_JOIN_SQL)
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, out = table(spark, folder, "documents"), stage_folder(spark, "token-files")
    with open(TOKENIZER_FILE, encoding="utf-8") as definition:
        tokenbin.write_files(tokenbin.encode_in_order(docs, definition.read()), out)
    return tokenbin.read_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_lz_fingerprints")
def op6_lz_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return lempelziv.with_next(table(spark, folder, "documents"))


@query("op7_warc")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.captures(table(spark, folder, "pages"), stage_folder(spark, "warc"))


NEIGHBOURS_SQL = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY rank <= 20
"""


@query("op8_neighbours", NEIGHBOURS_SQL)
def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"), "spans")


@query("op10_licenses")
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(table(spark, folder, "conversations"))


@query("op12_source_divergence", divergence.oracle())
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_html_extraction")
def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))
