"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html_text, jaccard, knn, licenses, pii, sharding, toxicity, warc

RANKS = "byte_bpe_multi_50k.tiktoken"
N_SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows, of documents dealt with their texts. A null text weighs nothing and has the CRC of no bytes."""
    shards = sharding.hypergeometric_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), N_SHARDS)
    own = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(own) + 8).cast("long").alias("size"), F.crc32(F.encode(own, "utf-8")).alias("text_crc32")
    return shards.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_inner_products(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probabilities and whether it is called toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii, "op2_sharding": op2_sharding, "op3_leaks": op3_leaks, "op4_nearest": op4_nearest, "op5_bpe": op5_bpe,
    "op6_licenses": op6_licenses, "op7_main_text": op7_main_text, "op8_warc": op8_warc, "op9_toxicity": op9_toxicity,
    "op10_jaccard": op10_jaccard,
}

_DOT = "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
ORACLES: dict[str, str] = {
    "op4_nearest": f"""SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score,
         (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id))::INT AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20""",
    "op6_licenses": licenses.license_scan_sql(),
    "op8_warc": """SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < best THEN best END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)""",
}
