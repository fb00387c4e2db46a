"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, bpe, conversations, embed_dedup, hamming, html_extract, langid, merkle, minhash, mixing, packing, pii, token_records
from ._shared import read_table
from ._tokens import default_tokenizer
from .sql import OP11_SQL, OP13_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.recallforge.surrogateKey", "change-this-key")
    return pii.replace_personal_data(docs, key).select("doc_id", "n_entities", "text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP5_SQL = """
WITH e AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64
), c AS (SELECT id, CAST(array_to_string(bits, '') AS BIT) AS code FROM e),
p AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance
  FROM c q JOIN c ON q.id <> c.id WHERE q.id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS BIGINT) AS rank, vec_id, distance
FROM p QUALIFY rank <= 10
"""


def op6_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.encode_round_trip(read_table(spark, sf_dir, "documents"), default_tokenizer())


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT t.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, LEAST(t.vec_id, COALESCE(m.m, t.vec_id))::BIGINT AS component_id,
       t.vec_id = LEAST(t.vec_id, COALESCE(m.m, t.vec_id)) AS kept
FROM embeddings t
LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY a) n ON n.a = t.vec_id
LEFT JOIN (SELECT a, MIN(b) AS m FROM reached GROUP BY a) m ON m.a = t.vec_id
"""


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read_table(spark, sf_dir, "documents")).taken()


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations")
    return conversations.repair_digests(conversations.damage(given), given.select("conv_id"))


def op12_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), default_tokenizer())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_html_extraction": op2_html_extraction,
        "op3_sequence_packing": op3_sequence_packing,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_hamming_top_k": op5_hamming_top_k,
        "op6_bloom_lm_scores": op6_bloom_lm_scores,
        "op7_language_id": op7_language_id,
        "op8_token_records": op8_token_records,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_source_mixing": op10_source_mixing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_bpe_prefixes": op12_bpe_prefixes,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_hamming_top_k": OP5_SQL,
        "op9_embedding_near_dedup": OP9_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
