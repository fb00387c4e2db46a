"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next.

language       drops documents whose language cannot be told
near_dedup     keeps one document of each group of near duplicates
pii            replaces personal data by surrogates
mixing         repeats and cuts documents so that sources reach their target weights
packing        cuts what is left into token sequences of 2048
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import langid, minhash, mixing, packing, pii
from recallforge.llm._shared import maybe_broadcast, read_table, stored
from recallforge.llm._tokens import default_tokenizer


#: Words in a block of the mix: most documents are whole blocks.
MIX_BLOCK_WORDS = 512


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null, has no letter or is scored under 0.5 go; an unlabelled row is told like any other."""
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without doc_id and rows without words stay; of rows that repeat a kept doc_id the first by text stays, and of
    equal texts the one with the least other columns."""
    found = stored(minhash.near_duplicates(docs).select("doc_id", "kept"), "kept")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(maybe_broadcast(dropped, minhash.BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    repeated = maybe_broadcast(stored(repeated, "repeated"), minhash.BROADCAST_IDS)
    several = left.join(repeated, "doc_id", "left_semi").select(F.struct("text", *[c for c in docs.columns if c != "text"]).alias("row"))
    once = several.groupBy("row.doc_id").agg(F.min("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; a null text stays null."""
    return pii.replace_personal_data(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words go; the others come as often and as far as the mix takes them, shard by shard."""
    return mixing.mixed_documents(docs, block_words=MIX_BLOCK_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each row's tokens; an empty text is its end id."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mix), ("packing", pack)]

#: No SQL: language, MinHash, surrogates and packing are not expressible. tests/llm compares each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
