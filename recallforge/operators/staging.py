"""Jobs for whoever reviews the store: extraction of long entries, and pairs that may say the same."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import search, store
from .tables import ensure_importable

#: From sentences to the positions of those that are kept as candidates.
Splitter = Callable[[list[str], float], list[int]]


def candidates(entries: DataFrame, threshold: float = search.DUPLICATE_THRESHOLD, splitter: Splitter = search.greedy) -> DataFrame:
    """(job_id, candidates, split_failure) of ``entries`` (job_id, content): the candidate concepts of each content, or
    why it could not be split; a content without sentences has no candidates."""
    ensure_importable(entries.sparkSession)
    cut = entries.select("job_id", text.distinct_sentences(text.sentences(F.col("content"))).alias("s"))

    def split(batches):
        for batch in batches:
            found, failed = [], []
            for sentences in batch.column(1).to_pylist():
                try:
                    found.append([sentences[i] for i in splitter(sentences, threshold)] if sentences else [])
                    failed.append(None)
                except Exception as e:  # whatever a model raises is told in the job, which is staged all the same
                    found.append([])
                    failed.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(failed, pa.string())], ["job_id", "candidates", "split_failure"])

    return cut.mapInArrow(split, "job_id string, candidates array<string>, split_failure string")


def stage(entries: DataFrame, threshold: float = search.DUPLICATE_THRESHOLD, splitter: Splitter = search.greedy) -> DataFrame:
    """(job_id, content, candidates, split_failure, prompt) for ``entries`` (content, description, source).

    Contents of more than store.SPLIT_BYTES bytes come with their candidate concepts or with why there are none. Equal
    contents are one job, with the greatest of their descriptions and sources.
    """
    keyed = entries.withColumn("job_id", text.slugify(F.col("content")))
    jobs = keyed.groupBy("job_id").agg(F.max(F.struct("content", "description", "source")).alias("j")).select("job_id", "j.*")
    split = candidates(jobs.where(F.octet_length("content") > store.SPLIT_BYTES), threshold, splitter)
    jobs = jobs.join(split, "job_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    raw = F.array(F.concat(F.lit("raw/"), F.col("job_id"), F.lit(".md")))
    prompt = store.render_prompt(F.lit("Extraction"), F.col("description"), F.col("source"), raw, F.col("candidates"), F.col("split_failure"), F.lit(""))
    return jobs.select("job_id", "content", "candidates", "split_failure", prompt.alias("prompt"))


def curator_jobs(pairs: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """(bank_id, job_id, kind, description, sources, source, prompt): a job for each of ``pairs`` (bank, a, b, kind,
    percent), with both entries as its sources; ``name`` gives an entry's slug from its id."""
    x, y = name(F.col("a")), name(F.col("b"))
    job = F.concat_ws("-", "kind", x, y)
    same = F.concat(x, F.lit(" and "), y, F.lit(": one content equals or holds the other, certain without a threshold"))
    near = F.concat(x, F.lit(" and "), y, F.lit(" are "), F.col("percent").cast("string"), F.lit("% similar by cosine of their vectors: judge whether to merge or retire"))
    jobs = pairs.select(
        F.col("bank").alias("bank_id"), job.alias("job_id"), F.lit("Curation").alias("kind"), F.when(F.col("kind") == "exact-dup", same).otherwise(near).alias("description"),
        F.array(*[F.concat(F.lit("wiki/"), s, F.lit(".md")) for s in (x, y)]).alias("sources"), F.lit("internal").alias("source"),
    )
    none = F.array().cast("array<string>")
    return jobs.withColumn("prompt", store.render_prompt(F.col("kind"), F.col("description"), F.col("source"), F.col("sources"), none, F.lit(None).cast("string"), F.lit("")))
