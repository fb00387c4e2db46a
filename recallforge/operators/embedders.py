"""Embedders behind one interface: a function from (keys, text) to (keys, vector).

``hashed`` needs nothing; ``precomputed`` looks vectors up; ``batched`` runs any Python embedder in batches on the
executors, made once per worker process.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import hashing, text
from . import search
from .tables import ensure_importable

Embedder = Callable[[DataFrame, list[str]], DataFrame]
Model = Callable[[list[str]], np.ndarray]
#: Texts that a model gets at a time.
BATCH = 32


def hashed(texts: DataFrame, keys: list[str]) -> DataFrame:
    return search.dense(texts, keys, "text")


def precomputed(vectors: DataFrame) -> Embedder:
    """Vectors of a table (content_hash, vector); texts without one have none."""

    def embed(texts: DataFrame, keys: list[str]) -> DataFrame:
        hashed_texts = texts.select(*keys, hashing.content_hash(F.col("text")).alias("content_hash"))
        return hashed_texts.join(vectors, "content_hash").select(*keys, "vector")

    return embed


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token vectors (texts, tokens, dimensions) where the mask is 1, at length 1; an empty mask gives zero."""
    weight = mask[..., None].astype(float)
    mean = (tokens * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    size = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(size > 0, mean / np.where(size > 0, size, 1), 0.0)


#: The models that this worker process has made.
_models: dict[str, Model] = {}


def model_of(key: str, make: Callable[[], Model], attempts: int = 3, wait: float = 2.0) -> Model:
    """The process's model of that key, made when it is asked for first; making it may fail all but the last time."""
    while key not in _models:
        try:
            _models[key] = make()
        except Exception:
            attempts -= 1
            if attempts <= 0:
                raise
            time.sleep(wait)
    return _models[key]


def batched(make: Callable[[], Model], batch: int = BATCH, attempts: int = 3, wait: float = 2.0) -> Embedder:
    """``make`` builds the model, once in each worker process however many tasks it serves; the model maps texts to an array
    of vectors, in order."""
    key = hashlib.sha256(CloudPickleSerializer().dumps(make)).hexdigest()

    def embed(texts: DataFrame, keys: list[str]) -> DataFrame:
        ensure_importable(texts.sparkSession)

        def run(batches):
            for rows in batches:
                model = model_of(key, make, attempts, wait)
                found: list[list[float]] = []
                all_texts = [t or "" for t in rows.column(len(keys)).to_pylist()]
                for at in range(0, len(all_texts), batch):
                    found += np.asarray(model(all_texts[at : at + batch]), float).tolist()
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(found, pa.list_(pa.float64()))], [*keys, "vector"])

        return texts.select(*keys, "text").mapInArrow(run, texts.select(*keys).schema.add("vector", ArrayType(DoubleType())))

    return embed


CACHE = "id long, content_hash string, offset long, end_offset long, vector array<double>"


def refresh_cache(entries: DataFrame, cache: DataFrame, embed: Embedder) -> DataFrame:
    """The window cache (CACHE) of ``entries`` (id, content): entries whose hash is unchanged keep their windows, the
    others are cut and embedded again; windows of entries that are gone go."""
    dirty = search.cache_misses(entries, cache)
    kept = cache.join(entries.select("id", hashing.content_hash(F.col("content")).alias("content_hash")), ["id", "content_hash"], "left_semi")
    again = entries.join(dirty, "id").select("id", "content_hash", F.explode(text.windows(F.col("content"))).alias("w")).select("id", "content_hash", "w.offset", "w.end_offset", F.col("w.text").alias("text"))
    vectors = embed(again.select("id", "offset", "text"), ["id", "offset"])
    fresh = again.join(vectors, ["id", "offset"]).select("id", "content_hash", "offset", "end_offset", "vector")
    return kept.select("id", "content_hash", "offset", "end_offset", "vector").unionByName(fresh)
