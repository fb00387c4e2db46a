"""What the training-data operators have in common: shared tables, word rules, stable hashes.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``, and ``bytes.lower()`` lower-cases A-Z only, so the Python
stages work on UTF-8 bytes and never decode what they only count.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: The base of word polynomials, odd so that it has an inverse, and how many bytes are hashed at a time.
_BASE, _HASH_BLOCK = 0xD6E8FEB86659FD93, 1 << 19
#: Rows and bytes that are handed to a Python worker at once, unless the session's own limits are lower.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Texts are worked on in portions of at most so many rows and about so many bytes, so that a worker's memory does not
#: follow Spark's batches or a few long texts.
PORTION_ROWS, PORTION_BYTES = 4000, 2 << 20
#: What a worker keeps from task to task, and for which stage.
_kept: dict[Any, Any] = {}
_kept_for = ""
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Python workers find this package although the driver may have been started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in ARROW_BATCH.items():  # long texts: bound what a worker holds at a time
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= value:
            spark.conf.set(name, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where a local session names none, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it: lineage ends, lost executors cost nothing twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write within goes when the write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def few(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def give_back() -> None:
    """Frees what is no longer used: in a worker and on the driver, whose dead frames also hold plans in the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker made once for ``key``; a frugal stage drops it when the worker comes from another stage."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def keep_for(stage: str) -> None:
    """Workers outlive stages: what they keep for another stage, a tokenizer and its parts say, is dropped."""
    global _kept_for
    if _kept_for != stage:
        _kept.clear()
        _kept_for = stage
        give_back()


def frugal(stage):
    """``stage`` for mapInArrow, such that a reused worker drops what it kept for another stage, and gives back at its end
    what its allocators keep for later."""

    @functools.wraps(stage)
    def run(batches):
        keep_for(f"{stage.__module__}.{stage.__qualname__}")
        yield from stage(batches)
        give_back()

    return run


def portions(batches: Iterator[pa.RecordBatch], text: int = 1, most_bytes: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, whose column ``text`` is text, in portions."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            full = int(np.searchsorted(ends, before + most_bytes - size))
            upto = min(at + PORTION_ROWS - rows, max(at + 1, full), batch.num_rows)
            held.append(batch.slice(at, upto - at))
            rows, size = rows + upto - at, size + int(ends[upto - 1] - before)
            at = upto
            if rows >= PORTION_ROWS or size >= most_bytes or at < batch.num_rows:
                yield pa.concat_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for a broadcast only when a count has shown that it has at most ``most`` rows."""
    return F.broadcast(df) if few(df, most) else df


def word_count(text: Column) -> Column:
    """Number of words, JVM-side; null counts as no text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes (xor-shift and multiply), so that any bits of them can be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    h = h ^ (h >> np.uint64(27))
    h = h * _MULTIPLIER
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, one after the other, and how many each text has.

    A word's hash is its polynomial modulo 2**64, read off running sums over the whole buffer, then finalised with its
    length: no Python runs per word.
    """
    data = b"\n".join([t or b"" for t in texts]).lower()
    chars = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[chars]
    edges = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    firsts = np.cumsum(lengths + 1) - (lengths + 1)
    counts = np.diff(np.searchsorted(starts, np.append(firsts, len(chars) + 1)))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # as many words at a time as lie within a block; at least one
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + _HASH_BLOCK, "right")))
        stop = ends[upto - 1]
        powers, inverses = _power_tables(max(int(stop - base), 1 << 12))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars[base:stop].astype(np.uint64) + np.uint64(1)) * powers[: stop - base])])
            s, e = starts[at:upto] - base, ends[at:upto] - base
            h = (sums[e] - sums[s]) * inverses[s]
            out[at:upto] = mixed(h ^ ((e - s).astype(np.uint64) * _MULTIPLIER))
        at = upto
    return out, counts


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of hashed words, in order; none if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    last = len(h) - n + 1
    out = np.full(last, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _MULTIPLIER + h[i : last + i]
            out ^= out >> np.uint64(29)
        return mixed(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each range start, start + 1, ..., one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Per text its sorted distinct 5-word shingles; fewer words: the whole sequence as one; no word or null: empty."""
    h, counts = hashed_words(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = h[at : at + n]
        out.append(np.unique(ngram_hashes(own, min(SHINGLE_WORDS, n))) if n else own)
        at += n
    return out
