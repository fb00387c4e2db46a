"""Tables between the steps of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


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


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if a count shows that it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt_in_order(df: DataFrame, keys: list[Column], rows_per_range: int = 100_000) -> DataFrame:
    """``df``, sorted, with ``range`` and, ascending within it, ``pos``: ranges of about equal numbers of rows, by quantiles of
    the keys, so that only rows which are equal in all of them must lie in one."""
    ranges = max(1, -(-df.count() // rows_per_range))
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return stored(dealt.withColumn("range", F.shiftright("pos", 33)), "ordered")


def before_ranges(dealt: DataFrame, value: Column) -> DataFrame:
    """(range, base, own): the sums of ``value`` over earlier ranges and over this one. One row per range meets in a task."""
    sums = dealt.groupBy("range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("own"))
    return sums.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "own")


def ordinals(df: DataFrame, keys: list[Column], name: str, rows_per_range: int = 100_000) -> DataFrame:
    """``df`` with the place of each row in order of ``keys``, from 1 on, counted per range first."""
    dealt = dealt_in_order(df, keys, rows_per_range)
    place = F.col("base") + F.col("pos").bitwiseAND((1 << 33) - 1) + 1
    return dealt.join(maybe_broadcast(before_ranges(dealt, F.lit(1)), 1_000_000), "range").select(*df.columns, place.cast("long").alias(name))


def ensure_importable(spark: SparkSession) -> None:
    """Python workers find this package although the driver may have been started elsewhere."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
