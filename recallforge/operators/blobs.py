"""The content-addressed blob store: put, touch, get, statistics, eviction by age and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from .tables import before_ranges, dealt_in_order, maybe_broadcast

#: Objects of a range of the eviction order, on average.
ROWS_PER_RANGE = 100_000


def put(accesses: DataFrame) -> DataFrame:
    """Objects of ``accesses`` (content, ts, kind): equal contents are one object, whose last_seen is the last access."""
    first = accesses.withColumn("handle", hashing.blob_handle(F.col("content")))
    return first.groupBy("handle").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.max(F.octet_length("content")).cast("long").alias("size"), F.min_by("kind", "ts").alias("kind"), F.count("*").alias("puts")
    )


def touch(objects: DataFrame, accesses: DataFrame) -> DataFrame:
    """``objects`` (handle, last_seen, ...) with last_seen raised by ``accesses`` (handle, ts)."""
    latest = accesses.groupBy("handle").agg(F.max("ts").alias("seen"))
    return objects.join(latest, "handle", "left").withColumn("last_seen", F.greatest("last_seen", F.coalesce("seen", "last_seen"))).drop("seen")


def get(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """(handle, outcome, size) for each of ``asked`` (handle): malformed handles never reach the join."""
    good = asked.where(hashing.is_handle(F.col("handle")))
    bad = asked.where(~hashing.is_handle(F.col("handle"))).select("handle", F.lit("malformed").alias("outcome"), F.lit(None).cast("long").alias("size"))
    found = good.join(objects.select("handle", "size"), "handle", "left")
    return found.select("handle", F.when(F.col("size").isNull(), "not_found").otherwise("found").alias("outcome"), "size").unionByName(bad)


def with_sidecars(objects: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Objects (handle) with last_seen and size of their sidecar (handle, json); missing, corrupt or partial ones drop out."""
    meta = sidecars.select("handle", F.from_json("json", "last_seen bigint, size bigint").alias("m")).select("handle", "m.last_seen", "m.size")
    return objects.join(meta.where("last_seen is not null and size is not null"), "handle")


def stats(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("entry_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.min("last_seen").alias("oldest_last_seen"))


def evictions(objects: DataFrame, now: int, max_age: int, max_bytes: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``objects`` (handle, last_seen, size) with evicted and by ('age', 'size' or null).

    Too old is what was seen ``max_age`` seconds ago or earlier. Of the rest, the longest unseen go, ties by handle,
    until the total is within ``max_bytes``. Objects are dealt out by quantiles of (last_seen, handle), so a bulk load of
    one moment is split like any other; sums of ranges tell which go whole and which stay whole, and only the range in
    which the total comes within bounds is summed row by row.
    """
    aged = objects.withColumn("old", F.greatest(F.lit(now) - F.col("last_seen"), F.lit(0)) >= max_age)
    young = aged.where("not old").drop("old")
    total = int(young.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    old = aged.where("old").drop("old").withColumn("evicted", F.lit(True)).withColumn("by", F.lit("age"))
    if total <= max_bytes:
        return old.unionByName(young.withColumn("evicted", F.lit(False)).withColumn("by", F.lit(None).cast("string")))
    dealt = dealt_in_order(young, [F.col("last_seen"), F.col("handle")], rows_per_range)
    placed = dealt.join(maybe_broadcast(before_ranges(dealt, F.col("size")), 1_000_000), "range")
    left = F.lit(total) - F.col("base")
    cut = (left > max_bytes) & (left - F.col("own") <= max_bytes)
    within = Window.partitionBy("range").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    split = placed.where(cut).withColumn("evicted", F.lit(total) - F.col("base") - F.coalesce(F.sum("size").over(within), F.lit(0)) > max_bytes)
    whole = placed.where(~cut).withColumn("evicted", left > max_bytes)
    summed = split.unionByName(whole).drop("range", "pos", "base", "own")
    return old.unionByName(summed.withColumn("by", F.when(F.col("evicted"), "size")))


def gc_report(evicted: DataFrame) -> DataFrame:
    gone = F.col("evicted")
    return evicted.agg(F.count_if(gone).alias("removed"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).cast("long").alias("bytes_freed"))


def gc_due(marks: DataFrame, interval: int = 3600) -> DataFrame:
    """Which of ``marks`` (ts) run a collection: the first, and each at least ``interval`` seconds after the last that did.

    The rule is sequential over a short log; it runs as one fold.
    """
    order = F.array_sort(F.collect_list("ts"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ran"))

    def step(a, t):
        due = a["last"].isNull() | (t - a["last"] >= interval)
        return F.struct(F.when(due, t).otherwise(a["last"]).alias("last"), F.when(due, F.concat(a["ran"], F.array(t))).otherwise(a["ran"]).alias("ran"))

    return marks.agg(F.aggregate(order, start, step, lambda a: a["ran"]).alias("ran")).select(F.explode("ran").alias("ts"))
