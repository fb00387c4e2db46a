"""Rows of groups in order, dealt out by range, so that a group of any size lies in as many tasks as it needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import maybe_broadcast, stored

#: A table of runs is sent to the tasks up to so many rows; beyond, it is joined by shuffle.
BROADCAST_RUNS = 50_000


def first_nulls(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def numbered(df: DataFrame, group: str, order: list[str], part_rows: int = 100_000) -> tuple[DataFrame, int]:
    """``df``, a stored table, with each row's ``part``, its place ``index`` in its group from 0 on, and the group's
    ``size``; and how many parts there are. Nulls come first, rows that are equal in ``order`` lie in any order.

    Rows are sorted over all parts; each part counts its rows of each group, and what earlier parts hold of a group is the
    offset of its rows here. Only these counts meet, one row for each part and group.
    """
    rows, most = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, most, -(-rows // part_rows))
    keys = first_nulls(group, *order, "salt")
    dealt = df.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = dealt.drop("salt").withColumn("pos", F.monotonically_increasing_id())
    held = stored(at.withColumn("part", F.shiftright("pos", 33)), "ordered")
    runs = held.groupBy("part", F.col(group).alias("run_of")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("run_of")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select(F.col("part").alias("at"), "run_of", "first", before.alias("before"), F.sum("n").over(own).alias("size")), "runs")
    joined = held.join(maybe_broadcast(runs, BROADCAST_RUNS), (F.col("part") == F.col("at")) & F.col(group).eqNullSafe(F.col("run_of")))
    return joined.select(*df.columns, "part", (F.col("pos") - F.col("first") + F.col("before")).alias("index"), "size"), parts


def consecutive(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that follow one another with equal values in ``names``, each such run as one table."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        change = np.zeros(batch.num_rows, bool)
        for name in names:
            codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(change).tolist()] if batch.num_rows else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            own = tuple(batch.column(name)[a].as_py() for name in names)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
