"""Greedy leaders: in order, a vector is kept unless an earlier kept one is similar to it.

The rule depends on the order, so a group cannot be cut at will. It is the first maximal independent set, by the order, of the
graph of similar vectors, and that is found in rounds: the first ``block`` vectors that are left of each group settle among
themselves; then the new leaders are shown to all that is left, in blocks, and what is similar to one goes. A group of up to
``block`` vectors is settled in one go. No task holds more than two blocks, whatever a group's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .pairs import BROADCAST_ROWS, FLOOR_DIGITS, matrix, unit
from .tables import ensure_importable, maybe_broadcast, stored

#: Vectors that settle among themselves in a task.
BLOCK = 4096
#: Of these, so many by one product, and rows that the new leaders among them are shown to at a time.
TOGETHER, ROWS = 256, 4096


def greedy_leaders(x: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the leaders among the rows of ``x``, in order. Rows settle ``TOGETHER`` at a time, by one product of all of
    them; then what is similar to a leader goes from the rest, by another."""
    x, kept, left = unit(x), [], np.arange(len(x))
    while len(left):
        head, left = left[:TOGETHER], left[TOGETHER:]
        near = np.round(x[head] @ x[head].T, FLOOR_DIGITS) >= threshold
        gone, leaders = np.zeros(len(head), bool), []
        if np.triu(near, 1).any():
            for i in range(len(head)):
                if not gone[i]:
                    leaders.append(i)
                    gone |= near[i]
            new = head[leaders]
        else:
            new = head
        kept.append(new)
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            left[at : at + ROWS] = np.where((np.round(x[some] @ x[new].T, FLOOR_DIGITS) >= threshold).any(axis=1), -1, some)
        left = left[left >= 0]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _settled(threshold: float):
    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return table.take(pa.array(greedy_leaders(matrix(table.column("vector")), threshold)))

    return settle


def _unlike(threshold: float):
    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        own, new = matrix(left.column("vector")), matrix(right.column("vector"))
        if not len(own) or not len(new):
            return left.select(["doc", "id", "vector"])
        width = max(own.shape[1], new.shape[1])
        own, new = (unit(np.pad(x, ((0, 0), (0, width - x.shape[1])))) for x in (own, new))
        near = (np.round(own @ new.T, FLOOR_DIGITS) >= threshold).any(axis=1)
        return left.select(["doc", "id", "vector"]).filter(pa.array(~near))

    return keep


def concept_clusters(entries: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc, id) of the leaders of each document's vectors (doc, id, vector), taken in order of id; ids of a document differ."""
    ensure_importable(entries.sparkSession)
    rows = stored(entries.select("doc", "id", vectors.doubles(F.col("vector")).alias("vector")), "vectors")
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    large = stored(rows.groupBy("doc").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "large")
    sizes = maybe_broadcast(large, BROADCAST_ROWS)
    small = rows.join(sizes, "doc", "left_anti")
    found = small.groupBy("doc").applyInArrow(_settled(threshold), schema).select("doc", "id")
    left = stored(rows.join(sizes, "doc", "left_semi"), "left")
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("doc").orderBy("id"))
        head = stored(left.withColumn("place", place).where(F.col("place") <= block).drop("place"), "head")
        new = stored(head.groupBy("doc").applyInArrow(_settled(threshold), schema), "leaders")
        found = found.unionByName(new.select("doc", "id"))
        last = head.groupBy("doc").agg(F.max("id").alias("last"))
        rest = left.join(maybe_broadcast(last, BROADCAST_ROWS), "doc").where("id > last").drop("last").join(sizes, "doc")
        dealt = rest.select("doc", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vector")
        shown = new.join(sizes, "doc").select("doc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vector")
        left = stored(dealt.groupBy("doc", "block").cogroup(shown.groupBy("doc", "block")).applyInArrow(_unlike(threshold), schema), "left")
    return found
