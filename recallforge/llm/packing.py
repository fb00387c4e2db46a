"""Sequence packing by cutting-stock column generation.

Documents are tokenised once, where they lie, and cut into pieces of at most ``seq_len`` ids; all that leaves the
executors is one small row per piece. Piece lengths, rounded up to a unit, give a histogram of at most
``seq_len / unit`` classes, whatever the size of the corpus. The driver solves the linear program over patterns of that
histogram (a pattern says how many pieces of each class share a sequence); new patterns are priced by a knapsack dynamic
program. Rounded patterns become slots, and pieces, ranked within their class, take the slots in order.

Ranks are counted in two steps (rows per hash range of a class, then within it), so a class with a third of all pieces
never meets in one task.

Defined cases: a null or empty text is a document with only the end id; repeated rows are packed each; a null doc_id is
kept; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ensure_importable, frugal, portions, ranges, stored
from ._tokens import Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, vocabulary: str, seq_len: int, end_id: int) -> DataFrame:
    """One row per piece: full sequences first, then what is left of the document."""

    def cut(batches):
        encoder = Encoder.of(vocabulary)
        for batch in portions(batches):
            ids, ends = encoder.encode(batch.column(1), end_id)
            data, totals = memoryview(ids).cast("B"), np.diff(ends, prepend=0)
            pieces = -(-totals // seq_len)
            doc = np.repeat(np.arange(len(totals)), pieces)
            start = ranges(np.zeros(len(pieces), np.int64), pieces) * seq_len
            length = np.minimum(totals[doc] - start, seq_len)
            first = (ends - totals)[doc] + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, totals[doc]))]
            yield pa.RecordBatch.from_arrays(columns, PIECES.replace(" long", "").split(", "))

    ensure_importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(frugal(cut), PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern and how many of each class it holds."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        gains = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(gains.argmax())
        best[room] = best[room - 1]
        if gains[k] > best[room] + 1e-12:
            best[room], took[room] = gains[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if (k := int(took[room])) < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= int(sizes[k])
    return float(best[capacity]), pattern


def solve_patterns(demand: dict[int, int], capacity: int, tolerance: float = 5e-4, rounds: int = 1500) -> list[tuple[int, dict[int, int]]]:
    """Column generation for the cutting-stock problem: ``[(copies, {class: pieces})]`` covering the whole demand.

    The master program is kept as the inverse of its basis; what that loses to rounding can cost sequences, never
    demand, since coverage is counted from the patterns themselves. It ends when Farley's bound shows that no pattern can lower
    the number of sequences by more than ``tolerance``. Copies are rounded down; what that leaves, at most one sequence
    per class, is packed first-fit decreasing.
    """
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0), int)
    if not len(sizes):
        return []
    wanted = np.array([demand[int(s)] for s in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    copies = inverse @ wanted
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + tolerance:
            break
        into = inverse @ pattern
        ratio = np.full(len(into), np.inf)
        np.divide(copies, into, out=ratio, where=into > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / into[out]
        inverse -= np.outer(into, row)
        inverse[out] = row
        copies = np.maximum(inverse @ wanted, 0)
    whole = np.floor(copies + 1e-7)
    found = [(int(n), {int(s): int(k) for s, k in zip(sizes, column) if k > 0}) for n, column in zip(whole, basis.T) if n > 0]
    left = np.maximum(wanted - basis @ whole, 0).round().astype(int)
    open_bins: list[list] = []
    for s, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            home = next((b for b in open_bins if b[0] >= s), None)
            if home is None:
                open_bins.append(home := [capacity, {}])
            home[0] -= s
            home[1][s] = home[1].get(s, 0) + 1
    return found + [(1, b[1]) for b in open_bins]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, first sequence, pieces per sequence): who sits where."""
    rows, taken, sequence = [], {}, 0
    for copies, pattern in patterns:
        for size, pieces in sorted(pattern.items()):
            first = taken.get(size, 0)
            taken[size] = first + copies * pieces
            rows.append((size, first, taken[size], sequence, pieces))
        sequence += copies
    return rows


def pack_documents(docs: DataFrame, vocabulary: str, seq_len: int = 2048, end_id: int = 1, unit: int = 8, rows_per_range: int = 20_000) -> DataFrame:
    """Pieces with their sequence_id and offset; see the module for method and defined cases."""
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, vocabulary, seq_len, end_id), "pieces").withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    demand = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # seq_len / unit rows at most
    plan = slots(solve_patterns(demand, seq_len // unit))
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 1)], "size int, first long, after long, sequence long, per long")

    spread = max(32, -(-sum(demand.values()) // rows_per_range))
    ranged = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "start"), F.lit(spread)).cast("int"))
    counts = ranged.groupBy("size", "range").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("size", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("size", "range").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        ranged.withColumn("nth", F.row_number().over(within) - 1)
        .join(base, ["size", "range"])
        .withColumn("rank", F.col("base") + F.col("nth"))
    )
    seat = F.col("rank") - F.col("first")
    seated = ranked.join(F.broadcast(table), "size").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    seated = seated.withColumn("sequence_id", F.col("sequence") + F.floor(seat / F.col("per")).cast("long"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset")
    return seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
