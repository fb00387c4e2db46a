"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are dealt by the hash of their id into blocks of bounded size, queries into batches, and every block is searched
for every batch, in a task of its own. In a block, each code is indexed by each of its segments. A query looks up its own segments, then all segment values at
distance 1, 2, ... Once all segments have been searched to radius r, every code within ``segments * (r + 1) - 1`` of the
query has been seen: if that differed by more than r in every segment it would be farther. So the search ends when the
kth verified distance is within this bound, and no earlier. The best k of each block are merged into the best k of all.

Ties at the kth distance go to the smaller id; a vector is not its own neighbour.

Defined cases: the code has a 1 where a component is greater than 0, so null and NaN components give 0; a null vector
has no code, neither asks nor answers; a vector of another length than ``bits`` is not compared; a null id is skipped;
rows that repeat an id answer each; fewer than k other vectors give fewer rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ensure_importable, stored

#: Codes in an index block, and queries in a batch, on average.
BLOCK, BATCH = 16_384, 65_536
SEGMENT_BITS = 16


def sign_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """id and code: bit i (from the lowest, 64 to a word) is set if component i is greater than 0."""

    def word(v: Column, at: int) -> Column:
        part = F.slice(v, at + 1, min(64, bits - at))
        flag = lambda x, i: F.when(x.isNotNull() & ~F.isnan(x) & (x > 0), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.transform(part, flag), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    v = F.col("v")
    vectors = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == bits))
    return vectors.select("id", F.array(*[word(v, at) for at in range(0, bits, 64)]).alias("code"))


class MultiIndex:
    """One block of codes (rows of 16-bit segments), indexed by every segment."""

    def __init__(self, ids: np.ndarray, segments: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.segments = ids[order], np.ascontiguousarray(segments[order])
        self.tables = []
        for s in range(self.segments.shape[1]):
            values = self.segments[:, s]
            by = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[by], np.arange((1 << SEGMENT_BITS) + 1))
            self.tables.append((by, starts))
        self._masks: list[np.ndarray] = []

    def masks(self, radius: int) -> np.ndarray:
        while len(self._masks) <= radius:
            r = len(self._masks)
            self._masks.append(np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), r)], np.int64))
        return self._masks[radius]

    def distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.segments[rows] ^ query).sum(axis=1, dtype=np.int64)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest codes, by distance and id."""
        seen = np.zeros(len(self.ids), bool)
        rows, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            found = []
            for s, (by, starts) in enumerate(self.tables):
                at = self.masks(radius) ^ int(query[s])
                a, b = starts[at], starts[at + 1]
                some = b > a
                a, n = a[some], (b - a)[some]
                if len(n):
                    ends = np.cumsum(n)
                    found.append(by[np.arange(ends[-1]) + np.repeat(a - (ends - n), n)])
            if found:
                hits = np.unique(np.concatenate(found))
                hits = hits[~seen[hits]]
                seen[hits] = True
                rows, dist = np.concatenate([rows, hits]), np.concatenate([dist, self.distances(hits, query)])
                best = np.lexsort((rows, dist))[:k]
                rows, dist = rows[best], dist[best]
            covered = len(self.tables) * (radius + 1) - 1
            if len(dist) == k and dist[-1] <= covered or seen.all():
                break
        return self.ids[rows], dist


def _search(k: int):
    def search(key: tuple[pa.Scalar, ...], index: pa.Table, asked: pa.Table) -> pa.Table:
        words = lambda t: np.array(t.column("code").to_pylist(), np.int64).reshape(t.num_rows, -1)
        cut = lambda w: np.ascontiguousarray(w).view(np.uint16)
        out: list[tuple[int, int, int]] = []
        if index.num_rows and asked.num_rows:
            table = MultiIndex(index.column("id").to_numpy(), cut(words(index)))
            for query, code in zip(asked.column("id").to_pylist(), cut(words(asked))):
                itself = int(np.searchsorted(table.ids, query, 'right') - np.searchsorted(table.ids, query))
                ids, dist = table.search(code, k + itself)
                out += [(query, i, d) for i, d in zip(ids.tolist(), dist.tolist()) if i != query]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "distance"), columns)})

    return search


def top_k(vectors: DataFrame, asks: Column, bits: int = 64, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest codes of each row of ``vectors`` for which ``asks`` holds.

    ``asks`` is a condition on ``id``. An id that has several vectors asks with each of them, and what they find is ranked
    together.
    """
    ensure_importable(vectors.sparkSession)
    codes = stored(sign_codes(vectors, bits), "codes")
    wanted = codes.where(asks)
    blocks, batches = max(1, -(-codes.count() // BLOCK)), max(1, -(-wanted.count() // BATCH))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = codes.withColumn("block", dealt(blocks)).withColumn("batch", every(batches))
    asked = wanted.withColumn("batch", dealt(batches)).withColumn("block", every(blocks))
    # A number of partitions that is asked for is kept, so that small blocks are not put together in one task.
    tasks, keys = min(4 * blocks * batches, 20_000), ["block", "batch"]
    sides = [x.repartition(tasks, *keys).groupBy(*keys) for x in (index, asked)]
    found = sides[0].cogroup(sides[1]).applyInArrow(_search(k), "query_id long, vec_id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
