"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors of a label are one point with a multiplicity from the start. Centroids are fitted by spherical k-means on
a bounded sample. Every point lies in the cell of its nearest centroid; it also visits each cell that could hold a point
within the threshold of it: if x is nearest to c and y to c', then the distance from y to the plane midway between c and
c' is at most |x - y|, so y need visit the cell of c only if (y.c' - y.c) / |c' - c| is at most that distance. No pair
is lost by this, and each ordered pair of points is met in one cell only.

Within a label and cell, residents and visitors are compared in blocks of bounded size by matrix products in double
precision. Links and components of points are then given to all their copies.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component, and vectors of a null label, are
linked with nothing; vectors of different length are not compared; rows that repeat a vec_id are copies of it like any
others; a null vec_id takes part in counts but has no component of its own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ensure_importable, frugal, stored
from .components import components

#: Points in a cell on average, points compared at a time, and rows of the sample that centroids are fitted on.
CELL, BLOCK, SAMPLE = 16_384, 4096, 20_000
#: Rows of a block that are multiplied at a time.
STRIP = 512
#: What rounding may take from a distance bound.
MARGIN = 1e-6
#: Centroids nearer to one another than this are one: points that lie between them lie in the first.
SAME = 1e-7


def spherical_kmeans(points: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit ``points``, started from points spread evenly over the sample; no more than points."""
    centroids = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(points[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


PACKED = "vec_id long, label {label}, width int, v binary"


def _pack(batches):
    """Vectors scaled to length 1 as little-endian doubles; null for one that nothing can be linked with."""
    for batch in batches:
        column = batch.column(2)
        ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()])
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")  # a null component becomes NaN
        widths, data = [], []
        for start, end, labelled in zip(np.append(0, ends), ends, batch.column(1).is_valid().to_pylist()):
            v = flat[start:end]
            top = np.abs(v).max() if len(v) else 0.0
            usable = labelled and np.isfinite(top) and top > 0
            if usable:
                v = v / top  # so that no square overflows
                v = v / np.sqrt(v @ v)
            widths.append(len(v) if usable else None)
            data.append(v.tobytes() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(widths, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "label", "width", "v"])


def _assign(width: int, centroids: np.ndarray, reach: float):
    """The cells that each point lives in or visits."""
    squares = (centroids * centroids).sum(axis=1)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(2), width)
                dots = x @ centroids.T
                home = dots.argmax(axis=1)
                best = dots[np.arange(len(x)), home]
                homes, of = np.unique(home, return_inverse=True)
                gaps = np.sqrt(np.maximum(squares[homes, None] + squares[None] - 2 * centroids[homes] @ centroids.T, 0.0))
                gaps[gaps < SAME] = np.inf  # equal centroids: only the first has residents
                visits = (best[:, None] - dots) / gaps[of] <= reach
                visits[np.arange(len(x)), home] = True
                row, cell = np.nonzero(visits)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell, pa.int32()), pa.array(cell == home[row]), taken.column(2), taken.column(3)], ["id", "label", "cell", "resident", "v", "copies"])

    return assign


def _compare(width: int, least: float):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of each point its links, counted in copies, and a tie to one point of its component in this block."""
        resident = table.column("resident").to_numpy(zero_copy_only=False)
        ids, x, copies = table.column("id").to_numpy(), _matrix(table.column("v"), width), table.column("copies").to_numpy()
        rows, others = np.flatnonzero(~resident), np.flatnonzero(resident)
        strips = [rows[i : i + STRIP] for i in range(0, len(rows), STRIP)]
        links = np.concatenate([(x[r] @ x[others].T >= least) & (ids[r][:, None] != ids[others][None]) for r in strips] or [np.zeros((0, len(others)), bool)])
        keep, kept = links.any(axis=1), links.any(axis=0)
        links, rows, others = links[np.ix_(keep, kept)], rows[keep], others[kept]
        if not len(rows):
            return pa.table({n: pa.array([], pa.int64()) for n in ("a", "b", "n")})
        label = np.arange(len(rows), dtype=np.int32)
        while True:  # the smallest row number spreads along links
            of_others = np.where(links, label[:, None], np.int32(len(rows))).min(axis=0)
            new = np.minimum(label, np.where(links, of_others[None], np.int32(len(rows))).min(axis=1))
            if (new == label).all():
                break
            label = new
        a = np.concatenate([ids[rows], ids[others]])
        b = ids[rows][np.concatenate([label, of_others])]
        n = np.concatenate([links @ copies[others], np.zeros(len(others), np.int64)])
        return pa.table({"a": a, "b": b, "n": n})

    return compare


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ensure_importable(spark)
    plain = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>"))
    packed = plain.mapInArrow(frugal(_pack), PACKED.format(label=dict(plain.dtypes)["label"]))
    every = stored(packed.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit(1), "v", "label")), "packed")
    packed = every.where("v is not null")
    groups = packed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("width").alias("width"), F.first("v").alias("v"))
    groups = stored(groups.withColumn("id", F.col("k1")), "groups")
    found = None
    for width, n in sorted((r["width"], r["n"]) for r in groups.groupBy("width").agg(F.count("*").alias("n")).collect()):
        more = _links(groups.where(F.col("width") == width), int(width), int(n), threshold)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    found = stored(found, "links")
    weight = found.groupBy("a").agg(F.sum("n").alias("others"))
    labels = components(found.select("a", "b"))
    named = groups.join(weight, groups["id"] == weight["a"], "left").join(labels, groups["id"] == labels["node"], "left")
    named = stored(named.select("k1", "k2", "least", F.coalesce("component", "id").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "component").select("k1", "k2", "n_links", "component_id")
    linked = packed.select("vec_id", "k1", "k2").join(answer, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = every.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def _links(groups: DataFrame, width: int, n: int, threshold: float) -> DataFrame:
    """(a, b, n): a point, one of its component, and copies it is linked with, as each block of points of one label has it."""
    spark = groups.sparkSession
    sample = groups.orderBy(F.xxhash64(F.lit(7), "id")).limit(SAMPLE).select("v").toPandas()["v"]
    centroids = spherical_kmeans(np.frombuffer(b"".join(map(bytes, sample)), "<f8").reshape(-1, width), max(1, math.ceil(n / CELL)))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + MARGIN
    kind = dict(groups.dtypes)["label"]
    placed = stored(groups.select("id", "label", "v", "copies").mapInArrow(frugal(_assign(width, centroids, reach)), f"id long, label {kind}, cell int, resident boolean, v binary, copies long"), "cells")
    sizes = placed.groupBy("label", "cell").agg(F.count_if("resident").alias("residents"), F.count("*").alias("all"))
    blocks = sizes.select("label", "cell", F.ceil(F.col("residents") / BLOCK).cast("int").alias("bi"), F.ceil(F.col("all") / BLOCK).cast("int").alias("bj")).where("bi > 0")
    rows = placed.join(F.broadcast(blocks) if len(centroids) <= 1000 and blocks.limit(100_001).count() <= 100_000 else blocks, ["label", "cell"])
    at = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    as_any = F.transform(F.sequence(F.lit(0), F.col("bi") - 1), lambda i: F.struct(i.alias("i"), at(F.col("bj")).alias("j"), F.lit(False).alias("resident")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("bj") - 1), lambda j: F.struct(at(F.col("bi")).alias("i"), j.alias("j"), F.lit(True).alias("resident")))
    spread = rows.select("id", "label", "cell", "v", "copies", F.explode(F.when(F.col("resident"), F.concat(as_any, as_home)).otherwise(as_any)).alias("p")).select("id", "label", "cell", "v", "copies", "p.*")
    return spread.groupBy("label", "cell", "i", "j").applyInArrow(_compare(width, threshold), "a long, b long, n long")
