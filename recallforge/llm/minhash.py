"""MinHash near-duplicate groups: one-permutation hashing with optimal densification, bands, star-shaped candidates.

1. One pass over the texts makes each document's set of 5-word shingles, its one-permutation signature (the smallest
   hash in each of BINS bins; an empty bin takes the value of the first full bin in its own random order), the keys of
   BANDS bands of ROWS bins, and a sketch of one byte per bin. Documents with equal sets are one from here on.
2. Within a bucket (documents that agree in a band) only a star is drawn: from the member that shares most buckets with
   others to each of the rest. Star edges number no more than bucket entries, however large a group of copies.
3. Edges that sizes and sketches leave open are confirmed on full shingle sets; components follow.
4. Buckets that still hold several components are completed: each member outside the bucket's main component meets, in
   blocks of bounded size, every member of another component. What their sketches leave open fetches the full sets to
   the block and is confirmed there, and a block answers with one link for each two components that it ties, so rows
   grow with bucket entries and never with pairs. A link between different components is lost only if no band finds it:
   at similarity 0.75 once in 80 million pairs.

Sketches only ever rule out pairs SLACK below the threshold, over four standard deviations.

Defined cases: a document with fewer than five words has its word sequence as its one shingle; null, empty or blank
text gives an empty set, is linked with nothing and kept; a row without doc_id is linked with nothing and kept, with a
null component; rows that repeat a doc_id are one document with the links of all of its texts, and each row has the
size of its own set; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import _MULTIPLIER, ensure_importable, frugal, maybe_broadcast, mixed, ranges, shingle_sets, stored
from .components import components

BINS, BANDS, ROWS = 512, 48, 4
SIMILARITY = 75
#: How far below the threshold a sketch's estimate must lie to rule a pair out.
SLACK = 0.09
#: Members of a bucket that are compared with one another at a time, if they have at most so many shingles each; of
#: larger ones fewer, so that a block's sets are bounded.
BLOCK, BLOCK_SHINGLES = 512, 4096
#: So many ids are broadcast to pick documents; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


@lru_cache(1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin, a random order of all bins, and the place of each bin in it."""
    keys = mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * _MULTIPLIER).reshape(BINS, BINS)
    order = np.argsort(keys, axis=1)
    return order, np.argsort(order, axis=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, not empty set of hashes: BINS values."""
    bins = (shingles >> np.uint64(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    present = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[present] = shingles[first]
    full = np.zeros(BINS, bool)
    full[present] = True
    order, place = _orders()
    rest = np.flatnonzero(~full)
    for probe in range(6):
        if not len(rest):
            return out
        at = order[rest, probe]
        hit = full[at]
        out[rest[hit]] = out[at[hit]]
        rest = rest[~hit]
    if len(rest):
        out[rest] = out[present[place[np.ix_(rest, present)].argmin(axis=1)]]
    return out


_BAND_NUMBERS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = _BAND_NUMBERS.copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = (key ^ rows[:, i]) * _MULTIPLIER
            key ^= key >> np.uint64(32)
        return mixed(key).view(np.int64)


def _signatures(batches):
    salt = np.uint64(0xD1B54A32D192ED03)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n, k1, k2, bands, sketch = [], [], [], [], []
            for s in shingle_sets(part.column(1).to_pylist()):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    a, b = np.add.reduce(mixed(s)), np.add.reduce(mixed(s ^ salt))
                k1.append(int(np.uint64(a).view(np.int64)))
                k2.append(int(np.uint64(b).view(np.int64)))
                if len(s):
                    sig = signature(s)
                    bands.append(keys := band_keys(sig))
                    sketch.append((sig >> np.uint64(8)).astype(np.uint8).tobytes() + keys.astype("<i4").tobytes())
                else:
                    bands.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNATURES of ``docs`` (doc_id, text); n_shingles 0 has neither bands nor sketch."""
    ensure_importable(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(frugal(_signatures), SIGNATURES)


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of bytes per sketch: one for each bin, then four of each band's key."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS + 4 * BANDS)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches agree in as many bins as the threshold, less the slack, demands; a byte agrees by chance in 1 of 256."""
    least = SIMILARITY / 100 - SLACK
    return (a[..., :BINS] == b[..., :BINS]).sum(axis=-1) >= BINS * (least + (1 - least) / 256)


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which the sketches agree."""
    keys = [np.ascontiguousarray(x[..., BINS:]).view("<i4") for x in (a, b)]
    return (keys[0] == keys[1]).argmax(axis=-1)


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, s): the sorted shingle sets of the documents in ``ids`` (id)."""

    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist())], pa.list_(pa.int64()))], ["id", "s"])

    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    return stored(texts.join(maybe_broadcast(ids, BROADCAST_IDS), "id", "left_semi").mapInArrow(frugal(sets), "id long, s array<long>"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets reach the threshold."""
    found = full_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), docs)
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * SIMILARITY).select("a", "b").distinct()


def _similar(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and sketches leave open."""

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(_close(_sketches(batch.column(2)), _sketches(batch.column(3)))))

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    known = sketches.join(maybe_broadcast(ids, BROADCAST_IDS), "id", "left_semi")
    a, b = (known.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(_sizes_allow(F.col("na"), F.col("nb")))
    return both.select("a", "b", "sa", "sb").mapInArrow(frugal(test), "a long, b long")


def star_edges(members: DataFrame) -> DataFrame:
    """(a, b): per bucket of ``members`` (key, id, n), its most shared member and each other one."""
    score = members.groupBy("id").agg(F.sum("n").alias("score"))
    hubs = members.join(score, "id").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("h"))
    hubs = hubs.select("key", (-F.col("h.id")).alias("b"))
    return members.join(hubs, "key").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


class _Block:
    """One block of a bucket's strangers and members."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.components, self.sizes, self.classes = (table.column(c).to_numpy() for c in ("id", "component", "n", "class"))
        self.band, self.group = (table.column(c)[0].as_py() for c in ("band", "group"))
        stranger = table.column("stranger").to_numpy(zero_copy_only=False)
        self.strangers, self.others = np.flatnonzero(stranger), np.flatnonzero(~stranger)
        self.sketch = _sketches(table.column("sketch"))

    def open_with(self, i: int, components: np.ndarray) -> np.ndarray:
        """The members that could be similar to stranger ``i`` and differ in ``components``; each pair in one group and
        in its first band only."""
        js, n = self.others, self.sizes
        js = js[(components[js] != components[i]) & (np.maximum(self.classes[js], self.classes[i]) == self.group)]
        js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * SIMILARITY]
        if len(js):
            js = js[_close(self.sketch[js], self.sketch[i])]
        return js[_first_band(self.sketch[js], self.sketch[i]) == self.band] if len(js) else js


def _open_members(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The rows of a block that are in a pair which sketches leave open."""
    block = _Block(table)
    wanted = np.zeros(table.num_rows, bool)
    for i in block.strangers:
        js = block.open_with(i, block.components)
        wanted[js] = True
        wanted[i] |= len(js) > 0
    return table.filter(pa.array(wanted))


def _ties(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(a, b): of the pairs of a block that full sets confirm, as many as tie the components that they connect."""
    block = _Block(table)
    sets = table.column("s").combine_chunks()
    flat = sets.flatten().to_numpy().view(np.uint64)
    counts = pc.list_value_length(sets).to_numpy().astype(np.int64)
    starts = np.cumsum(counts) - counts
    components, left, right = block.components.copy(), [], []
    for i in block.strangers:
        js = block.open_with(i, components)
        if not len(js):
            continue
        own, theirs = flat[starts[i] : starts[i] + counts[i]], flat[ranges(starts[js], counts[js])]
        hits = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(hits, np.cumsum(counts[js]) - counts[js], dtype=np.int64)
        for j in js[common * 100 >= (counts[js] + counts[i] - common) * SIMILARITY]:
            if components[j] != components[i]:
                left.append(min(block.ids[i], block.ids[j]))
                right.append(max(block.ids[i], block.ids[j]))
                components[components == components[j]] = components[i]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


MEMBERS = "key long, group int, i int, j int, band int, id long, component long, class int, stranger boolean, n long, sketch binary"


def crossing_links(members: DataFrame, labels: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links in a common bucket of ``members`` between components of ``labels`` (node, component); as many as tie
    the components that are linked."""
    labelled = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Classes are a factor of 1 / SIMILARITY wide, so two similar documents are of one class or of neighbouring ones and
    # meet in the group of the larger one.
    size_class = F.ceil(F.log(F.col("size") / float(BLOCK_SHINGLES)) / math.log(100 / SIMILARITY))
    labelled = labelled.withColumn("class", F.greatest(F.lit(0), size_class).cast("int"))
    groups = F.when(F.col("size") * 100 <= BLOCK_SHINGLES * SIMILARITY, F.array("class")).otherwise(F.array("class", F.col("class") + 1))
    labelled = labelled.select("key", "band", "id", "component", "class", F.explode(groups).alias("group"))
    sizes = labelled.groupBy("key", "group", "component").agg(F.count("*").alias("rows"))
    mixed_ = sizes.groupBy("key", "group").agg(F.max(F.struct("rows", "component"))["component"].alias("main"), F.max("rows").alias("in_main"), F.sum("rows").alias("rows"))
    mixed_ = mixed_.where(F.col("in_main") < F.col("rows"))
    rows = labelled.join(mixed_, ["key", "group"]).withColumn("stranger", F.col("component") != F.col("main"))
    width = F.greatest(F.lit(1), F.floor(BLOCK * F.pow(F.lit(SIMILARITY / 100), F.col("group"))))
    outside = F.ceil((F.col("rows") - F.col("in_main")) / width).cast("int")
    everyone = F.ceil(F.col("rows") / width).cast("int")
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    as_any = F.transform(F.sequence(F.lit(0), outside - 1), lambda i: F.struct(i.alias("i"), at(everyone).alias("j"), F.lit(False).alias("stranger")))
    as_stranger = F.transform(F.sequence(F.lit(0), everyone - 1), lambda j: F.struct(at(outside).alias("i"), j.alias("j"), F.lit(True).alias("stranger")))
    blocks = rows.select("key", "group", "band", "id", "component", "class", F.explode(F.when(F.col("stranger"), F.concat(as_any, as_stranger)).otherwise(as_any)).alias("at")).select("key", "group", "band", "id", "component", "class", "at.*")
    ids = rows.select("id").distinct()
    known = sketches.join(maybe_broadcast(ids, BROADCAST_IDS), "id", "left_semi")
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    wanted = stored(blocks.join(known, "id").select(names).groupBy("key", "group", "i", "j").applyInArrow(_open_members, MEMBERS), "open")
    sets = full_sets(wanted.select("id").distinct(), docs)
    return wanted.join(sets, "id").select(*names, "s").groupBy("key", "group", "i", "j").applyInArrow(_ties, "a long, b long").distinct()


def _own_texts(whole: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): documents that have several texts, tied to the group of each."""
    several = whole.groupBy("doc_id").agg(F.min("k1").alias("k"), F.max("k1").alias("l")).where("k <> l").select("doc_id")
    return whole.join(several, "doc_id", "left_semi").join(groups, ["k1", "k2"]).select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; see the module for method and defined cases."""
    docs = docs.select("doc_id", "text")
    sigs = stored(signatures(docs), "signatures")
    whole = sigs.where("doc_id is not null and n_shingles > 0")
    groups = stored(whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "groups")
    reps = whole.join(groups.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    entries = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key")).distinct()
    full = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(entries.join(full, "key"), "members")
    sketches = whole.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    first = stored(confirmed(stored(_similar(star_edges(members), sketches), "pairs"), docs).unionByName(_own_texts(whole, groups)), "links")
    labels = stored(components(first), "labels")
    links = stored(first.unionByName(crossing_links(members, labels, sketches, docs)), "links")
    labels = components(links)
    of_group = groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    found = sigs.select("doc_id", "n_shingles", "k1", "k2").join(of_group, ["k1", "k2"], "left")
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", linked.alias("component_id"), F.coalesce(F.col("doc_id") == linked, F.lit(True)).alias("kept"))
