"""Mixing sources to target weights, with DataFrame functions only.

A source's target share of all words is its weight's share, held at ``max_repeats`` times its size; what that frees is
shared among the others by weight. Documents are cut into blocks of ``block_words`` words. Each source takes all of its
blocks as often as the target holds them whole, and of one more round a prefix of a keyed permutation of its blocks, up
to the block at which the words come closest to the target. That is the source's exact quota of blocks.

The quotas are dealt to output shards by a binary tree: at each node the left half of the shards draws its blocks from
the node's quotas by a multivariate hypergeometric distribution, one univariate conditional draw per source, inverted
from its exact recursion; the right half keeps the rest. What a leaf was dealt is a range of each source's draws, and a
block is in the mix only as a draw that a leaf holds: shards are disjoint and together hold the quotas exactly. Within
its shard a block's place is the order of a keyed hash.

Running sums over a permutation are taken in two steps, per hash range of the source and within it, so a source with a
third of all rows is spread over tasks. One row per source meets in one task, nothing else does.

Defined cases: a null or empty text has size 0, is drawn never and still has its row; a null source is a source of its
own, last in order; repeated rows are drawn as separate documents; an empty table gives no rows; other columns are
ignored. The same rows and seed give the same mix whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import maybe_broadcast, stored, word_count

WEIGHTS = (5, 2, 1)
#: Standard deviations (and blocks) around the mean in which a hypergeometric draw is looked for; beyond lie 1e-15.
SPREAD = 8.0
#: So many sources are joined by broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: So many ranges of draws, of six numbers each, are joined by broadcast; more are joined by shuffle.
BROADCAST_RANGES = 200_000
#: At this depth, the tree's nodes are spread over tasks.
SPREAD_LEVEL = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items are marked, of ``total`` of which ``marked`` are: the inverse of the distribution at u.

    Weights follow ``p(k+1)/p(k) = (marked-k)(drawn-k) / ((k+1)(total-marked-drawn+k+1))`` from the low end of the
    window, so nothing but their sum is needed to scale them.
    """
    n, k_all, d = (x.cast("double") for x in (total, marked, drawn))
    mean = F.when(n > 0, d * k_all / n).otherwise(0.0)
    sd = F.when(n > 1, F.sqrt(mean * (1 - k_all / n) * (n - d) / (n - 1))).otherwise(0.0)
    low = F.greatest(F.lit(0.0), d - (n - k_all), F.floor(mean - SPREAD * sd - SPREAD).cast("double"))
    high = F.least(d, k_all, F.ceil(mean + SPREAD * sd + SPREAD).cast("double"))

    def ratio(k: Column) -> Column:
        return (k_all - k) * (d - k) / ((k + 1) * (n - k_all - d + k + 1))

    def inside(bound: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), bound["ks"][0].alias("x"))

        def add(a: Column, k: Column) -> Column:
            return F.struct((a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"]).alias("sum"), a["x"].alias("x"))

        def find(goal: Column) -> Column:
            def step(a: Column, k: Column) -> Column:
                x = F.when(a["sum"] + a["w"] < goal, F.least(k + 1, bound["high"])).otherwise(a["x"])
                return F.struct((a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"]).alias("sum"), x.alias("x"))

            return F.aggregate(bound["ks"], start, step, lambda a: a["x"])

        return let(F.aggregate(bound["ks"], start, add, lambda a: a["sum"]) * u, find)

    ks = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda k: k.cast("double"))
    drawing = let(F.struct(ks.alias("ks"), high.alias("high")), inside).cast("long")
    return F.when((marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(drawn >= total, marked).otherwise(drawing)


def left_half(quotas: Column, seed: int, node: Column) -> Column:
    """Of a node's quotas, what the left half of its shards draws: a multivariate hypergeometric draw."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(F.array().cast("array<bigint>").alias("xs"), total.alias("left"), F.floor(total / 2).cast("long").alias("draws"))

    def source(a: Column, q: Column) -> Column:
        u = unit(F.lit(seed), node, F.size(a["xs"]))
        return let(
            hypergeometric(a["left"], q, a["draws"], u),
            lambda x: F.struct(F.concat(a["xs"], F.array(x)).alias("xs"), (a["left"] - q).alias("left"), (a["draws"] - x).alias("draws")),
        )

    return F.aggregate(quotas, start, source, lambda a: a["xs"])


def shard_quotas(sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, index, count, first): of source ``index``, the shard holds draws first .. first + count - 1.

    ``sources`` has one row per source with index 0, 1, ... and its quota of blocks.
    """
    nodes = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "quota"))), lambda s: s["quota"]).alias("quotas"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(levels):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition(1 << SPREAD_LEVEL, "node")
        halves = let(
            left_half(F.col("quotas"), seed, F.col("node")),
            lambda xs: F.array(
                F.struct((F.col("node") * 2).alias("node"), xs.alias("quotas")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", xs, lambda q, x: q - x).alias("quotas")),
            ),
        )
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.node", "h.quotas")
    leaves = nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.posexplode("quotas").alias("index", "count"))
    before = Window.partitionBy("index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): its index in order, weight and target.

    With sources by growing cap per weight, the first one whose cap holds the level that would be left for it and all
    after it sets the level; each target is the level times the weight, or the cap.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("index", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "index")
    all_rows = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("index"), F.col("level").alias("level")))
    rows = rows.withColumn("level", F.min(holds).over(all_rows)["level"])
    return rows.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("cap", "level")


class Mix:
    """The mix of ``docs`` (doc_id, text, source).

    ``documents``: doc_id, source, size, copy, source_size, target; one row per document.
    ``draws``: doc_id, source, size, copy, block, words, repeat, shard, place; one row per drawn block.
    ``levels``, ``quotas``: depth and leaves of the tree.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, block_words: int = 128, shard_words: int = 4_000_000, seed: int = 20_240_601, rows_per_range: int = 20_000) -> None:
        counted = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        grouped = stored(counted.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")
        blocks = F.ceil(F.col("size") / block_words).cast("long")
        sizes = grouped.groupBy("source").agg(
            F.sum(F.col("size") * F.col("copies")).alias("source_size"),
            F.sum(blocks * F.col("copies")).alias("blocks"),
        )
        targets = source_targets(sizes, weights, max_repeats)
        targets = stored(
            targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
            .withColumn("ranges", F.greatest(F.lit(64), F.ceil(F.col("blocks") / rows_per_range)).cast("long")),
            "targets",
        )
        small = maybe_broadcast(targets, BROADCAST_SOURCES)
        joined = grouped.join(small, grouped["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        self.documents = joined.select("doc_id", "source", "size", "copy", "source_size", "target")
        cut = joined.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        key = F.xxhash64(F.lit(seed), "doc_id", "source", "size", "copy", "block")
        cut = cut.select(
            "doc_id", "source", "size", "copy", "block", "index", "full", "rest", "blocks",
            F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"),
            key.alias("key"),
            F.shiftright(F.shiftrightunsigned(key, 33) * F.col("ranges"), 31).alias("range"),
        )
        cut = stored(cut, "blocks")
        sums = cut.groupBy("index", "range").agg(F.sum("words").alias("words"), F.count("*").alias("rows"))
        ahead = Window.partitionBy("index").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("index", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("words_base"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_base"))
        within = Window.partitionBy("index", "range").orderBy("key", "doc_id", "size", "copy", "block")
        before = within.rowsBetween(Window.unboundedPreceding, -1)
        ranked = (
            cut.withColumn("words_in", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .withColumn("rows_in", F.row_number().over(within) - 1)
            .join(bases, ["index", "range"])
            .withColumn("rank", F.col("rows_base") + F.col("rows_in"))
            .withColumn("held", F.col("words_base") + F.col("words_in") + F.col("words") / 2 <= F.col("rest"))
        )
        ranked = stored(ranked.select("doc_id", "source", "size", "copy", "block", "words", "index", "full", "blocks", "rank", "held"), "ranked")
        whole = targets.select("index", (F.col("full") * F.col("blocks")).alias("whole"), (F.col("full") * F.col("source_size")).alias("words"))
        more = ranked.where("held").groupBy("index").agg(F.count("*").alias("more"), F.sum("words").alias("more_words"))
        dealt = whole.join(more, "index", "left").select("index", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("quota"), (F.col("words") + F.coalesce("more_words", F.lit(0))).alias("words"))
        dealt = stored(dealt, "dealt")
        total = dealt.agg(F.sum("words")).first()[0] or 0
        self.levels = max(0, (-(-total // shard_words) - 1).bit_length())
        self.quotas = stored(shard_quotas(dealt, self.levels, seed).where("count > 0"), "quotas")
        # A source's draws are numbered round after round, in order of rank. Ranges and draws meet in buckets as wide as
        # a source's mean range, so that few ranges lie in a bucket and few buckets in a range.
        width = F.greatest(F.lit(1), F.ceil(F.col("quota") / (1 << self.levels))).cast("long")
        widths = dealt.select("index", "quota", width.alias("width"))
        leaves = self.quotas.join(widths.select("index", "width"), "index")
        bucket = lambda x: F.floor(x / F.col("width")).cast("long")
        leaves = leaves.select("index", "shard", "first", (F.col("first") + F.col("count")).alias("after"), F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("first") + F.col("count") - 1))).alias("bucket"))
        leaves = stored(leaves, "leaves")
        draws = ranked.join(maybe_broadcast(widths, BROADCAST_SOURCES), "index").where("rank < quota")
        draws = draws.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("rank")) / F.col("blocks")).cast("long"))))
        draws = draws.withColumn("draw", F.col("repeat") * F.col("blocks") + F.col("rank")).withColumn("bucket", bucket(F.col("draw")))
        draws = draws.join(maybe_broadcast(leaves, BROADCAST_RANGES), ["index", "bucket"]).where((F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("after")))
        self.drawn = draws.select("doc_id", "source", "size", "copy", "block", "words", "repeat", "shard", F.xxhash64(F.lit(seed + 1), "index", "draw").alias("order"), "index", "draw")
        place = F.row_number().over(Window.partitionBy("shard").orderBy("order", "index", "draw")) - 1
        self.draws = self.drawn.withColumn("place", place).drop("order", "index", "draw")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, shards: how many words of each document are in the mix, and where."""
        keys = ["doc_id", "source", "size", "copy"]
        words = self.drawn.groupBy(keys).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
        d = self.documents
        same = d["doc_id"].eqNullSafe(words["doc_id"]) & d["source"].eqNullSafe(words["source"]) & (d["size"] == words["size"]) & (d["copy"] == words["copy"])
        none = F.array().cast("array<bigint>")
        return d.join(words, same, "left").select(d["doc_id"], d["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(docs: DataFrame, block_words: int = 128, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``, shard by shard in the shard's order.

    A row holds what a shard drew of a document in one round: the whole text, or the drawn blocks with the white space
    between them. n_chars follows the
    new text; other columns are kept, whatever their names.
    """
    names = docs.columns
    mix = Mix(docs, block_words=block_words, **options)
    keys = ["doc_id", "source", "size", "copy"]
    drawn = mix.drawn.groupBy(*keys, "repeat", "shard").agg(F.collect_set("block").alias("drawn"), F.min("order").alias("order"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = lambda name: plain[f"c{names.index(name)}"]
    sized = plain.withColumn("words", word_count(of("text")))
    if mix.documents.where("copy > 1").isEmpty():
        sized = sized.withColumn("nth", F.lit(1))
    else:
        sized = sized.withColumn("nth", F.row_number().over(Window.partitionBy(of("doc_id"), of("source"), "words").orderBy(of("text"))))
    same = of("doc_id").eqNullSafe(drawn["doc_id"]) & of("source").eqNullSafe(drawn["source"]) & (sized["words"] == drawn["size"]) & (sized["nth"] == drawn["copy"])
    words = F.regexp_extract_all(of("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    part = F.array_join(F.filter(words, lambda w, i: F.array_contains(F.col("drawn"), F.floor(i / block_words).cast("long"))), "")
    part = F.regexp_replace(part, r"^[\x20\x09-\x0D]+", "")
    text = F.when(F.size("drawn") * block_words >= F.col("words"), of("text")).otherwise(part)
    cut = sized.join(drawn, same).withColumn(f"c{names.index('text')}", text)
    if "n_chars" in names:
        cut = cut.withColumn(f"c{names.index('n_chars')}", F.length(f"c{names.index('text')}").cast(docs.schema["n_chars"].dataType))
    return cut.repartition("shard").sortWithinPartitions("shard", "order").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
