"""A Merkle manifest of a table: a tree per group, a tree over the groups' roots, and for each row the proof that it is in.

Leaves are sorted by range, so a group lies in parts that follow one another, and the rows of a group in earlier parts tell
where it goes on (``ordered.numbered``). Each part builds the subtrees whose leaves it holds whole; what is left are the
stems, the nodes whose parent needs a neighbour of another part: a few per level at either end. Stems are shuffled by the
coordinate of the ancestor that they share some levels higher, joined there, and so on up to the root. The way from each
stem to the root goes back to its part, which answers for its rows. A part's memory is that of its own rows, a node of the
upper levels meets the few stems below it, and the leaves travel without their texts.

H is the lowercase hex sha256 of its inputs one after the other. A leaf is H of the row's fields, each ``-`` if null, else
its bytes in UTF-8, ``:`` and the value. A node is H of up to ``ARITY`` consecutive nodes. A proof has for each level the
digests before and after the node on its way.

Defined cases: a null group is a group, the first; null keys come first; rows with equal keys lie in order of their leaves,
and equal rows have equal leaves but places and proofs of their own; a group of one row has its leaf as its root; an empty
table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ensure_importable, stored
from .ordered import consecutive, first_nulls, numbered

ARITY = 3
#: So many levels are climbed at a time: an ancestor has at most ARITY ** BAND leaves per node of the band's top.
BAND = 8
PATH = "array<struct<before: string, after: string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a task hands over at once; a proof takes some kilobytes.
_ROWS = 2000

Levels = list[tuple[int, list[str], int]]


def leaf_digest(*fields: Column) -> Column:
    def told(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(told, fields)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def grown(first: int, nodes: list[str], size: int) -> Levels:
    """Per level (place of the first node, nodes, nodes of the whole level): what follows from the leaves
    first, first + 1, ... of ``size`` without any other."""
    levels = [(first, nodes, size)]
    while size > 1:
        end, low = first + len(nodes), -(-first // ARITY)
        high = -(-end // ARITY) if end == size else end // ARITY
        if low >= high:
            break
        nodes = [parent(nodes[ARITY * p - first : ARITY * (p + 1) - first]) for p in range(low, high)]
        first, size = low, -(-size // ARITY)
        levels.append((first, nodes, size))
    return levels


def stems(levels: Levels) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of nodes whose parent is not among ``levels``."""
    for level, (first, nodes, _) in enumerate(levels):
        above = levels[level + 1] if level + 1 < len(levels) else (0, [], 0)
        known = range(above[0], above[0] + len(above[1]))
        for i, node in enumerate(nodes, first):
            if i // ARITY not in known:
                yield level, i, node


def beside(first: int, nodes: list[str], at: int) -> tuple[str, str]:
    """The siblings before and after node ``at`` of a level of which ``nodes`` are known."""
    start = ARITY * (at // ARITY)
    return "".join(nodes[start - first : at - first]), "".join(nodes[at + 1 - first : start + ARITY - first])


def _stems(placed: DataFrame, parts: int) -> DataFrame:
    def find(batches):
        for run in consecutive(batches, ["part", "of"]):
            size = run.column("size")[0].as_py()
            found = list(stems(grown(run.column("index")[0].as_py(), run.column("leaf").to_pylist(), size)))
            level, place, node = zip(*found)
            same = [run.column(c)[0] for c in ("part", "of", "size")]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(x, len(found)) for x in same), pa.array(level, pa.int64()), pa.array(place, pa.int64()), pa.array(node)], ["part", "of", "size", "level", "index", "node"])

    own = placed.select("part", "of", "size", "index", "leaf").repartition(parts, "part").sortWithinPartitions("part", *first_nulls("of", "index"))
    return own.mapInArrow(find, f"part long, of {dict(placed.dtypes)['of']}, size long, level long, index long, node string")


def _climbed(nodes: DataFrame, top: int) -> DataFrame:
    """Each node's way to its ancestor on level ``top``, or to the root if that is lower; ``last`` marks one per ancestor."""

    def climb(table: pa.Table) -> pa.Table:
        size, level = table.column("size")[0].as_py(), 0
        rows = list(zip(table.column("level").to_pylist(), table.column("index").to_pylist()))
        by_level: list[dict[int, str]] = [{} for _ in range(top + 1)]
        for (l, i), node in zip(rows, table.column("node").to_pylist()):
            by_level[l][i] = node
        steps: dict[tuple[int, int], tuple[str, str]] = {}
        while level < top and size > 1:
            for p in sorted({i // ARITY for i in by_level[level]}):
                places = range(ARITY * p, min(ARITY * (p + 1), size))
                children = [by_level[level][i] for i in places]
                steps |= {(level, i): beside(places[0], children, i) for i in places}
                by_level[level + 1][p] = parent(children)
            level, size = level + 1, -(-size // ARITY)
        paths = [[dict(zip(("before", "after"), steps[l, i // ARITY ** (l - below)])) for l in range(below, level)] for below, i in rows]
        up = [i // ARITY ** (level - below) for below, i in rows]
        n = len(rows)
        made = {
            "up_level": pa.repeat(pa.scalar(level, pa.int64()), n), "up_index": pa.array(up, pa.int64()), "up_node": pa.array([by_level[level][i] for i in up]),
            "path": pa.array(paths, pa.list_(_STEP)), "rooted": pa.repeat(pa.scalar(size == 1), n), "last": pa.array([k == 0 for k in range(n)]),
        }
        kept = {c: table.column(c) for c in ("part", "of", "size", "level", "index")}
        return pa.table(kept | made)

    band = nodes.withColumn("above", F.expr(f"index div cast(pow({ARITY}, {top} - level) as bigint)"))
    kind = dict(nodes.dtypes)["of"]
    return band.groupBy("of", "above").applyInArrow(climb, f"part long, of {kind}, size long, level long, index long, up_level long, up_index long, up_node string, path {PATH}, rooted boolean, last boolean")


def _to_root(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stems: (part, of, level, index, path, root), the whole way up; and (of, root, size) of each group."""
    rounds, roots, top = [], None, 0
    waiting = stored(nodes, "stems")
    columns = waiting.columns
    most = waiting.agg(F.max("size")).first()[0] or 1
    while ARITY**top < most or not rounds:
        top += BAND
        found = stored(_climbed(waiting.where(F.col("level") < top), top), "climbed")
        rounds.append(found)
        own = found.where("last and rooted").select("of", F.col("up_node").alias("root"), "size")
        roots = own if roots is None else roots.unionByName(own)
        next_ = found.where("last and not rooted").select(F.lit(-1).cast("long").alias("part"), "of", "size", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up_node").alias("node"))
        waiting = waiting.where(F.col("level") >= top).unionByName(next_).select(*columns)
    whole = None
    for found in reversed(rounds):
        own = found.select("part", "of", "level", "index", "path", F.when(F.col("rooted"), F.col("up_node")).alias("root"), "up_level", "up_index")
        if whole is not None:
            above = whole.where("part < 0").select(F.col("of").alias("of_"), F.col("level").alias("level_"), F.col("index").alias("index_"), F.col("path").alias("path_"), F.col("root").alias("root_"))
            same = F.col("of").eqNullSafe(F.col("of_")) & (F.col("up_level") == F.col("level_")) & (F.col("up_index") == F.col("index_"))
            own = own.join(above, same, "left").withColumn("root", F.coalesce("root", "root_")).withColumn("path", F.concat("path", F.coalesce("path_", F.array().cast(PATH))))
        own = own.select("part", "of", "level", "index", "path", "root")
        # Each round has stems of parts and, without a part, ancestors of the round below, which asks for these.
        whole = stored(own if whole is None else own.unionByName(whole), "ways")
    return whole.where("part >= 0"), stored(roots, "roots")


def _answered(placed: DataFrame, ways: DataFrame, parts: int, carried: list[str]) -> DataFrame:
    """The rows of ``placed`` with the path from each leaf through its stem, and what else ``ways`` knows of its group."""
    kinds = dict(placed.dtypes)
    known = [c for c in ways.columns if c not in ("part", "of", "level", "index", "path")]
    nothing = {"level": "long", "path": PATH} | {c: "string" for c in known}
    rows = placed.withColumns({"kind": F.lit(1)} | {c: F.lit(None).cast(k) for c, k in nothing.items()})
    both = rows.unionByName(ways.withColumn("kind", F.lit(0)), allowMissingColumns=True).select("part", "of", "kind", "index", "size", "leaf", *carried, *nothing)
    both = both.repartition(parts, "part").sortWithinPartitions("part", *first_nulls("of"), "kind", "index")

    def answer(batches):
        for run in consecutive(batches, ["part", "of"]):
            ways_here = sum(k == 0 for k in run.column("kind").to_pylist())
            head, rows = run.slice(0, ways_here), run.slice(ways_here)
            if not rows.num_rows:
                continue
            way = {(l, i): [(s["before"], s["after"]) for s in p] for l, i, p in zip(*(head.column(c).to_pylist() for c in ("level", "index", "path")))}
            same = [head.column(c)[0] for c in known]
            levels = grown(rows.column("index")[0].as_py(), rows.column("leaf").to_pylist(), rows.column("size")[0].as_py())
            for at in range(0, rows.num_rows, _ROWS):
                some = rows.slice(at, _ROWS).combine_chunks()
                before, after, ends = [], [], [0]
                for i in some.column("index").to_pylist():
                    level = 0
                    while (rest := way.get((level, i))) is None:
                        first, nodes, _ = levels[level]
                        a, b = beside(first, nodes, i)
                        before.append(a)
                        after.append(b)
                        level, i = level + 1, i // ARITY
                    before += [a for a, _ in rest]
                    after += [b for _, b in rest]
                    ends.append(len(before))
                path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
                kept = [some.column(c).combine_chunks() for c in ("of", "index", "leaf", *carried)]
                yield pa.RecordBatch.from_arrays([*kept, path, *(pa.repeat(x, some.num_rows) for x in same)], ["of", "index", "leaf", *carried, "path", *known])

    return both.mapInArrow(answer, ", ".join([f"of {kinds['of']}, index long, leaf string", *(f"{c} {kinds[c]}" for c in carried), f"path {PATH}", *(f"{c} string" for c in known)]))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", claimed: Column | None = None, part_rows: int = 100_000) -> DataFrame:
    """(key, group, index, leaf, claimed, path, subroot, root) for each row; ``claimed`` is the leaf that somebody presents
    for it, by default its own. ``path`` leads from the leaf to the root over all groups."""
    ensure_importable(docs.sparkSession)
    own = leaf_digest(*(F.col(f) for f in fields))
    leaves = stored(docs.select(F.col(group).alias("of"), F.col(key).alias("key"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed")), "leaves")
    placed, parts = numbered(leaves, "of", ["key", "leaf"], part_rows)
    placed = stored(placed, "placed")
    ways, roots = _to_root(_stems(placed, parts))
    # The groups' roots are the leaves of one more tree.
    groups = roots.select(F.lit(0).alias("of"), F.col("of").alias("group"), F.col("root").alias("leaf"))
    above, n = numbered(stored(groups, "groups"), "of", ["group"], part_rows)
    above = stored(above, "placed")
    top_ways, _ = _to_root(_stems(above, n))
    tops = stored(_answered(above, top_ways, n, ["group"]), "tops").select("group", F.col("path").alias("top_path"), F.col("root").alias("top"))
    # Joined by group: one row for each stem, of which a group has a few per part.
    ways = ways.join(tops, F.col("of").eqNullSafe(F.col("group"))).select("part", "of", "level", "index", F.concat("path", "top_path").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    found = _answered(placed, stored(ways, "ways"), parts, ["key", "claimed"])
    return found.select(F.col("key").alias(key), F.col("of").alias(group), "index", "leaf", "claimed", "path", "subroot", "root")


def without_line_breaks(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", column: str = "text") -> Column:
    """The leaf as a tamperer presents it who deletes the line breaks of texts whose key has an even crc32; a null key is
    left alone."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col(column), F.lit("\n"), F.lit(""))).otherwise(F.col(column))
    return leaf_digest(*(text if f == column else F.col(f) for f in fields))


def verified_rows(docs: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """Every row's digests, and whether what is presented for it leads to the root."""
    found = manifest(docs, claimed=without_line_breaks(docs), part_rows=part_rows)
    root = folded(F.col("claimed"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
