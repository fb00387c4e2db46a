"""The code graph as two tables: nodes (id, kind, name, ord) and edges (src, dst, kind), a directed multigraph.

``ord`` is the place in order of insertion, which decides which of several nodes of one name is meant.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .search import DIGITS, dense
from .tables import maybe_broadcast, stored

#: Rounds of a search after which what was reached is stored as one table.
STORED_HOPS = 50


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist; repeats stay."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Per id the last (kind, name) and the first place."""
    every = nodes.select("id", "kind", "name", "ord").unionByName(changes.select("id", "kind", "name", "ord"))
    return every.groupBy("id").agg(F.max_by(F.struct("kind", "name"), "ord").alias("l"), F.min("ord").alias("ord")).select("id", "l.kind", "l.name", "ord")


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``files`` (rel): the file's own and those whose id goes on after it with ``::``."""
    left = nodes.withColumn("rel", F.split("id", "::")[0]).join(files, "rel", "left_anti").select(*nodes.columns)
    return left, valid_edges(left, edges)


def first_by_name(nodes: DataFrame, kind: str) -> DataFrame:
    """(name, target): of the nodes of a kind with one name the first inserted."""
    return nodes.where(F.col("kind") == kind).groupBy("name").agg(F.min_by("id", "ord").alias("target"))


def resolve_calls(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """Calls edges of ``pending`` (src, name); names that no function has are dropped."""
    return pending.join(first_by_name(nodes, "Function"), "name").select("src", F.col("target").alias("dst"), F.lit("Calls").alias("kind"))


def resolve_impls(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """Implements edges of ``pending`` (src, name), to a trait, or else a struct; the source must be a node."""
    traits, structs = (first_by_name(nodes, k).withColumnRenamed("target", k) for k in ("Trait", "Struct"))
    found = pending.join(traits, "name", "left").join(structs, "name", "left").withColumn("dst", F.coalesce("Trait", "Struct"))
    found = found.where("dst is not null").select("src", "dst", F.lit("Implements").alias("kind"))
    return found.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "kind")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a loop counts twice, an isolated node has 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = nodes.select(F.lit("node").alias("what"), "kind").unionByName(edges.select(F.lit("edge").alias("what"), "kind"))
    return counts.groupBy("what", "kind").agg(F.count("*").alias("n"))


def chains(links: DataFrame, ends: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of distinct ``links`` (src, dst), and of the nodes with one way in and one way out that are not among ``ends``:

    (id, root, place, before), the chain that each lies on, by its first node, the place from 0, and the node before; and
    (src, dst, weight, via, root), the links between all other nodes, among them one for each whole chain, ``via`` being the
    last node before dst. Places are found by pointer doubling, so a chain of n nodes takes log2(n) rounds; rings of such
    nodes, which nothing else reaches, are in neither.
    """
    out = links.groupBy("src").agg(F.count("*").alias("n_out"), F.min("dst").alias("next"))
    into = links.groupBy("dst").agg(F.count("*").alias("n_in"), F.min("src").alias("before"))
    through = out.join(into, F.col("src") == F.col("dst")).where((F.col("n_out") == 1) & (F.col("n_in") == 1) & ~F.col("src").isin(ends))
    inner = stored(through.select(F.col("src").alias("id"), "before", "next"), "inner")
    inside = inner.select(F.col("id").alias("inside"))
    first = inner.join(inside, F.col("before") == F.col("inside"), "left")
    at = stored(first.select("id", F.coalesce("inside", "id").alias("to"), F.when(F.col("inside").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("inside").isNull().alias("done")), "pointers")
    if at.where("not done").isEmpty():  # no chain is longer than one node: nothing to jump over
        none = links.sparkSession.createDataFrame([], "id string, root string, place long, before string")
        return none, links.select("src", "dst", F.lit(1).cast("long").alias("weight"), F.col("src").alias("via"), F.lit(None).cast("string").alias("root"))
    found = at.where("done")
    waiting, most = at.where("not done"), max(1, inner.count()).bit_length() + 1
    for _ in range(most):
        if waiting.isEmpty():
            break
        # What waits points to a node each; what is done no longer takes part but as a target.
        target = found.unionByName(waiting).select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("place").alias("more"), F.col("done").alias("ends"))
        step = stored(waiting.join(target, "to").select("id", F.col("far").alias("to"), (F.col("place") + F.col("more")).alias("place"), F.col("ends").alias("done")), "pointers")
        found, waiting = found.unionByName(step.where("done")), step.where("not done")
    placed = stored(found.select("id", F.col("to").alias("root"), "place").join(inner, "id"), "chains")
    whole = placed.groupBy("root").agg(F.max_by(F.struct("id", "next"), "place").alias("last"), F.min_by("before", "place").alias("src"), (F.max("place") + 2).alias("weight"))
    jumps = whole.select("src", F.col("last.next").alias("dst"), "weight", F.col("last.id").alias("via"), "root")
    plain = links.join(inside.withColumnRenamed("inside", "src"), "src", "left_anti").join(inside.withColumnRenamed("inside", "dst"), "dst", "left_anti")
    return placed.select("id", "root", "place", "before"), stored(plain.select("src", "dst", F.lit(1).cast("long").alias("weight"), F.col("src").alias("via"), F.lit(None).cast("string").alias("root")).unionByName(jumps), "jumps")


def _nearest(seen: DataFrame) -> DataFrame:
    return seen.groupBy("id").agg(F.min("hops").alias("hops"))


def _relaxed(frontier: DataFrame, seen: DataFrame, jumps: DataFrame) -> DataFrame:
    """(id, hops) of the nodes that the links out of ``frontier`` (id, hops) bring nearer than ``seen`` has them."""
    step = frontier.join(jumps.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("hops") + F.col("weight")).alias("hops"))
    known = _nearest(seen).withColumnRenamed("hops", "known")
    return stored(step.join(known, "id", "left").where("known is null or hops < known").select("id", "hops"), "frontier")


def _with_prev(nodes: DataFrame, inner: DataFrame, jumps: DataFrame) -> DataFrame:
    """(id, hops, prev) of ``nodes`` (id, hops) and of the chains on shortest ways between them; prev is the smallest node
    from which the node is one step away."""
    froms = jumps.join(nodes.select(F.col("id").alias("src"), F.col("hops").alias("from")), "src")
    ways = froms.join(nodes.select(F.col("id").alias("dst"), "hops"), "dst").where(F.col("from") + F.col("weight") == F.col("hops"))
    prev = ways.groupBy(F.col("dst").alias("id")).agg(F.min("via").alias("prev"))
    within = inner.join(froms.where("root is not null").select("root", "from"), "root").select("id", (F.col("from") + F.col("place") + 1).alias("hops"), F.col("before").alias("prev"))
    return nodes.join(prev, "id", "left").select("id", "hops", "prev").unionByName(within)


def bfs(edges: DataFrame, start: str) -> DataFrame:
    """(id, hops, prev) of what ``start`` reaches along edges; prev is the smallest predecessor on a shortest path.

    Chains are jumped over, so a round passes a branching, not a step. The nodes that a round has brought nearer are
    joined with the links; distances are stored anew now and then, so that plans do not grow with the rounds.
    """
    spark = edges.sparkSession
    inner, jumps = chains(stored(edges.select("src", "dst").where("src <> dst").distinct(), "links"), [start])
    frontier = seen = stored(spark.createDataFrame([(start, 0)], "id string, hops long"), "seen")
    for n in itertools.count(1):
        frontier = _relaxed(frontier, seen, jumps)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if n % STORED_HOPS == 0:
            seen = stored(_nearest(seen), "seen")
    return _with_prev(stored(_nearest(seen), "seen"), inner, jumps)


def _between(start: str, goal: str, jumps: DataFrame) -> DataFrame | None:
    """(id, hops) of the nodes on shortest ways from ``start`` to ``goal``; None if there is none.

    The search goes on from the end whose frontier is smaller, until what either end could still find makes no shorter way
    than the best that has met. Then the ways are followed from where both ends met, towards each of them.
    """
    spark = jumps.sparkSession
    links = [jumps.select("src", "dst", "weight"), jumps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")]
    seen = [stored(spark.createDataFrame([(x, 0)], "id string, hops long"), "seen") for x in (start, goal)]
    frontier, sizes, least, best = list(seen), [1, 1], [0, 0], None
    for n in itertools.count(1):
        side = 0 if sizes[0] <= sizes[1] else 1
        frontier[side] = _relaxed(frontier[side], seen[side], links[side])
        told = frontier[side].agg(F.count("*").alias("n"), F.min("hops").alias("least")).first()
        if not told["n"]:
            break  # this end has found all that it reaches, with the least distances
        sizes[side], least[side] = told["n"], told["least"]
        seen[side] = seen[side].unionByName(frontier[side])
        if n % STORED_HOPS == 0:
            seen[side] = stored(_nearest(seen[side]), "seen")
        met = frontier[side].join(_nearest(seen[1 - side]).withColumnRenamed("hops", "other"), "id").agg(F.min(F.col("hops") + F.col("other"))).first()[0]
        best = met if best is None else best if met is None else min(best, met)
        if best is not None and sum(least) >= best:
            break
    if best is None:
        return None
    near = [stored(_nearest(s), "seen") for s in seen]
    both = near[0].join(near[1].withColumnRenamed("hops", "other"), "id").where(F.col("hops") + F.col("other") == best)
    middle = stored(both.select("id", "hops"), "middle")
    found = middle
    for side in (0, 1):
        at = middle.select("id", (F.col("hops") if side == 0 else best - F.col("hops")).alias("hops"))
        while True:  # against the links of this end, to nodes that are nearer to it by a link's weight
            back = at.join(links[1 - side].withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), (F.col("hops") - F.col("weight")).alias("hops"))
            told_before = found.select("id")
            at = stored(back.join(near[side], ["id", "hops"], "left_semi").distinct().join(told_before, "id", "left_anti"), "way")
            if at.isEmpty():
                break
            found = found.unionByName(at.select("id", (F.col("hops") if side == 0 else best - F.col("hops")).alias("hops")))
    return stored(found, "between")


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(step, id) of a shortest directed path, of equal ones that of the smallest predecessors; no row if there is none.

    It is searched for from both ends, over chains at a jump. The path is read off the predecessors by pointer doubling:
    from tables of the ancestors 1, 2, 4, ... steps before, the farthest first, each of which doubles what is known of it.
    """
    spark = edges.sparkSession
    nothing = spark.createDataFrame([], "step long, id string")
    if nodes.where(F.col("id").isin(start, goal)).select("id").distinct().count() < len({start, goal}):
        return nothing
    if start == goal:
        return spark.createDataFrame([(0, start)], "step long, id string")
    inner, jumps = chains(stored(edges.select("src", "dst").where("src <> dst").distinct(), "links"), [start, goal])
    between = _between(start, goal, jumps)
    if between is None:
        return nothing
    reached = stored(_with_prev(between, inner, jumps), "reached")
    length = reached.where(F.col("id") == goal).first()["hops"]
    ancestors, steps = [reached.where("prev is not null").select("id", F.col("prev").alias("to"))], 1
    while 2 * steps <= length:
        near = ancestors[-1]
        ancestors.append(stored(near.join(near.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "ancestors"))
        steps *= 2
    path = stored(reached.where(F.col("id") == goal).select("id"), "path")
    for table in reversed(ancestors):
        path = stored(path.unionByName(table.join(maybe_broadcast(path, 1_000_000), "id").select(F.col("to").alias("id"))).distinct(), "path")
    return reached.join(path, "id", "left_semi").select(F.col("hops").alias("step"), "id")


def graph_query(nodes: DataFrame, query: DataFrame, limit: int = 5) -> DataFrame:
    """(id, score): nodes whose names are most similar to the one text of ``query`` (text); no floor, ties by place.

    Names are embedded once per distinct name.
    """
    names = nodes.select(F.col("name").alias("text")).distinct()
    q = dense(query.select(F.lit(0).alias("q"), "text"), ["q"]).select(F.col("vector").alias("q"))
    scored = dense(names, ["text"]).crossJoin(F.broadcast(q)).select(F.col("text").alias("name"), F.round(vectors.dot(F.col("vector"), F.col("q")), DIGITS).alias("score"))
    every = nodes.join(scored, "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return every.orderBy(F.desc("score"), "ord").limit(limit).select("id", "score")


def manifest_diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel, status) over paths now (rel, hash) and stored: changed (or new), deleted, unchanged; a null hash is a file
    that could not be read, which is neither changed nor deleted."""
    now, then = current.select("rel", F.col("hash").alias("now"), F.lit(True).alias("here")), manifest.select("rel", F.col("hash").alias("then"))
    status = (
        F.when(F.col("here").isNull(), "deleted").when(F.col("now").isNull(), "unreadable").when(F.col("then").isNull() | (F.col("now") != F.col("then")), "changed").otherwise("unchanged")
    )
    return now.join(then, "rel", "full_outer").select("rel", status.alias("status"))
