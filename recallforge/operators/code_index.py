"""A code graph that an update leaves as a clean build would: every reference is kept with its name, resolved or not.

``extract.update`` looks up only what the changed files themselves refer to. Here the state has a table of references beside
the nodes, so that a name whose meaning has changed, because a file that defines it came, went or was rewritten, is looked
up again for whoever refers to it, in files that did not change. A name means the first node that has it, by the
components of the file's path and then by the place in the file; places are not numbers that an update would have to
shift, so the order after an update is that of a build.

Defined cases: a file that cannot be read is neither changed nor deleted and keeps what it had; a file that is gone takes
its nodes and references along; references to a name that nothing has stay, and are found when something has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from . import graph
from .extract import extract, manifest
from .tables import ordinals, stored

NODES = "id string, kind string, name string, rel string, seq long"
CONTAINS = "rel string, src string, dst string"
REFERENCES = "rel string, src string, what string, name string, dst string"
#: What a reference of each kind can mean, the first that there is.
MEANT = {"call": ("Function",), "impl": ("Trait", "Struct")}
EDGE_KINDS = {"call": "Calls", "impl": "Implements"}


@dataclass
class CodeIndex:
    """nodes (id, kind, name, rel, seq), contains (rel, src, dst), references (rel, src, what, name, dst), manifest (rel, hash)."""

    nodes: DataFrame
    contains: DataFrame
    references: DataFrame
    manifest: DataFrame

    def edges(self) -> DataFrame:
        """(src, dst, kind); repeats stay."""
        kind = F.when(F.col("what") == "call", EDGE_KINDS["call"]).otherwise(EDGE_KINDS["impl"])
        found = self.references.where("dst is not null").select("src", "dst", kind.alias("kind"))
        return self.contains.select("src", "dst", F.lit("Contains").alias("kind")).unionByName(found)

    def ordered_nodes(self) -> DataFrame:
        """(id, kind, name, ord), as graph operators take them."""
        return ordinals(self.nodes, _place(), "ord").select("id", "kind", "name", "ord")


def _place() -> list[Column]:
    return [F.split("rel", "/"), F.col("seq")]


def _read(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, contains and references (without dst) of ``files`` (rel, content)."""
    rows = stored(extract(files), "symbols")
    parts = F.split("b", "\t")
    told = rows.where("what = 'node'").select("rel", "seq", F.col("a").alias("id"), parts[0].alias("kind"), parts[1].alias("name"))
    # An id keeps its first place and takes the last kind and name.
    nodes = told.groupBy("rel", "id").agg(F.max_by(F.struct("kind", "name"), "seq").alias("l"), F.min("seq").alias("seq")).select("id", "l.kind", "l.name", "rel", "seq")
    contains = rows.where("what = 'contains'").select("rel", F.col("a").alias("src"), F.col("b").alias("dst"))
    refers = rows.where("what in ('call', 'impl')").select("rel", F.col("a").alias("src"), "what", F.col("b").alias("name"))
    # A type that is no node of its own file implements nothing.
    typed = refers.where("what = 'impl'").join(nodes.select("rel", F.col("id").alias("src")), ["rel", "src"], "left_semi").select(*refers.columns)
    return stored(nodes, "nodes"), contains, refers.where("what = 'call'").unionByName(typed)


def meanings(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, call, impl): the ids that each of ``names`` (name) means in a call and as a base, null if nothing has it."""
    place = F.struct(*_place())

    def first(kind: str) -> Column:
        return F.min_by(F.when(F.col("kind") == kind, F.col("id")), F.when(F.col("kind") == kind, place))

    kinds = [k for kinds in MEANT.values() for k in kinds]
    own = nodes.where(F.col("kind").isin(kinds)).join(names.select("name").distinct(), "name", "left_semi")
    found = own.groupBy("name").agg(*(first(k).alias(k) for k in kinds))
    return found.select("name", *(F.coalesce(*MEANT[what]).alias(what) for what in MEANT))


def _bound(references: DataFrame, nodes: DataFrame) -> DataFrame:
    means = meanings(nodes, references)
    dst = F.when(F.col("what") == "call", F.col("call")).otherwise(F.col("impl"))
    return references.select("rel", "src", "what", "name").join(means, "name", "left").select("rel", "src", "what", "name", dst.alias("dst"))


def build(files: DataFrame) -> CodeIndex:
    """The index of ``files`` (rel, content)."""
    nodes, contains, references = _read(files)
    return CodeIndex(nodes, contains, stored(_bound(references, nodes), "references"), manifest(files))


def update(index: CodeIndex, files: DataFrame) -> CodeIndex:
    """The index after ``files`` took the place of those in its manifest.

    Read again are the changed and new files. Looked up again are their references and those, in any file, to names whose
    meaning is another now.
    """
    now = files.select("rel", content_hash(F.col("content")).alias("hash"))
    status = stored(graph.manifest_diff(now, index.manifest), "diff")
    changed, gone = status.where("status = 'changed'").select("rel"), status.where("status in ('changed', 'deleted')").select("rel")
    new_nodes, new_contains, new_references = _read(files.join(changed, "rel", "left_semi"))
    nodes = stored(index.nodes.join(gone, "rel", "left_anti").select(*index.nodes.columns).unionByName(new_nodes), "nodes")
    touched = stored(index.nodes.join(gone, "rel", "left_semi").select("name").unionByName(new_nodes.select("name")).distinct(), "touched")
    then, after = (meanings(n, touched).withColumn("at", F.lit(at)) for n, at in ((index.nodes, 0), (nodes, 1)))
    same = F.count("*") == 2
    for what in MEANT:
        same = same & F.min(what).eqNullSafe(F.max(what)) & (F.count(what) != 1)
    moved = stored(then.unionByName(after).groupBy("name").agg((~same).alias("moved")).where("moved").select("name"), "moved")
    kept = index.references.join(gone, "rel", "left_anti")
    columns = index.references.columns
    again = kept.join(moved, "name", "left_semi").select("rel", "src", "what", "name").unionByName(new_references)
    references = kept.join(moved, "name", "left_anti").select(*columns).unionByName(_bound(again, nodes).select(*columns))
    contains = index.contains.join(gone, "rel", "left_anti").select(*index.contains.columns).unionByName(new_contains)
    left = index.manifest.join(gone, "rel", "left_anti").unionByName(now.join(changed, "rel", "left_semi"))
    return CodeIndex(nodes, contains, stored(references, "references"), stored(left, "manifest"))
