"""State that outlives a run, as Parquet: graphs, manifests, checkpoints, embedding caches.

A table is a folder of versions. A version is there when it is whole, which its _SUCCESS file says, and readers take the
newest one; so a reader sees the old table or the new one, whenever a writer stops. The version before the newest stays
for readers that have begun; older ones go. Tables that belong together, as a graph's, are switched together by a commit.

A table that was never saved is empty. One that cannot be read is an error, but a manifest, checkpoints or a cache whose
files are spoilt are empty too: they only save work. An I/O fault is always an error, so nothing is saved over state that
could not be seen.
"""

from __future__ import annotations

import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators import code_index
from ..operators.embedders import CACHE
from ..operators.graph import valid_edges

NODES, EDGES = "id string, kind string, name string, ord long", "src string, dst string, kind string"
MANIFEST = "rel string, hash string"
CHECKPOINTS = "session_id string, archived boolean, last_staged_line long"
SCHEMAS = {"nodes": NODES, "edges": EDGES, "manifest": MANIFEST, "checkpoints": CHECKPOINTS, "cache": CACHE}


#: What a commit names: a table and the folder of its version.
POINTER = "name string, path string"
#: Tables that are made anew if their files are spoilt.
REBUILT = frozenset(("manifest", "checkpoints", "cache"))


def _versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of the whole versions, oldest first."""
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(f"{root}/{name}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = sorted(s.getPath().getName() for s in store.listStatus(folder) if s.getPath().getName().startswith("v"))
    return [f"{root}/{name}/{v}" for v in found if store.exists(paths.Path(f"{root}/{name}/{v}/_SUCCESS"))]


def save(df: DataFrame, root: str, name: str) -> None:
    spark = df.sparkSession
    before = _versions(spark, root, name)
    after = max([time.time_ns(), *(int(v.rpartition("/v")[2].split("-")[0]) + 1 for v in before[-1:])])
    df.write.parquet(f"{root}/{name}/v{after:020d}-{uuid.uuid4().hex}")
    paths = spark._jvm.org.apache.hadoop.fs
    for old in before[:-1]:
        path = paths.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    versions = _versions(spark, root, name)
    if not versions:
        return spark.createDataFrame([], SCHEMAS[name])
    try:
        found = spark.read.parquet(versions[-1])
        found.limit(1).count()
        return found
    except (PySparkException, Py4JJavaError) as e:
        spoilt = re.search("not a Parquet file|CANNOT_READ_FILE_FOOTER|UNABLE_TO_INFER_SCHEMA|not parse|corrupt", str(e))
        if name in REBUILT and spoilt:
            return spark.createDataFrame([], SCHEMAS[name])
        raise


def commit(tables: dict[str, DataFrame], root: str, group: str) -> None:
    """Saves several tables so that readers see all of them as they were or all as they are.

    Each is written as a version of its own; what makes them current is one pointer, a file that names the versions of the
    group and is moved into place when it is whole. A writer that stops before that leaves the pointer of the last commit;
    what it wrote is a version that nothing names, and goes when two commits have followed.
    """
    spark = next(iter(tables.values())).sparkSession
    paths = spark._jvm.org.apache.hadoop.fs
    before = _pointers(spark, root, group)
    number = max([time.time_ns(), *(int(p.rpartition("/c")[2].split("-")[0]) + 1 for p in before[-1:])])
    tag, known = f"{number:020d}-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        known[name] = f"{root}/{group}/{name}/v{tag}"
        df.write.parquet(known[name])
    spark.createDataFrame([(name, path.removeprefix(f"{root}/")) for name, path in known.items()], POINTER).coalesce(1).write.parquet(f"{root}/{group}/_draft-{tag}")
    draft, final = paths.Path(f"{root}/{group}/_draft-{tag}"), paths.Path(f"{root}/{group}/c{tag}")
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(draft, final):
        raise OSError(f"cannot switch {group} of {root} to what was written")
    for old in before[:-1]:
        oldest_kept = before[-1].rpartition("/c")[2]
        for name in tables:
            folder = paths.Path(f"{root}/{group}/{name}")
            for s in store.listStatus(folder) if store.exists(folder) else ():
                if s.getPath().getName()[1:] < oldest_kept:
                    store.delete(s.getPath(), True)
        store.delete(paths.Path(old), True)


def _pointers(spark: SparkSession, root: str, group: str) -> list[str]:
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(f"{root}/{group}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    return sorted(f"{root}/{group}/{s.getPath().getName()}" for s in store.listStatus(folder) if re.match(r"c\d", s.getPath().getName()))


def committed(spark: SparkSession, root: str, group: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of the last commit of a group; empty ones where nothing was committed."""
    pointers = _pointers(spark, root, group)
    if not pointers:
        return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    known = {r["name"]: r["path"] for r in spark.read.schema(POINTER).parquet(pointers[-1]).collect()}
    return {name: spark.read.schema(schema).parquet(f"{root}/{known[name]}") if name in known else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def save_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    commit({"nodes": nodes.select("id", "kind", "name", "ord"), "edges": edges.select("src", "dst", "kind")}, root, "graph")


def load_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one commit; edges to nodes that are not there are dropped."""
    found = committed(spark, root, "graph", {"nodes": NODES, "edges": EDGES})
    return found["nodes"], valid_edges(found["nodes"], found["edges"])


CODE_INDEX = {"nodes": code_index.NODES, "contains": code_index.CONTAINS, "references": code_index.REFERENCES, "manifest": MANIFEST}


def save_index(index: code_index.CodeIndex, root: str) -> None:
    commit({name: getattr(index, name) for name in CODE_INDEX}, root, "code_index")


def load_index(spark: SparkSession, root: str) -> code_index.CodeIndex:
    """An index that was never saved is empty: updating it is a build."""
    return code_index.CodeIndex(**committed(spark, root, "code_index", CODE_INDEX))
