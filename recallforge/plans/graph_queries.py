"""Graph queries over the keys of the star schema, and manifests over conversations."""

# ruff: noqa: E501
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import graph
from .registry import query, table
from .text_queries import hashed_sql

#: (table, key, name column, id prefix, kind)
_NODES = (("region", "r_regionkey", "r_name", "r", "File"), ("nation", "n_nationkey", "n_name", "n", "Struct"), ("customer", "c_custkey", "c_name", "c", "Function"), ("supplier", "s_suppkey", "s_name", "s", "Function"))
#: (table, source prefix, source key, target prefix, target key, kind)
_EDGES = (("nation", "n", "n_nationkey", "r", "n_regionkey", "Contains"), ("customer", "c", "c_custkey", "n", "c_nationkey", "Calls"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "Calls"))

NODES_SQL = "(" + " UNION ALL ".join(f"SELECT '{p}' || {k} AS id, '{kind}' AS kind, {n} AS name, CAST({i * 10**9} + {k} AS BIGINT) AS ord FROM {t}" for i, (t, k, n, p, kind) in enumerate(_NODES)) + ")"
EDGES_SQL = "(" + " UNION ALL ".join(f"SELECT '{sp}' || {sk} AS src, '{dp}' || {dk} AS dst, '{kind}' AS kind FROM {t}" for t, sp, sk, dp, dk, kind in _EDGES) + ")"
#: The same with an edge from each order to its customer; no order is a node, so these dangle.
DANGLING_SQL = f"(SELECT * FROM {EDGES_SQL} UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'Uses' FROM orders)"


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, t).select(_id(p, k).alias("id"), F.lit(kind).alias("kind"), F.col(n).alias("name"), (F.lit(i * 10**9) + F.col(k)).cast("long").alias("ord"))
        for i, (t, k, n, p, kind) in enumerate(_NODES)
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(_id(sp, sk).alias("src"), _id(dp, dk).alias("dst"), F.lit(kind).alias("kind")) for t, sp, sk, dp, dk, kind in _EDGES])


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(_id("o", "o_orderkey").alias("src"), _id("c", "o_custkey").alias("dst"), F.lit("Uses").alias("kind"))
    return edges(spark, sf_dir).unionByName(orders)


_VALID = f"SELECT src, dst, kind FROM {DANGLING_SQL} e WHERE src IN (SELECT id FROM {NODES_SQL}) AND dst IN (SELECT id FROM {NODES_SQL})"


@query(_VALID)
def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.valid_edges(nodes(spark, sf_dir), _dangling(spark, sf_dir))


@query(f"SELECT 'node' AS what, kind, count(*) AS n FROM {NODES_SQL} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM ({_VALID}) GROUP BY kind")
def graph_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loaded graph has no dangling edge."""
    n = nodes(spark, sf_dir)
    return graph.stats(n, graph.valid_edges(n, _dangling(spark, sf_dir)))


@query(f"SELECT 'node' AS what, kind, count(*) AS n FROM {NODES_SQL} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM {EDGES_SQL} GROUP BY kind")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT id, CAST(coalesce(d, 0) AS BIGINT) AS degree FROM {NODES_SQL} LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT src AS id FROM {EDGES_SQL} UNION ALL SELECT dst FROM {EDGES_SQL}) GROUP BY id) USING (id) ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.god_nodes(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT id, kind, CASE WHEN kind = 'Struct' THEN lower(name) ELSE name END AS name, ord FROM {NODES_SQL}")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are written again under a name in lower case; they keep their place."""
    n = nodes(spark, sf_dir)
    again = n.where("kind = 'Struct'").select("id", "kind", F.lower("name").alias("name"), (F.col("ord") + 10**12).alias("ord"))
    return graph.upsert_nodes(n, again)


_FILES = f"(SELECT CASE WHEN e.dst IS NULL THEN n.id ELSE e.dst || '::' || n.id END AS id, n.kind, n.name, n.ord FROM {NODES_SQL} n LEFT JOIN {EDGES_SQL} e ON e.src = n.id)"


@query(f"""WITH f AS {_FILES}, e AS (SELECT f.id AS src, split_part(f.id, '::', 1) AS dst, 'Contains' AS kind FROM f WHERE contains(f.id, '::'))
SELECT e.src, e.dst, e.kind FROM e WHERE e.dst NOT IN ('n1', 'n2') AND e.dst IN (SELECT id FROM f)""")
def graph_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are symbols of their nation's file; two files go, with what they hold."""
    flat = nodes(spark, sf_dir).join(edges(spark, sf_dir).select(F.col("src").alias("id"), "dst"), "id", "left")
    full = F.when(F.col("dst").isNull(), F.col("id")).otherwise(F.concat_ws("::", "dst", "id"))
    n = flat.select(full.alias("id"), "kind", "name", "ord")
    e = n.where("contains(id, '::')").select(F.col("id").alias("src"), F.split("id", "::")[0].alias("dst"), F.lit("Contains").alias("kind"))
    names = e.select("dst").distinct().where("dst in ('n1', 'n2')").withColumnRenamed("dst", "rel")
    return graph.remove_files(n.unionByName(_file_nodes(e, n)), e, names)[1]


def _file_nodes(e: DataFrame, n: DataFrame) -> DataFrame:
    """Nothing to add: files that are no node of their own stay unknown, so edges to them drop out."""
    return n.limit(0)


_PARTS = "(SELECT 'p' || p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'Trait' WHEN 2 THEN 'Struct' ELSE 'Enum' END AS kind, p_type || '/' || p_brand AS name, p_partkey AS ord FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    kind = F.when(size == 0, "Function").when(size == 1, "Trait").when(size == 2, "Struct").otherwise("Enum")
    return table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("id"), kind.alias("kind"), F.concat_ws("/", "p_type", "p_brand").alias("name"), F.col("p_partkey").alias("ord"))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item calls what its part is called."""
    lines = table(spark, sf_dir, "lineitem").select(_id("p", "l_partkey").alias("id"))
    return lines.join(_parts(spark, sf_dir), "id").select(F.col("id").alias("src"), "name")


_USES = f"(SELECT p.id AS src, p.name FROM lineitem JOIN {_PARTS} p ON p.id = 'p' || l_partkey)"


@query(f"WITH f AS (SELECT name, arg_min(id, ord) AS dst FROM {_PARTS} WHERE kind = 'Function' GROUP BY name) SELECT src, dst, 'Calls' AS kind FROM {_USES} JOIN f USING (name)")
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_calls(_parts(spark, sf_dir), _uses(spark, sf_dir))


@query(f"""WITH t AS (SELECT name, arg_min(id, ord) AS t FROM {_PARTS} WHERE kind = 'Trait' GROUP BY name), s AS (SELECT name, arg_min(id, ord) AS s FROM {_PARTS} WHERE kind = 'Struct' GROUP BY name)
SELECT src, coalesce(t, s) AS dst, 'Implements' AS kind FROM {_USES} LEFT JOIN t USING (name) LEFT JOIN s USING (name) WHERE coalesce(t, s) IS NOT NULL""")
def resolve_impls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_impls(_parts(spark, sf_dir), _uses(spark, sf_dir))


_BOTH = f"(SELECT src, dst FROM {EDGES_SQL} UNION ALL SELECT dst, src FROM {EDGES_SQL} WHERE kind <> 'Calls' OR src LIKE 's%')"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, and all but customers' back again."""
    e = edges(spark, sf_dir)
    return e.unionByName(e.where("kind <> 'Calls' or src like 's%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


@query(f"""WITH RECURSIVE b(id, hops) AS (SELECT 'c1', CAST(0 AS BIGINT) UNION SELECT e.dst, b.hops + 1 FROM b JOIN (SELECT DISTINCT src, dst FROM {_BOTH}) e ON e.src = b.id WHERE b.hops < 6)
SELECT id, min(hops) AS hops FROM b GROUP BY id""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_both(spark, sf_dir), "c1").select("id", "hops")


_GOAL = "(SELECT 's' || min(s_suppkey) FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey WHERE n.n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1))"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_BOTH}),
b(id, hops) AS (SELECT 'c1', CAST(0 AS BIGINT) UNION SELECT e.dst, b.hops + 1 FROM b JOIN e ON e.src = b.id WHERE b.hops < 6),
l AS (SELECT id, min(hops) AS hops FROM b GROUP BY id),
w(id, hops) AS (SELECT id, hops FROM l WHERE id = {_GOAL} UNION SELECT (SELECT min(e.src) FROM e JOIN l ON l.id = e.src WHERE e.dst = w.id AND l.hops = w.hops - 1), w.hops - 1 FROM w WHERE w.hops > 0)
SELECT hops AS step, id FROM w""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customer 1 to the first supplier of its region."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "customer").where("c_custkey = 1").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey")
    near = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), "n_regionkey", "left_semi")
    goal = near.agg(F.min("s_suppkey")).first()[0]
    return graph.shortest_path(nodes(spark, sf_dir), _both(spark, sf_dir), "c1", f"s{goal}")


_NAMES = "(SELECT DISTINCT p_name AS name FROM part)"


@query(f"""WITH v AS ({hashed_sql('name', 'name', _NAMES)}), q AS (SELECT bucket, weight FROM v WHERE name = (SELECT arg_min(p_name, p_partkey) FROM part)),
s AS (SELECT v.name, round(CAST(sum(v.weight * q.weight) AS DOUBLE), 9) AS score FROM v JOIN q USING (bucket) GROUP BY v.name)
SELECT 'p' || p_partkey AS id, coalesce(score, 0) AS score FROM part LEFT JOIN s ON s.name = p_name ORDER BY score DESC, p_partkey LIMIT 5""")
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts named most like the first one."""
    p = table(spark, sf_dir, "part")
    n = p.select(_id("p", "p_partkey").alias("id"), F.lit("Struct").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return graph.graph_query(n, p.agg(F.min_by("p_name", "p_partkey").alias("text")))


_SNAPSHOTS = """(SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS "then", arg_max(text, turn) FILTER (WHERE role = 'user' AND turn > 0 OR role = 'assistant' AND turn > 2) AS now, bool_or(role = 'assistant') AS known FROM conversations GROUP BY conv_id)"""


@query(f"""SELECT 'conv-' || conv_id AS rel, CASE WHEN now IS NULL THEN 'deleted' WHEN NOT known OR "then" IS NULL OR now <> "then" THEN 'changed' ELSE 'unchanged' END AS status
FROM {_SNAPSHOTS} WHERE now IS NOT NULL OR known AND "then" IS NOT NULL""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files: first what the user opened with, if answered, then the last turn after that."""
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    c = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("rel")).agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("then"),
        F.max_by("text", F.when(user & (F.col("turn") > 0) | answer & (F.col("turn") > 2), F.col("turn"))).alias("now"),
        F.bool_or(answer).alias("known"),
    )
    now = c.where("now is not null").select("rel", hashing.content_hash(F.col("now")).alias("hash"))
    then = c.where("known and then is not null").select("rel", hashing.content_hash(F.col("then")).alias("hash"))
    return graph.manifest_diff(now, then)


_SOURCE = "(SELECT 'src/s' || s_suppkey || '.py' AS rel, s_suppkey AS k, s_nationkey AS n FROM supplier)"


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per supplier: a class of its nation with one method, and a function; both call its nation's function."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    content = F.concat(F.lit("class N"), n, F.lit("(Base):\n    def m(self):\n        f"), n, F.lit("()\n\n\ndef f"), k, F.lit("():\n    return f"), n, F.lit("() + 1\n"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.lit(".py")).alias("rel"), content.alias("content"))


@query(f"""WITH s AS {_SOURCE} SELECT rel AS src, rel || '::N' || n AS dst, 'Contains' AS kind FROM s UNION ALL SELECT rel, rel || '::N' || n || '::m', 'Contains' FROM s
UNION ALL SELECT rel, rel || '::f' || k, 'Contains' FROM s
UNION ALL SELECT s.rel || '::N' || s.n || '::m', t.rel || '::f' || t.k, 'Calls' FROM s JOIN s t ON t.k = s.n UNION ALL SELECT s.rel || '::f' || s.k, t.rel || '::f' || t.k, 'Calls' FROM s JOIN s t ON t.k = s.n""")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract

    return extract.build(_source_files(spark, sf_dir))[1]


@query(f"""WITH s AS {_SOURCE}, i AS (SELECT rel, n, 'N' || n AS name FROM s)
SELECT rel AS id, 'File' AS kind, split_part(rel, '/', 2) AS name FROM s UNION ALL SELECT rel || '::' || name, 'Struct', name FROM i UNION ALL SELECT rel || '::' || name || '::m', 'Function', 'm' FROM i
UNION ALL SELECT rel || '::f' || k, 'Function', 'f' || k FROM s""")
def graph_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built from the files of suppliers in debt with another function's name, then brought up to date."""
    from ..operators import extract

    now = _source_files(spark, sf_dir)
    debt = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("rel"))
    before = now.join(debt, "rel", "left_semi").withColumn("content", F.replace("content", F.lit("def f"), F.lit("def g")))
    n, e = extract.build(before)
    return extract.update(n, e, extract.manifest(before), now)[0].select("id", "kind", "name")


_DECLARED = "(SELECT rel, k, n, CASE WHEN k % 7 = 3 THEN 'Base' ELSE 'N' || n END AS class FROM " + _SOURCE + ")"


def _typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per supplier: a class (every seventh one named Base) that derives from Base, and a function; both call
    their nation's function."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    name = F.when(F.col("s_suppkey") % 7 == 3, F.lit("Base")).otherwise(F.concat(F.lit("N"), n))
    content = F.concat(F.lit("class "), name, F.lit("(Base):\n    def m(self):\n        f"), n, F.lit("()\n\n\ndef f"), k, F.lit("():\n    return f"), n, F.lit("() + 1\n"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.lit(".py")).alias("rel"), content.alias("content"), "s_acctbal", "s_suppkey")


@query(f"""WITH s AS {_DECLARED}, b AS (SELECT rel || '::Base' AS dst FROM s WHERE class = 'Base' ORDER BY string_split(rel, '/') LIMIT 1)
SELECT rel AS src, rel || '::' || class AS dst, 'Contains' AS kind FROM s UNION ALL SELECT rel, rel || '::' || class || '::m', 'Contains' FROM s
UNION ALL SELECT rel, rel || '::f' || k, 'Contains' FROM s UNION ALL SELECT rel || '::' || class, dst, 'Implements' FROM s, b
UNION ALL SELECT s.rel || '::' || s.class || '::m', t.rel || '::f' || t.k, 'Calls' FROM s JOIN s t ON t.k = s.n UNION ALL SELECT s.rel || '::f' || s.k, t.rel || '::f' || t.k, 'Calls' FROM s JOIN s t ON t.k = s.n""")
def graph_update_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of an index that was built when suppliers in debt had functions of other names, every fifth file was not
    there yet, and nations had files of their own with the functions called; brought up to date it has a clean build's."""
    from ..operators import code_index

    files = _typed_files(spark, sf_dir)
    now = files.select("rel", "content")
    before = files.where("s_suppkey % 5 <> 0").withColumn("content", F.when(F.col("s_acctbal") < 0, F.replace("content", F.lit("def f"), F.lit("def g"))).otherwise(F.col("content")))
    n = F.col("n_nationkey").cast("string")
    gone = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/n"), n, F.lit(".py")).alias("rel"), F.concat(F.lit("class Base:\n    pass\n\n\ndef f"), n, F.lit("():\n    pass\n")).alias("content"))
    return code_index.update(code_index.build(before.select("rel", "content").unionByName(gone)), now).edges()
