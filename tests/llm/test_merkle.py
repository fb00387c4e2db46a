"""The Merkle manifest against trees built one after the other."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallforge.llm import merkle
from recallforge.llm.queries import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root and, per leaf, the (before, after) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            first = at[i] // 3 * 3
            run = nodes[first : first + 3]
            p.append(("".join(run[: at[i] - first]), "".join(run[at[i] - first + 1 :])))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def expected(rows):
    """Rows (doc_id, text, lang, source, n_chars) to their results."""
    leaf = lambda d, t, l, s, n: h(*map(field, (d, s, l, n, t)))
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((leaf(*row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = tree([x[0] for x in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (own, (d, t, l, _, n)), path in zip(groups[s], trees[s][1]):
            steps = path + top
            even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
            node = leaf(d, t.replace("\n", "") if even and t is not None else t, l, s, n)
            for before, after in steps:
                node = h(before, node, after)
            out.append((d, own, trees[s][0], root, h(*(b + a for b, a in steps)), node, node == root))
    return out


def results(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = results(queries()["op13_merkle_manifest"](spark, SF))
    assert got == Counter(expected(rows))
    assert {r[6] for r in got} == {True, False}


ROWS = [(i, f"text {i}\nmore", "en" if i % 3 else None, None if i % 5 == 0 else f"s{i * i % 4}", i) for i in range(173)]
ODD = [(None, None, None, None, None), (None, "a\nb", "de", "é", 1), (7, "same\n", "en", "hot", 2), (7, "same\n", "en", "hot", 2), (7, "other", "en", "hot", 2), (8, "", "", "", 0), (9, "word\n" * 50_000, "en", "hot", 3)]


@pytest.mark.parametrize("part_rows", [7, 100_000])
def test_nulls_ties_and_any_parts(spark, part_rows, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2 if part_rows < 100_000 else 8)
    docs = spark.createDataFrame(ROWS + ODD, DOCS).withColumns({"key": F.lit("x"), "path": F.lit(1)})
    assert results(merkle.verified_rows(docs, part_rows)) == Counter(expected(ROWS + ODD))


def test_a_hot_group_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 1)
    rows = [(i, None, None, "hot" if i % 10 else "cold", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    assert results(merkle.verified_rows(docs, 90)) == Counter(expected(rows))


def test_equal_rows_spread_over_parts(spark):
    rows = [(1, "same", "en", "s", 4)] * 120
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), part_rows=20).collect()
    assert sorted(r["index"] for r in got) == list(range(120))
    assert Counter((r["leaf"], r["root"]) for r in got) == Counter((e[1], e[3]) for e in expected(rows))


def test_one_row_and_none(spark):
    one = [(5, "a", "en", "s", 1)]
    assert results(merkle.verified_rows(spark.createDataFrame(one, DOCS))) == Counter(expected(one))
    assert merkle.verified_rows(spark.createDataFrame([], DOCS)).collect() == []


def test_a_changed_field_is_found(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    claimed = merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang")), F.when(F.col("doc_id") == 100, 0).otherwise(F.col("n_chars")), F.col("text"))
    found = merkle.manifest(docs, claimed=claimed)
    wrong = found.where(merkle.folded(F.col("claimed"), F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in wrong] == [100]


def test_sql_says_the_same_of_nulls_and_ties():
    import duckdb
    import pandas as pd

    from recallforge.llm.sql import OP13_SQL

    con = duckdb.connect()
    con.register("given", pd.DataFrame(ROWS + ODD, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert Counter(con.execute(f"SELECT {columns} FROM ({OP13_SQL})").fetchall()) == Counter(expected(ROWS + ODD))
