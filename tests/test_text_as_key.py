"""Texts that are their own key, as the names of a graph are."""

from recallforge.operators import graph, search


def test_text_is_its_own_key(spark):
    texts = spark.createDataFrame([("Red Fox",), ("red fox",), ("fox",), ("",)], "text string")
    found = {r["text"]: sorted(r["buckets"]) for r in search.grouped_terms(texts, ["text"]).collect()}
    assert sorted(found) == ["Red Fox", "fox", "red fox"]
    assert found["Red Fox"] == found["red fox"] and set(found["fox"]) < set(found["red fox"])


def test_repeated_text_is_its_own_key(spark):
    texts = spark.createDataFrame([("Red Fox",), ("Red Fox",), ("fox",)], "text string")
    assert sorted(r["text"] for r in search.grouped_terms(texts, ["text"]).collect()) == ["Red Fox", "fox"]


def test_graph_query_keeps_names_apart_by_case(spark):
    nodes = spark.createDataFrame([("a", "Struct", "Red Fox", 0), ("b", "Struct", "red fox", 1), ("c", "Struct", "fox", 2), ("d", "Struct", None, 3)], "id string, kind string, name string, ord long")
    query = spark.createDataFrame([("red fox",)], "text string")
    got = [tuple(r) for r in graph.graph_query(nodes, query).collect()]
    assert [x[0] for x in got] == ["a", "b", "c", "d"] and got[0][1] == got[1][1] == 1.0 and got[3][1] == 0.0
