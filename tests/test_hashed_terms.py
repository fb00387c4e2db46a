"""The offline embedder counts a text within its row."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recallforge.operators import search


def test_texts_are_not_shuffled(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("the fox, THE hound").alias("text"))
    plan = search.hashed_terms(rows, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5], [1, 1, 2, None, None], [None, 1, 2, 3, 4]])
def test_texts_with_one_key_count_as_one(spark, tmp_path, ids):
    texts = ["The fox and the hound", "the été fox 12²", None, "Élan vital, vital", "..."]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(zip(ids, texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = order(con.execute(__spark_entry__.oracle_sql()["embed_hashed_tf"]).fetchall())
    assert order(__spark_entry__.queries()["embed_hashed_tf"](spark, str(tmp_path)).collect()) == want
