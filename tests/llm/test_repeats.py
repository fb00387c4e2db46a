"""Ids that repeat, and languages that few documents have."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallforge.llm import hamming, langid
from recallforge.llm.queries import OP5_SQL


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ids_with_several_vectors_ask_with_each(spark, parts):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=64)], 0) for i in [*range(1, 41), 50, 50, 100]]
    got = hamming.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts), F.col("id") % 50 == 0).toPandas()
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = con.execute(OP5_SQL).df()
    columns = ["query_id", "rank", "vec_id", "distance"]
    assert got[columns].sort_values(columns).values.tolist() == want[columns].sort_values(columns).values.tolist()


def test_a_rare_language_is_learned(spark):
    english = [(i, f"the quick brown fox number {i} jumps over that lazy dog and goes home", "en") for i in range(3000)]
    finnish = [(10_000 + i, f"nopea ruskea kettu {i} hyppää laiskan koiran yli ja menee kotiin", "fi") for i in range(12)]
    docs = spark.createDataFrame(english + finnish, "doc_id long, text string, lang string")
    got = langid.identify(docs, sample_docs=300).toPandas().set_index("doc_id")["lang_pred"]
    assert (got[got.index >= 10_000] == "fi").all() and (got[got.index < 10_000] == "en").all()
