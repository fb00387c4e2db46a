"""N-grams that are sent to the filter: few probes of many, few rows, each text once, and no shuffle left behind."""

import numpy as np
import pytest

from recallforge.llm import bloom_lm
from recallforge.llm._shared import shuffles_freed

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_rows_are_probed_together(monkeypatch, most):
    monkeypatch.setattr(bloom_lm, "PROBED_BYTES", most)
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 60_000, n).astype("<u8") for n in [0, 3, 0, 1, 7, 2, 0]]
    calls = []

    def found(keys):
        calls.append(len(keys))
        return keys.astype(np.int64) + 1

    got = bloom_lm.told(found, [x.tobytes() for x in rows])
    assert [np.frombuffer(x, "<u2").tolist() if x else [] for x in got] == [(x + 1).tolist() for x in rows]
    assert sum(calls) == 13 and (len(calls) == 1 or most < 1 << 20)
    assert bloom_lm.told(found, []) == []


def test_only_copies_are_shuffled_to_be_found(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (1, "a b"), (3, None)], "k long, text string")
    copies = spark.createDataFrame([(1,)], "k long")
    once = bloom_lm.distinct_texts(docs, copies)
    assert once._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 2  # and none that shuffles texts
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a b"), (2, "c"), (3, None)]


def test_scores_of_several_shelves_and_rounds_are_the_same(spark, monkeypatch):
    rows = [(i % 70, f"w{i % 13} x{i % 7} y{i * i % 31} " * (i % 9)) for i in range(200)] + [(None, None), (None, ""), (None, None), (5, "z z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(bloom_lm, "BUCKET_BYTES", 100)
    monkeypatch.setattr(bloom_lm, "PORTION_BYTES", 700)
    monkeypatch.setattr(bloom_lm, "SHELF", 3)
    found = []
    for most in (1 << 30, 0):
        monkeypatch.setattr(bloom_lm, "MOST_BYTES", most)
        found.append(sorted(map(tuple, bloom_lm.score_documents(docs).collect()), key=str))
    assert len(found[0]) == len(rows) and found[0] == found[1]


def test_shuffles_are_freed_within_only(spark):
    before = spark.conf.get(FREED, None)
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        assert spark.conf.get(FREED) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(FREED, None) == before
