"""What a Python worker holds: one portion of texts at a time, and nothing of a stage that it has left."""

import gc
import weakref

import numpy as np
import pyarrow as pa

from recallforge.llm import langid
from recallforge.llm._shared import frugal, kept
from recallforge.llm._tokens import Encoder, default_tokenizer


def test_a_worker_drops_the_tokenizer_of_another_stage():
    made = []

    def encodes(batches):
        made.append(weakref.ref(Encoder.of(default_tokenizer())))
        yield from batches

    def scores(batches):
        yield from batches

    for _ in range(2):
        list(frugal(encodes)(iter(())))
    assert made[0]() is made[1]() is not None  # kept between the tasks of one stage
    list(frugal(scores)(iter(())))
    gc.collect()
    assert made[0]() is None


def test_what_is_kept_is_made_once_per_stage():
    count = []

    def stage(batches):
        kept("table", lambda: count.append(1))
        yield from batches

    for _ in range(3):
        list(frugal(stage)(iter(())))
    assert len(count) == 1


def test_language_is_scored_in_portions(monkeypatch):
    model = langid.Model(pa.array(["hund", "und", "and"]), pa.array(["de", "de", "en"]), np.array([3, 9, 8]))
    texts = [None, "", *[f"hund und {i} and x{i} " * (i % 7) for i in range(3000)], "und " * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], ["text", "doc_id"])
    want = langid.Scorer(model).predict(batch.column(0))
    sizes, plain = [], langid.Scorer.predict

    def predict(self, portion):
        sizes.append(sum(len(t or "") for t in portion.to_pylist()))
        return plain(self, portion)

    monkeypatch.setattr(langid, "_PORTION_BYTES", 10_000)
    monkeypatch.setattr(langid.Scorer, "predict", predict)
    got = pa.Table.from_batches(langid.scored(iter([batch]), langid.Scorer(model), 0, ["text", "doc_id"]))
    assert len(sizes) > 20 and max(sizes[:-2]) <= 10_000 + 200 and max(sizes) <= 10_000 + 20_000
    assert got.column("text").to_pylist() == texts and got.column("doc_id").to_pylist() == list(range(len(texts)))
    assert got.column("lang_pred").to_pylist() == want[0] and np.allclose(got.column("score").to_numpy(), want[1])


def test_the_pipeline_sends_a_text_to_a_worker_once(spark):
    docs = spark.createDataFrame([(i, f"some text {i}", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    kept_rows = langid.known_language(docs)
    plan = kept_rows._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert plan.children().head().output().size() == len(docs.columns)
    assert sorted(r["doc_id"] for r in kept_rows.collect()) == list(range(9))
