"""The pipeline's stages, each judged on its own input, and the guard of the entry module."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from recallforge.llm import mixing, pii

from .test_llm_small import groups, words

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(input, output) of each stage, written and read as in run()."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name], docs = (docs, after), after
    return out


def test_all_but_the_last_keep_the_columns(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [after.columns == columns for _, after in steps.values()] == [True] * 4 + [False]


def test_language_keeps_clean_documents(steps):
    before, after = (x.toPandas() for x in steps["language"])
    gone = before[~before["doc_id"].isin(after["doc_id"])]
    assert len(gone) <= 0.02 * len(before)


def test_one_of_each_group_stays(steps):
    before, after = (x.toPandas() for x in steps["near_dedup"])
    component, _ = groups(dict(zip(before["doc_id"], before["text"])))
    assert sorted(after["doc_id"]) == sorted(i for i, c in component.items() if i == c)


def test_private_data_is_gone(spark, steps):
    before, after = (x.toPandas().set_index("doc_id") for x in steps["pii"])
    found = steps["pii"][0].select("doc_id", pii.entities(pii.F.col("text")).alias("e")).where("size(e) > 0").toPandas()
    assert len(found) and sorted(before.index) == sorted(after.index)
    for i, entities in zip(found["doc_id"], found["e"]):
        assert not any(e in after.loc[i, "text"] for e in entities)
    same = ~before.index.isin(found["doc_id"])
    assert (before["text"][same] == after["text"][before.index][same]).all()


def test_sources_come_near_their_targets(steps):
    before, after = (x.toPandas() for x in steps["mixing"])
    taken = mixing.Mix(steps["mixing"][0], block_words=corpus_pipeline.MIX_BLOCK_WORDS).taken().toPandas().merge(before[["doc_id", "source"]], on="doc_id")
    got = after.assign(n=[len(words(t)) for t in after["text"]]).groupby("source")["n"].sum()
    want = taken.groupby("source")["target"].first()
    assert ((got - want).abs() <= corpus_pipeline.MIX_BLOCK_WORDS / 2 + 1).all()
    held = after.assign(n=[len(words(t)) for t in after["text"]]).groupby("doc_id")["n"].sum()
    size = before.set_index("doc_id")["text"].map(lambda t: len(words(t)))
    assert (held <= 3 * size[held.index]).all()


def test_packing_holds_every_document(steps):
    before, after = (x.toPandas() for x in steps["packing"])
    assert sorted(after[after["start"] == 0]["doc_id"]) == sorted(before["doc_id"])
    assert after.groupby("sequence_id")["length"].sum().max() <= 2048


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_nulls(spark, tmp_path):
    rows = [(None, "some text in here", "en", None, None), (1, None, None, None, None), (2, "some text in here", "en", "s", 5), (2, "some text in here", "en", "s", 5), (3, "other words of text there", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"].dropna()) <= {2, 3}


def test_the_rest_works_without_this_folder(tmp_path):
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "recallforge"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall' in q and 'pipeline' in q and len([n for n in q if n.startswith('op')]) == 13"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=alone)
    (tmp_path / "corpus_pipeline.py").rename(tmp_path / "elsewhere")
    subprocess.run([sys.executable, "-c", code.replace("'pipeline' in", "'pipeline' not in")], cwd=tmp_path, check=True, timeout=120, env=alone)
    (tmp_path / "elsewhere").rename(tmp_path / "corpus_pipeline.py")
    shutil.rmtree(tmp_path / "recallforge" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=alone)
