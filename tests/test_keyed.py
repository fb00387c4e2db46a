"""Keyed state and sources that read only what is new."""

import io
import os

from recallforge.sources import files, folders
from recallforge.streaming import keyed

TURNS = "session_id long, line_no long, text string"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_batch_writes_the_keys_it_touches_and_a_restart_goes_on(spark, tmp_path):
    inbox, checkpoint, got = str(tmp_path / "in"), str(tmp_path / "cp"), []

    def run():
        turns = spark.readStream.schema(TURNS).parquet(inbox)
        return keyed.ingest_turns(turns, lambda df, n: got.extend(map(tuple, df.collect())), checkpoint)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, [(i, 0, f"a{i}") for i in range(30)] + [(7, 1, "b7")], TURNS, inbox)
    query = run()
    query.awaitTermination()
    assert sorted(got)[7] == (7, "a7\nb7", 2, 1) and len(got) == 30
    got.clear()
    put(spark, [(7, 1, "again"), (7, 2, "c7"), (8, 0, "old"), (99, 4, "new")], TURNS, inbox)
    query = run()  # a new query on the same folder: a restart
    query.awaitTermination()
    assert sorted(got) == [(7, "c7", 1, 2), (99, "new", 1, 4)]
    operator = query.lastProgress["stateOperators"][0] if query.lastProgress["stateOperators"] else query.recentProgress[0]["stateOperators"][0]
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) == 2
    assert operator["numRowsTotal"] == 31
    state = {r["session_id"]: (r["archived"], r["last_staged_line"]) for r in keyed.session_checkpoints(spark, checkpoint).collect()}
    assert len(state) == 31 and state[7] == (False, 2) and state[8] == (False, 0) and state[99] == (False, 4)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_known_checkpoints_come_first(spark, tmp_path):
    inbox, got = str(tmp_path / "in"), []
    put(spark, [(1, 3, "old"), (1, 5, "new"), (2, 0, "x")], TURNS, inbox)
    known = spark.createDataFrame([(1, True, 3), (5, False, 2)], "session_id long, archived boolean, last_staged_line long")
    turns = spark.readStream.schema(TURNS).parquet(inbox)
    keyed.ingest_turns(turns, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "cp"), known).awaitTermination()
    assert sorted(got) == [(1, "new", 1, 5), (2, "x", 1, 0)]
    state = {r["session_id"]: (r["archived"], r["last_staged_line"]) for r in keyed.session_checkpoints(spark, str(tmp_path / "cp")).collect()}
    assert state == {1: (True, 5), 2: (False, 0), 5: (False, 2)}


def test_blobs_are_put_and_touched(spark, tmp_path):
    accesses, inbox, touched = "content string, ts long, kind string", str(tmp_path / "in"), []

    def run():
        stream = spark.readStream.schema(accesses).parquet(inbox)
        keyed.track_blobs(stream, str(tmp_path / "cp"), lambda df, n: touched.extend(r["puts"] for r in df.collect())).awaitTermination()

    put(spark, [("x", 5, "k"), ("x", 9, "later"), ("y", 1, None)], accesses, inbox)
    run()
    put(spark, [("x", 3, "first"), ("x", 4, "k")], accesses, inbox)
    run()
    assert sorted(touched) == [1, 2, 4]
    rows = {r["puts"]: tuple(r)[1:] for r in keyed.blob_entries(spark, str(tmp_path / "cp")).collect()}
    assert rows == {4: (3, 9, 1, "first", 4), 1: (1, 1, 1, None, 1)}


class Counted(io.BytesIO):
    count = 0

    def read(self, n=-1):
        data = super().read(n)
        self.count += len(data)
        return data


def test_only_tails_are_read():
    head = b"".join(b"line %d\n" % i for i in range(50_000))
    data = head + b"unfin" + b"ished\nnext\nopen"
    f = Counted(data)
    a = len(head) + 5
    assert list(folders.lines_between(f, a, len(data))) == [(len(head), b"unfinished"), (len(head) + 11, b"next")]
    assert f.count <= folders._BACK + len(data) - a
    assert [x for _, x in folders.lines_between(Counted(data), 0, len(data))] == data.split(b"\n")[:-1]
    long = b"x" * 20_000 + b"\ny\n"
    assert list(folders.lines_between(Counted(long), 15_000, len(long))) == [(0, b"x" * 20_000), (20_001, b"y")]


def test_growing_transcripts_stream_what_is_new(spark, tmp_path):
    root, got = tmp_path / "root", []
    (root / "p").mkdir(parents=True)
    (root / "p" / "deeper").mkdir()
    (root / "p" / "deeper" / "no.jsonl").write_text("no\n")
    (root / "no.jsonl").write_text("no\n")

    def run():
        got.clear()
        lines = folders.transcript_stream(spark, str(root))
        lines.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    (root / "p" / "a.jsonl").write_text("one\ntwo\nhal")
    assert run() == [("p/a.jsonl", 0, "one"), ("p/a.jsonl", 4, "two")]
    with open(root / "p" / "a.jsonl", "a") as f:
        f.write("f\n")
    (root / "p" / "b.jsonl").write_text("é\n\nend\n")
    assert run() == [("p/a.jsonl", 8, "half"), ("p/b.jsonl", 0, "é"), ("p/b.jsonl", 3, ""), ("p/b.jsonl", 4, "end")]
    (root / "p" / "b.jsonl").write_text("new\n")
    assert run() == [("p/b.jsonl", 0, "new")]


def test_pruned_folders_are_not_listed(spark, tmp_path):
    for path in ("a/x.py", "a/.git/y.py", "node_modules/deep/z.js", "a/b/w.rs", "a/b/readme.md", "a/py", "target/t.rs", ".hidden/h.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("content")
    (tmp_path / "a" / "bad.py").write_bytes(b"\xff\xfe")
    listed = []
    store, root = folders.opened(str(tmp_path))
    own = folders.lister(store)
    found = list(folders.walk(lambda f: listed.append(os.path.relpath(f, root)) or own(f), root, folders.is_source_folder, folders.is_source_file))
    assert sorted(listed) == [".", "a", "a/b"]
    assert sorted(p for p, _ in found) == ["a/b/w.rs", "a/bad.py", "a/x.py"]
    rows = [tuple(r) for r in files.source_tree(spark, str(tmp_path)).collect()]
    assert rows == [("a/b/w.rs", "content"), ("a/bad.py", None), ("a/x.py", "content")]
    assert files.source_tree(spark, str(tmp_path / "none")).collect() == []
