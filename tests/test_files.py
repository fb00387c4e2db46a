"""Readers, sinks, code extraction and streams on small files."""

import gzip
import json
import os

import pytest

from recallforge.operators import extract
from recallforge.sources import files
from recallforge.streaming import ingest


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_markdown(spark, tmp_path):
    write(tmp_path / "b.md", "two")
    write(tmp_path / "a.md", "---\nt: 1\n---\none")
    write(tmp_path / ".hidden.md", "no")
    write(tmp_path / "sub" / "c.md", "three")
    write(tmp_path / "sub" / "MEMORY.md", "no")
    write(tmp_path / "x.txt", "no")
    assert [tuple(r) for r in files.wiki_entries(spark, str(tmp_path)).collect()] == [("a", "---\nt: 1\n---\none"), ("b", "two")]
    assert files.wiki_entries(spark, str(tmp_path / "none")).count() == 0
    got = [(r["slug"], r["summary"]) for r in files.import_entries(spark, str(tmp_path)).collect() if not r["path"].startswith(".")]
    assert got == [("a", "one"), ("b", "two"), ("c", "three")]


def test_transcripts(spark, tmp_path):
    write(tmp_path / "p" / "s.jsonl", '{"a": 1}\n\n{"b": 2}')
    write(tmp_path / "top.jsonl", "no")
    write(tmp_path / "p" / "q" / "deep.jsonl", "no")
    got = [(r["line_no"], r["line"]) for r in files.transcripts(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(0, '{"a": 1}'), (1, ""), (2, '{"b": 2}')]


def test_blobs_and_sidecars(spark, tmp_path):
    from recallforge.operators import blobs

    for h, meta in (("ab" * 8, '{"last_seen": 1, "size": 2}'), ("cd" * 8, "broken"), ("ef" * 8, None)):
        folder = tmp_path / "objects" / h[:2] / h[2:4]
        write(folder / f"{h}.bin", b"\xff\x00")
        if meta:
            write(folder / f"{h}.meta.json", meta)
    objects, sidecars = files.blob_objects(spark, str(tmp_path))
    assert objects.count() == 3
    assert [r["handle"] for r in blobs.with_sidecars(objects, sidecars).collect()] == ["ccr_" + "ab" * 8]


def test_sinks(spark, tmp_path):
    write(tmp_path / "t.jsonl", "line\n")
    files.archive(str(tmp_path / "t.jsonl"), str(tmp_path / "out" / "t.gz"))
    assert gzip.open(tmp_path / "out" / "t.gz").read() == b"line\n" and not (tmp_path / "t.jsonl").exists()
    index = str(tmp_path / "index.md")
    frame = lambda x: spark.createDataFrame(x, "slug string, summary string")
    files.write_index(frame([("a", "one"), ("b", "two")]), index)
    files.write_index(frame([("a", "three")]), index)
    assert open(index).read().splitlines()[-2:] == ["- `a` — three", "- `b` — two"]


def test_persona_manifest(spark, tmp_path):
    good = {"slug": "s", "bank": "b", "description": "d", "source_label": "l", "artifacts": ["x"]}
    write(tmp_path / "m.json", json.dumps(good))
    assert files.persona_manifest(spark, str(tmp_path / "m.json"), "other").first()["bank"] == "other"
    write(tmp_path / "m.json", json.dumps(good | {"artifacts": []}))
    with pytest.raises(ValueError):
        files.persona_manifest(spark, str(tmp_path / "m.json"))


def test_lease_and_origin(tmp_path):
    lease = files.Lease(str(tmp_path))
    with lease:
        assert not lease.reclaim()
        with pytest.raises(FileExistsError):
            files.Lease(str(tmp_path)).__enter__()
    write(tmp_path / ".lock", "pid=999999999\n")
    assert lease.reclaim() and not os.path.exists(lease.path)
    write(tmp_path / ".lock", "nonsense")
    assert lease.reclaim()
    assert files.origin_url('[remote "up"]\n url = a\n[remote "origin"]\n  url = b:c/d.git\n') == "b:c/d.git"
    assert files.origin_url("[core]\n") is None


def test_doctor(tmp_path):
    def status(**more):
        return {name: s for name, s, _ in files.doctor(str(tmp_path), **more)}

    assert status() == {"data_root": "pass", "bank": "pass", "lock": "pass", "embedder": "skipped"}
    bank, models = str(tmp_path / "bank"), str(tmp_path / "models")
    assert status(bank=bank, models=models, make=list) == {"data_root": "pass", "bank": "warn", "lock": "pass", "models": "pass", "embedder": "pass"}
    assert status(make=lambda: 1 / 0)["embedder"] == "fail" and status(make=lambda: 1 / 0, quick=True)["embedder"] == "skipped"
    write(tmp_path / "file", "x")
    assert status(models=str(tmp_path / "file"))["models"] == "fail"
    said = []
    for text in (f"pid={os.getpid()}\n", "pid=999999999\n", "nonsense"):
        write(tmp_path / ".lock", text)
        said += [(s, m) for name, s, m in files.doctor(str(tmp_path)) if name == "lock"]
    assert [s for s, _ in said] == ["warn"] * 3 and "live" in said[0][1] and "stale" in said[1][1] and "names no process" in said[2][1]


RUST = """
// a comment with fn fake() {}
pub struct Dog<T> { name: T }
enum Kind { A, B(u8) }
pub trait Speak { fn speak(&self) -> String { helper() } }
impl<T: Clone> Speak for Dog<T> where T: Copy {
    fn speak(&self) -> String { self.bark(1); util::helper("fn no()"); println!("{}", hidden()); String::new() }
}
impl Dog<u8> { pub async fn bark(&self, n: u8) { if n > 0 { helper() } } }
#[test] fn helper() { let f = |x: u8| inner(x); f(1); }
mod inside { fn unseen() {} }
"""
TS = """
interface Speaker { speak(): void }
class Base {}
class Dog extends Base implements Speaker {
  private age = compute();
  constructor() { super(); init(); }
  async speak(): Promise<void> { this.bark(); helper(`x ${no()}`); }
}
function helper(x) { return new Dog().speak(); }
export function unseen() {}
const arrow = () => helper();
"""
GO = """
package p
type Dog struct { n int }
type ( Cat struct{}; Speaker interface { Speak() string } )
func (d *Dog) Speak() string { return bark(d.n) }
func bark(n int) string { fmt.Println("x"); return helper() }
"""
PY = """
class Base: pass
class Dog(Base, mod.Other):
    def speak(self):
        self.bark(); helper()
    @property
    def unseen(self): ...
async def helper(): return len(str(1))
@deco
def hidden(): ...
"""


def of(rel, source, what):
    return [(a, b) for w, a, b in extract.read_file(rel, source) if w == what]


def test_rust():
    assert dict(of("a.rs", RUST, "node")) == {
        "a.rs": "File\ta.rs", "a.rs::Dog": "Struct\tDog", "a.rs::Kind": "Enum\tKind", "a.rs::Speak": "Trait\tSpeak",
        "a.rs::Dog<T>::speak": "Function\tspeak", "a.rs::Dog<u8>::bark": "Function\tbark", "a.rs::helper": "Function\thelper",
    }
    assert of("a.rs", RUST, "impl") == [("a.rs::Dog<T>", "Speak")]
    assert of("a.rs", RUST, "call") == [("a.rs::Dog<T>::speak", "bark"), ("a.rs::Dog<T>::speak", "helper"), ("a.rs::Dog<T>::speak", "new"), ("a.rs::Dog<u8>::bark", "helper"), ("a.rs::helper", "inner"), ("a.rs::helper", "f")]


def test_script():
    assert [i for i, _ in of("a.ts", TS, "node")] == ["a.ts", "a.ts::Speaker", "a.ts::Base", "a.ts::Dog", "a.ts::Dog::constructor", "a.ts::Dog::speak", "a.ts::helper"]
    assert of("a.ts", TS, "impl") == [("a.ts::Dog", "Base"), ("a.ts::Dog", "Speaker")]
    assert of("a.ts", TS, "call") == [("a.ts::Dog::constructor", "init"), ("a.ts::Dog::speak", "bark"), ("a.ts::Dog::speak", "helper"), ("a.ts::helper", "speak")]


def test_go():
    assert of("a.go", GO, "node")[1:] == [("a.go::Dog", "Struct\tDog"), ("a.go::Cat", "Struct\tCat"), ("a.go::Speaker", "Trait\tSpeaker"), ("a.go::Dog::Speak", "Function\tSpeak"), ("a.go::bark", "Function\tbark")]
    assert of("a.go", GO, "call") == [("a.go::Dog::Speak", "bark"), ("a.go::bark", "Println"), ("a.go::bark", "helper")]
    assert not of("a.go", GO, "impl")


def test_python():
    assert [i for i, _ in of("a.py", PY, "node")] == ["a.py", "a.py::Base", "a.py::Dog", "a.py::Dog::speak", "a.py::helper"]
    assert of("a.py", PY, "impl") == [("a.py::Dog", "Base")]
    assert of("a.py", PY, "call") == [("a.py::Dog::speak", "bark"), ("a.py::Dog::speak", "helper"), ("a.py::helper", "len"), ("a.py::helper", "str")]
    assert of("b.py", "def broken(", "node") == [("b.py", "File\tb.py")]


def test_build_and_update(spark, tmp_path):
    write(tmp_path / "a.py", "def one():\n    two()\n")
    write(tmp_path / "b" / "c.py", "def two(): ...\nclass K(Base): ...\n")
    write(tmp_path / "b.go", "package b\nfunc two() {}\ntype Base struct{}\n")
    write(tmp_path / "node_modules" / "x.js", "function no() {}")
    write(tmp_path / ".git" / "y.py", "def no(): ...")
    write(tmp_path / "bad.py", b"\xff\xfe")
    tree = files.source_tree(spark, str(tmp_path))
    assert [r["rel"] for r in tree.collect()] == ["a.py", "b/c.py", "b.go", "bad.py"]  # by components
    nodes, edges = extract.build(tree)
    found = {tuple(r) for r in edges.collect() if r["kind"] != "Contains"}
    assert found == {("a.py::one", "b/c.py::two", "Calls"), ("b/c.py::K", "b.go::Base", "Implements")}
    old = extract.manifest(tree)
    edges, old = extract.stored(edges, "e"), extract.stored(old, "m")
    write(tmp_path / "b" / "c.py", "def two():\n    one()\n")
    (tmp_path / "b.go").unlink()
    new_nodes, new_edges, new_manifest = extract.update(nodes, edges, old, files.source_tree(spark, str(tmp_path)))
    assert {r["id"] for r in new_nodes.collect()} == {"a.py", "a.py::one", "b/c.py", "b/c.py::two"}
    assert {tuple(r) for r in new_edges.collect() if r["kind"] != "Contains"} == {("b/c.py::two", "a.py::one", "Calls")}
    assert {r["rel"] for r in new_manifest.collect()} == {"a.py", "b/c.py"}


def test_streams(spark, tmp_path):
    turns = "session_id long, line_no long, text string"
    inbox = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x")], turns).coalesce(1).write.parquet(inbox)
    state = ingest.VersionedTable(spark, f"file://{tmp_path}/state", ingest.CHECKPOINTS)
    got = []
    run = lambda: ingest.ingest_turns(spark.readStream.schema(turns).parquet(inbox), state, lambda d, n: got.extend(map(tuple, d.collect())), str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(got) == [(1, "a\nb", 2, 1), (2, "x", 1, 0)]
    got.clear()
    spark.createDataFrame([(1, 1, "again"), (1, 2, "c")], turns).coalesce(1).write.mode("append").parquet(inbox)
    run()
    assert got == [(1, "c", 1, 2)]
    assert {tuple(r) for r in state.read().collect()} == {(1, False, 2), (2, False, 0)}

    accesses = "content string, ts long, kind string"
    spark.createDataFrame([("x", 5, "k"), ("x", 9, "k")], accesses).write.parquet(str(tmp_path / "acc"))
    objects = ingest.VersionedTable(spark, f"file://{tmp_path}/objects", ingest.OBJECTS)
    ingest.track_blobs(spark.readStream.schema(accesses).parquet(str(tmp_path / "acc")), objects, str(tmp_path / "cp2")).awaitTermination()
    row = objects.read().first()
    assert (row["created_at"], row["last_seen"], row["puts"]) == (5, 9, 2)


def test_hourly_activity_plans(spark, tmp_path):
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path))
    assert ingest.hourly_activity(events).columns == ["window", "event_type", "n"]
