"""Updates of a code index against clean builds."""

import random
from collections import Counter

from recallforge.operators import code_index, extract
from recallforge.sources import state

FILES = "rel string, content string"


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), FILES)


def content(r):
    lines = []
    for _ in range(r.randint(0, 3)):
        base = f"({r.choice('XYZ')})" if r.random() < 0.6 else ""
        lines += [f"class {r.choice('XYZ')}{base}:", f"    def {r.choice('fgh')}(self):", f"        {r.choice('fgh')}()", f"        {r.choice('fgh')}()"]
    for _ in range(r.randint(0, 2)):
        lines += [f"def {r.choice('fgh')}():", f"    return {r.choice('fghXYZ')}()"]
    return "\n".join(lines) + "\n"


def edges(index):
    return Counter(tuple(r) for r in index.edges().collect())


def clean(spark, files):
    return Counter(tuple(r) for r in extract.build(frame(spark, files))[1].collect())


def test_updates_equal_clean_builds(spark):
    r = random.Random(4)
    files = {f"{d}/{n}.py": content(r) for d in ("a", "a/b", "c") for n in "pqr"}
    index = code_index.build(frame(spark, files))
    assert edges(index) == clean(spark, files)
    for step in range(3):
        for rel in r.sample(sorted(files), 3):
            files[rel] = content(r)
        del files[r.choice(sorted(files))]
        files[f"a{step}/new.py"] = content(r)
        index = code_index.update(index, frame(spark, files))
        assert edges(index) == clean(spark, files)
    assert sorted((x["rel"], x["hash"]) for x in index.manifest.collect()) == sorted((x["rel"], x["hash"]) for x in extract.manifest(frame(spark, files)).collect())
    built = extract.build(frame(spark, files))[0].orderBy("ord").collect()
    assert [(x["id"], x["kind"]) for x in index.ordered_nodes().orderBy("ord").collect()] == [(x["id"], x["kind"]) for x in built]


def test_edges_from_unchanged_files_stay(spark):
    """What extract.update loses by design."""
    files = {"a.py": "def caller():\n    target()\n", "b.py": "def target():\n    pass\n"}
    index = code_index.build(frame(spark, files))
    files["b.py"] = "def other():\n    pass\n\ndef target():\n    pass\n"
    assert ("a.py::caller", "b.py::target", "Calls") in edges(code_index.update(index, frame(spark, files)))
    plain = extract.build(frame(spark, {**files, "b.py": "def target():\n    pass\n"}))
    assert ("a.py::caller", "b.py::target", "Calls") not in {tuple(r) for r in extract.update(*plain, extract.manifest(frame(spark, {**files, "b.py": "def target():\n    pass\n"})), frame(spark, files))[1].collect()}


def test_names_that_move_and_come_back(spark):
    a, b, c = "def caller():\n    f()\n", "def f():\n    pass\n", "class f:\n    pass\n"
    index = code_index.build(frame(spark, {"m.py": a}))
    assert index.references.collect()[0]["dst"] is None
    index = code_index.update(index, frame(spark, {"m.py": a, "z.py": b}))
    assert ("m.py::caller", "z.py::f", "Calls") in edges(index)
    index = code_index.update(index, frame(spark, {"m.py": a, "z.py": b, "b.py": b}))
    assert ("m.py::caller", "b.py::f", "Calls") in edges(index)
    index = code_index.update(index, frame(spark, {"m.py": a, "b.py": c}))
    assert not [e for e in edges(index) if e[2] == "Calls"]


def test_unreadable_files_keep_what_they_had(spark):
    index = code_index.build(frame(spark, {"a.py": "def f():\n    f()\n"}))
    after = code_index.update(index, spark.createDataFrame([("a.py", None)], FILES))
    assert edges(after) == edges(index)


def test_saved_indexes_go_on(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = {"a.py": "def f():\n    g()\n"}
    state.save_index(code_index.update(state.load_index(spark, root), frame(spark, files)), root)
    files["b.py"] = "def g():\n    pass\n"
    state.save_index(code_index.update(state.load_index(spark, root), frame(spark, files)), root)
    assert edges(state.load_index(spark, root)) == clean(spark, files)
