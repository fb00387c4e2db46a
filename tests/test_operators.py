"""Operators on small tables, against what was worked out by hand or by plain models."""

import inspect
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallforge.operators import blobs, graph, search, sessions, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def evict(objects, now, max_age, cap):
    left = {h: (t, s) for h, t, s in objects if max(now - t, 0) < max_age}
    gone = {h for h, _, _ in objects} - set(left)
    total = sum(s for _, s in left.values())
    for h, (t, s) in sorted(left.items(), key=lambda x: (x[1][0], x[0])):
        if total <= cap:
            break
        gone.add(h)
        total -= s
    return gone


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20)), min_size=1, max_size=30), st.integers(0, 60), st.integers(0, 200))
def test_eviction(spark, objects, age, cap):
    data = [(f"h{i:02}", t, s) for i, (t, s) in enumerate(objects)]
    got = blobs.evictions(spark.createDataFrame(data, "handle string, last_seen long, size long"), 55, age, cap, rows_per_range=4)
    assert {r["handle"] for r in got.where("evicted").collect()} == evict(data, 55, age, cap)


@pytest.mark.parametrize("moments", [1, 3, 10_000])
def test_a_bulk_load_of_one_moment_is_split(spark, moments, monkeypatch):
    """Objects of equal times are dealt to ranges as evenly as others, and evicted in order of their handles."""
    objects = [(f"h{i * 7919 % 10_007:05d}", i % moments, i % 9) for i in range(3000)]
    seen = []
    monkeypatch.setattr(blobs, "dealt_in_order", (lambda f: lambda *a: seen.append(x := f(*a)) or x)(blobs.dealt_in_order))
    out = blobs.evictions(spark.createDataFrame(objects, "handle string, last_seen long, size long"), 0, 10**6, 4000, rows_per_range=300)
    total, want = sum(o[2] for o in objects), set()
    for handle, _, size in sorted(objects, key=lambda o: (o[1], o[0])):
        if total > 4000:
            want.add(handle)
            total -= size
    assert {r["handle"] for r in out.where("evicted").collect()} == want
    sizes = [r["count"] for r in seen[0].groupBy("range").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_three_blobs_with_a_cap(spark):
    data = [("a", 1, 11), ("b", 2, 11), ("c", 3, 11)]
    got = blobs.evictions(spark.createDataFrame(data, "handle string, last_seen long, size long"), 3, 1000, 15)
    assert rows(blobs.gc_report(got)) == [(2, 22)]


def test_blob_put_touch_get(spark):
    puts = spark.createDataFrame([("x", 1, "k"), ("x", 5, "l"), ("y", 2, None)], "content string, ts long, kind string")
    objects = blobs.put(puts)
    x = objects.where("puts = 2").first()
    assert (x["created_at"], x["last_seen"], x["size"], x["kind"]) == (1, 5, 1, "k")
    touched = blobs.touch(objects, spark.createDataFrame([(x["handle"], 3)], "handle string, ts long"))
    assert touched.where("puts = 2").first()["last_seen"] == 5
    asked = spark.createDataFrame([(x["handle"],), ("ccr_" + "0" * 16,), ("ccr_0",), (x["handle"].upper(),)], "handle string")
    assert [r[1] for r in rows(blobs.get(objects, asked).select("handle", "outcome"))].count("malformed") == 2
    assert blobs.stats(objects.limit(0)).first()["oldest_last_seen"] is None


NODES = [("a", "Function", "f", 1), ("hub", "Struct", "h", 2), ("b", "Function", "f", 3), ("c", "Trait", "h", 4), ("alone", "Enum", "e", 5)]
EDGES = [("a", "hub", "Calls"), ("b", "hub", "Calls"), ("hub", "c", "Uses"), ("b", "hub", "Calls"), ("c", "c", "Uses")]


def tables(spark):
    return spark.createDataFrame(NODES, "id string, kind string, name string, ord long"), spark.createDataFrame(EDGES, "src string, dst string, kind string")


def test_degrees_and_paths(spark):
    n, e = tables(spark)
    assert dict(rows(graph.degrees(n, e))) == {"hub": 4, "a": 1, "b": 2, "c": 3, "alone": 0}
    assert [r["id"] for r in graph.god_nodes(n, e, 2).collect()] == ["hub", "c"]
    path = lambda a, b: [r["id"] for r in graph.shortest_path(n, e, a, b).orderBy("step").collect()]
    assert path("a", "c") == ["a", "hub", "c"]
    assert path("c", "a") == [] and path("a", "nowhere") == [] and path("alone", "alone") == ["alone"]


def test_a_search_ends_at_an_empty_frontier_only(spark, monkeypatch):
    monkeypatch.setattr(graph, "STORED_HOPS", 2)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "Calls") for i in range(7)], "src string, dst string, kind string")
    assert rows(graph.bfs(chain, "n0").select("id", "hops")) == [(f"n{i}", i) for i in range(8)]
    assert "most_hops" not in inspect.signature(graph.bfs).parameters


def test_a_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    """10,000 steps, with a fork on the way whose branches are equally long: the smaller predecessor wins."""
    n, written = 10_000, []
    monkeypatch.setattr(graph, "stored", (lambda f: lambda df, name: written.append(name) or f(df, name))(graph.stored))
    links = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [("n4000", "m1"), ("m1", "m2"), ("m2", "n4003")]
    links += [("ring1", "ring2"), ("ring2", "ring1"), ("n7", "n7")]
    e = spark.createDataFrame([(a, b, "Calls") for a, b in links], "src string, dst string, kind string").repartition(4)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    path = [r["id"] for r in graph.shortest_path(nodes, e, "n0", f"n{n}").orderBy("step").collect()]
    assert path == [f"n{i}" for i in range(4001)] + ["m1", "m2"] + [f"n{i}" for i in range(4003, n + 1)]
    assert len(written) <= 8 * n.bit_length()


def test_models_are_made_once_in_a_process(spark):
    import numpy as np

    from recallforge.operators import embedders

    made, tries = spark.sparkContext.accumulator(0), []

    def make():
        made.add(1)
        return lambda texts: np.array([[float(len(t))] for t in texts])

    texts = spark.range(40).selectExpr("id", "cast(id as string) as text").repartition(20)
    embed = embedders.batched(make)
    assert embed(texts, ["id"]).count() == embed(texts, ["id"]).count() == 40
    assert 1 <= made.value <= 2 * spark.sparkContext.defaultParallelism < 40

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not there yet")
        return len

    assert embedders.model_of("flaky", flaky, wait=0) is len and embedders.model_of("flaky", flaky) is len and len(tries) == 3
    with pytest.raises(OSError):
        embedders.model_of("broken", lambda: open("/none/such"), attempts=2, wait=0)


def test_edges_are_kept_with_repeats(spark):
    n, e = tables(spark)
    more = e.unionByName(spark.createDataFrame([("a", "gone", "Calls")], e.schema))
    assert len(rows(graph.valid_edges(n, more))) == 5


def test_upsert_keeps_the_place(spark):
    n, _ = tables(spark)
    again = graph.upsert_nodes(n, spark.createDataFrame([("a", "Struct", "g", 9)], n.schema))
    assert tuple(again.where("id = 'a'").first()) == ("a", "Struct", "g", 1)


def test_first_by_name_and_fallback(spark):
    n, _ = tables(spark)
    pending = spark.createDataFrame([("alone", "f"), ("alone", "h"), ("x", "h")], "src string, name string")
    assert rows(graph.resolve_calls(n, pending)) == [("alone", "a", "Calls")]
    assert rows(graph.resolve_impls(n, pending)) == [("alone", "c", "Implements")]
    structs = graph.resolve_impls(n.where("kind <> 'Trait'"), pending)
    assert rows(structs) == [("alone", "hub", "Implements")]


def hops(edges, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for a, b in edges:
            if a == at and b not in seen:
                seen[b] = seen[at] + 1
                queue.append(b)
    return seen


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=16))
def test_bfs(spark, edges):
    e = spark.createDataFrame([(a, b, "k") for a, b in edges], "src string, dst string, kind string")
    assert dict(rows(graph.bfs(e, "a").select("id", "hops"))) == hops(edges, "a")


def smallest_path(links, start, goal):
    """Of the shortest paths the one whose predecessors, from the goal on, are the smallest."""
    at = hops(links, start)
    if goal not in at:
        return []
    path = [goal]
    while path[-1] != start:
        path.append(min(a for a, b in links if b == path[-1] and a != b and at.get(a, -2) == at[b] - 1))
    return path[::-1]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.sampled_from("abcdefghij")), min_size=8, max_size=24), st.sampled_from("bij"))
def test_paths(spark, links, goal):
    e = spark.createDataFrame([(a, b, "Calls") for a, b in links], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefghij"], "id string")
    assert [r["id"] for r in graph.shortest_path(nodes, e, "a", goal).orderBy("step").collect()] == smallest_path(links, "a", goal)


def test_manifest_diff(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "rel string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("e", "5")], "rel string, hash string")
    assert dict(rows(graph.manifest_diff(now, old))) == {"a": "unchanged", "b": "changed", "c": "unreadable", "d": "changed", "e": "deleted"}


def test_contained_pairs(spark):
    data = [(1, "the quick brown fox jumps"), (2, "he quick brown fox ju"), (3, " the quick brown fox jumps \n"), (4, "fox"), (5, ""), (6, "other words here now")]
    entries = spark.createDataFrame([("b", i, t) for i, t in data] + [("other", 7, "fox")], "bank string, id long, content string")
    clean = {i: t.strip() for i, t in data}
    want = {(i, j) for i in clean for j in clean if i < j and clean[i] and clean[j] and (clean[i] in clean[j] or clean[j] in clean[i])}
    assert {(r["a"], r["b"]) for r in search.contained_pairs(entries).collect()} == want


def test_similar_pairs_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 5))
    v[7] = v[3]
    entries = spark.createDataFrame([("b", i, [float(x) for x in r]) for i, r in enumerate(v)], "bank string, id long, vector array<double>")
    got = [(r["a"], r["b"]) for r in search.similar_pairs(entries, 0.5, block=8).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}


def test_leaders_are_order_dependent(spark):
    data = [("d", 1, [1.0, 0.0]), ("d", 2, [0.9, 0.3]), ("d", 3, [0.0, 1.0]), ("d", 4, [0.5, 0.9])]
    got = search.concept_clusters(spark.createDataFrame(data, "doc string, id long, vector array<double>"), 0.8)
    assert [r["id"] for r in got.orderBy("id").collect()] == [1, 3]


def test_concept_split(spark):
    s = "alpha beta gamma delta epsilon zeta eta theta."
    content = f"Too short. {s} {s.upper()} one two three four five six seven eight!"
    got = search.concept_split(spark.createDataFrame([(1, content), (2, ""), (3, "no")], "id long, content string"))
    assert [r["concept"] for r in got.orderBy("n").collect()] == [s, "one two three four five six seven eight!"]


def test_zero_vector_scores_zero(spark):
    from recallforge.functions.vectors import cosine

    f = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = spark.range(1).select(cosine(f(0, 0), f(1, 0)), cosine(f(1, 0), f(0, 1)), cosine(f(1, 0), f(-2, 0)), cosine(f(1, 1), f(2, 2))).first()
    assert [round(x, 9) for x in got] == [0, 0, -1, 1]


def test_checkpoints_are_set_not_raised(spark):
    before = spark.createDataFrame([("s", True, 9), ("t", False, 1)], "session_id string, archived boolean, last_staged_line long")
    staged = spark.createDataFrame([("s", 4), ("u", 2)], "session_id string, total_lines long")
    assert rows(sessions.stage_checkpoint(before, staged)) == [("s", True, 4), ("t", False, 1), ("u", False, 2)]
    assert rows(sessions.archive_checkpoint(before, spark.createDataFrame([("t",), ("t",)], "session_id string"))) == [("s", True, 9), ("t", True, 1)]


def test_session_meta_wants_strings(spark):
    lines = [(0, "{bad"), (1, '{"sessionId": 5, "cwd": "/a"}'), (2, '{"sessionId": "s", "cwd": null}'), (3, '{"sessionId": "s", "cwd": "/b"}'), (4, '{"sessionId": "t", "cwd": "/c"}')]
    got = sessions.session_meta(spark.createDataFrame([("p", *x) for x in lines], "path string, line_no long, line string"))
    assert rows(got) == [("p", "s", "/b")]


def test_checkpoint_maps(spark):
    got = sessions.checkpoint_state(spark.createDataFrame([('{"a": {"archived": true}, "b": {"last_staged_line": 3}}',), ("nonsense",)], "json string"))
    assert rows(got) == [("a", True, 0), ("b", False, 3)]


def test_modes_exclude_each_other():
    with pytest.raises(ValueError):
        sessions.check_modes(True, True)


def test_complete_keeps_what_is_there(spark):
    wiki = spark.createDataFrame([("j1", "old text")], "slug string, content string")
    results = spark.createDataFrame([("j1", "new"), ("j2", "fresh"), ("j9", "unasked")], "job_id string, result string")
    pending = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job_id string")
    after, index, left = store.complete(results, wiki, pending)
    assert rows(after) == [("j1", "old text"), ("j2", "fresh"), ("j9", "unasked")]
    assert rows(index) == [("j1", "old text"), ("j2", "fresh"), ("j9", "unasked")]
    assert rows(left) == [("j3",)]


def test_config_layers(spark):
    layers = spark.createDataFrame([('{"staging": {"min_turns": "3"}}', '{"staging": {"min_turns": 4}, "hooks": {"pre_compact": {"enabled": false}}}'), (None, None)], "project string, everywhere string")
    got = [r.asDict() for r in store.merge_config(layers, ["project", "everywhere"]).orderBy("min_turns").collect()]
    assert (got[0]["min_turns"], got[0]["pre_compact"], got[0]["ccr_max_bytes"]) == (1, True, 500_000_000)
    assert (got[1]["min_turns"], got[1]["pre_compact"]) == (4, False)
    with pytest.raises(Exception):
        store.merge_config(spark.createDataFrame([("{bad",)], "project string"), ["project"]).collect()


def test_bank_precedence(spark):
    cases = [("x", "f", "h:o/r", "/p"), (None, " f \n", "h:o/r", "/p"), (None, " ", "h:o/r", "/p"), (None, None, None, "/p"), (None, None, None, None)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, f string, o string, r string").orderBy("i")
    got = [r[0] for r in frame.select(store.resolve_bank(*map(F.col, "efor"))).collect()]
    assert got[:3] == ["x", "f", "o-r"] and got[3].startswith("repo-") and got[4] == "global"


def test_gc_due(spark):
    marks = spark.createDataFrame([(t,) for t in (0, 100, 3600, 3700, 9000)], "ts long")
    assert rows(blobs.gc_due(marks)) == [(0,), (3600,), (9000,)]


def test_embedding_cache(spark):
    import numpy as np

    from recallforge.operators import embedders

    calls = spark.sparkContext.accumulator(0)

    def make():
        def model(texts):
            calls.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    embed = embedders.batched(make, 2)
    frame = lambda x: spark.createDataFrame(x, "id long, content string")
    empty = spark.createDataFrame([], embedders.CACHE)
    first = embedders.refresh_cache(frame([(1, "one"), (2, "two words"), (3, "")]), empty, embed).cache()
    assert sorted((r["id"], r["vector"]) for r in first.collect()) == [(1, [3.0, 1.0]), (2, [9.0, 1.0])]
    before = calls.value
    second = embedders.refresh_cache(frame([(1, "one"), (2, "changed")]), first, embed)
    assert sorted((r["id"], r["vector"]) for r in second.collect()) == [(1, [3.0, 1.0]), (2, [7.0, 1.0])]
    assert calls.value - before <= 2  # only what changed
    assert np.allclose(embedders.mean_pool(np.array([[[3.0, 0], [9, 9]], [[1, 1], [1, 1]]]), np.array([[1, 0], [0, 0]])), [[1, 0], [0, 0]])
    known = first.select("content_hash", "vector")
    texts = spark.createDataFrame([(7, "one"), (8, "unknown")], "id long, text string")
    assert [r["id"] for r in embedders.precomputed(known)(texts, ["id"]).collect()] == [7]


def test_ingest_sessions(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "  "), (3, 0, "c")], "session_id long, line_no long, text string")
    meta = spark.createDataFrame([(1, "/w")], "session_id long, cwd string")
    config = spark.createDataFrame([(3, True, True, 2, 0)], "session_id long, pre_compact boolean, session_end boolean, min_turns long, min_bytes long")
    none = spark.createDataFrame([], "session_id long, archived boolean, last_staged_line long")
    outcomes, after = sessions.ingest(turns, meta, none, config, since_checkpoint=True)
    assert rows(outcomes.select("session_id", "outcome")) == [(1, "staged"), (2, "nothing_new"), (3, "below_threshold")]
    assert rows(after) == [(1, False, 1)]
    again, _ = sessions.ingest(turns, meta, after, config, since_checkpoint=True)
    assert rows(again.select("session_id", "outcome"))[0] == (1, "nothing_new")
    _, archived = sessions.ingest(turns, meta, none, config, archive_after=True)
    assert rows(archived) == [(1, True, 0)]


def test_state_round_trip(spark, tmp_path):
    from recallforge.sources import state

    root = f"file://{tmp_path}"
    assert state.load(spark, root, "manifest").count() == 0
    n, e = tables(spark)
    state.save_graph(n, e.unionByName(spark.createDataFrame([("a", "gone", "Uses")], e.schema)), root)
    state.save_graph(n, e.unionByName(spark.createDataFrame([("a", "gone", "Uses")], e.schema)), root)
    nodes, edges = state.load_graph(spark, root)
    assert nodes.count() == 5 and edges.count() == 5
    spoilt = tmp_path / "cache" / "v99999999999999999999-x"
    spoilt.mkdir(parents=True)
    (spoilt / "x.parquet").write_text("spoilt")
    assert state._versions(spark, root, "cache")[-1:] != [f"{root}/cache/{spoilt.name}"]  # not whole: not there
    (spoilt / "_SUCCESS").write_text("")
    assert state.load(spark, root, "cache").count() == 0
    for part in (tmp_path / "graph" / "nodes").glob("v*/*.parquet"):
        part.write_text("spoilt")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        state.load_graph(spark, root)[0].collect()


def test_a_writer_stopped_between_two_tables_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    from recallforge.sources import state

    root = f"file://{tmp_path}"
    n, e = tables(spark)
    state.save_graph(n, e, root)
    old = [rows(x) for x in state.load_graph(spark, root)]

    class Stopped(Exception):
        pass

    class Unwritable:
        def __init__(self, df):
            self.sparkSession = df.sparkSession

        def select(self, *_):
            return self

        @property
        def write(self):
            raise Stopped

    for _ in range(3):
        with pytest.raises(Stopped):
            state.save_graph(n.where("id = 'a'"), Unwritable(e), root)
        assert [rows(x) for x in state.load_graph(spark, root)] == old
    for hub in ("a", "b", "c"):
        state.save_graph(n.where(f"id = '{hub}'"), e.limit(0), root)
        assert [r["id"] for r in state.load_graph(spark, root)[0].collect()] == [hub]
    assert len(list((tmp_path / "graph" / "nodes").glob("v*"))) == 2 and len(state._pointers(spark, root, "graph")) == 2


def test_a_stopped_writer_leaves_the_old_table(spark, tmp_path):
    from recallforge.sources import state

    root = f"file://{tmp_path}"
    for i in range(4):
        state.save(spark.createDataFrame([(f"f{i}", "h")], state.MANIFEST), root, "manifest")
        (tmp_path / "manifest" / f"v{10**19 + i}-half").mkdir()
        assert rows(state.load(spark, root, "manifest")) == [(f"f{i}", "h")]
    assert len(state._versions(spark, root, "manifest")) == 2


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from recallforge.operators import tables as operator_tables

    context = SimpleNamespace(getConf=dict, master="yarn")
    with pytest.raises(ValueError):
        operator_tables.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_staged_jobs_carry_candidates_or_why_not(spark):
    from recallforge.operators import staging

    long = " ".join(f"The deploy key number {i} rotates every ninety days at noon." for i in range(60))
    entries = spark.createDataFrame([(long, "a note", "direct"), ("short text here", "a note", "web"), (long, "a note", "direct"), ("x" * 2001, "blob", "direct")], "content string, description string, source string")
    got = {r["content"][:5]: r for r in staging.stage(entries, 2.0).collect()}
    assert len(got) == 3 and len(got["The d"]["candidates"]) == 60 and "60 candidate concepts" in got["The d"]["prompt"] and "1. The deploy key number 0" in got["The d"]["prompt"]
    assert got["short"]["candidates"] == [] and "candidate" not in got["short"]["prompt"] and "Untrusted source: web" in got["short"]["prompt"]
    assert len(got["xxxxx"]["candidates"]) <= 1 and got["xxxxx"]["split_failure"] is None
    assert len({r["candidates"][0] for r in staging.stage(entries, 0.5).collect() if r["candidates"] and len(r["candidates"]) < 60}) >= 1

    def broken(sentences, threshold):
        raise RuntimeError("no model")

    failed = {r["content"][:5]: r for r in staging.stage(entries, 0.8, broken).collect()}
    assert failed["The d"]["split_failure"] == "no model" and "Splitting failed (no model)" in failed["The d"]["prompt"] and failed["short"]["split_failure"] is None
    assert staging.stage(entries.limit(0)).count() == 0


def test_staged_personas(spark):
    manifests = spark.createDataFrame([("p-1", "b", "who", "web", None, ["a.md", "b.md"])], "slug string, bank string, description string, source_label string, self_build boolean, artifacts array<string>")
    row = store.stage_personas(manifests).first()
    assert (row["job_id"], row["bank_id"], row["kind"], row["sources"], row["source"], row["self_build"]) == ("p-1", "b", "PersonaBuild", ["a.md", "b.md"], "web", False)


def test_curator_jobs_name_both_entries(spark):
    from recallforge.operators import staging

    pairs = spark.createDataFrame([("b", 1, 2, "exact-dup", 100), ("b", 1, 3, "curation", 87)], "bank string, a long, b long, kind string, percent long")
    got = staging.curator_jobs(pairs, lambda i: F.concat(F.lit("e"), i.cast("string"))).orderBy("job_id").collect()
    assert [r["job_id"] for r in got] == ["curation-e1-e3", "exact-dup-e1-e2"] and got[0]["sources"] == ["wiki/e1.md", "wiki/e3.md"]
    assert {r["source"] for r in got} == {"internal"} and "87%" in got[0]["prompt"] and "Untrusted" not in got[0]["prompt"]


def test_the_floor_holds_for_unrounded_scores(spark):
    entries = spark.createDataFrame([(1, [0.2999999996, 1.0]), (2, [0.3000000004, 1.0])], "id long, vector array<double>")
    x = (1 + 0.2999999996**2) ** 0.5
    query = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    assert [r["id"] for r in search.recall(entries, query, floor=0.30000000001 / x).collect()] == [2]


def test_of_several_results_the_first_counts(spark):
    results = spark.createDataFrame([("j", "later", 2), ("j", "first", 1)], "job_id string, result string, n long")
    none = spark.createDataFrame([], "slug string, content string")
    after, _, _ = store.complete(results, none, results.select("job_id"), "n")
    assert rows(after) == [("j", "first")]
    same = spark.createDataFrame([("one", 1), ("one", 2)], "content string, n long")
    assert store.stage_jobs(same, "n").count() == 1


def test_recall_windows_gives_the_matching_part(spark):
    filler = " ".join(["filler"] * 300)
    entries = spark.createDataFrame([(1, f"{filler} the deploy key rotates every ninety days"), (2, filler), (3, "")], "id long, content string")
    asked = spark.createDataFrame([(7, "deploy key rotates"), (8, "nothing alike zzz")], "query_id long, text string")
    got = search.recall_windows(entries, asked, floor=0.01).where("query_id = 7").collect()
    assert (got[0]["rank"], got[0]["id"]) == (1, 1) and got[0]["window_offset"] > 1000 and got[0]["snippet"].startswith("filler")
    assert search.recall_windows(entries, asked.limit(0)).count() == 0
