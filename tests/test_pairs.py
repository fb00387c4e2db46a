"""Pair joins and greedy leaders against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from recallforge.operators import clusters, pairs

SPARSE = "bank string, id long, buckets array<int>, weights array<double>"


def sparse_rows(r, n, width, size, bank="b", base=0):
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            _, _, b, w = r.choice(out)
            new = dict(zip(b, w))
            for _ in range(r.randint(0, 2)):
                new[r.randrange(width)] = float(r.randint(1, 4))
        else:
            new = {b: float(r.randint(1, 4)) for b in r.sample(range(width), size)}
        out.append((bank, base + i, list(new), list(new.values())))
    return out


def brute(rows, threshold):
    vectors = [(bank, i, dict(zip(b, w))) for bank, i, b, w in rows]
    found = {}
    for bank, i, x in vectors:
        for other, j, y in vectors:
            if bank == other and i < j and any(x.values()) and any(y.values()):
                s = sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
                if round(s, 12) >= threshold:
                    found[bank, i, j] = round(s, 6)
    return found


@pytest.mark.parametrize("block", [5, 2048])
def test_sparse_pairs_equal_all_pairs(spark, block):
    r = random.Random(8)
    rows = sparse_rows(r, 90, 400, 8) + sparse_rows(r, 60, 6, 4, "narrow", 1000) + [("b", 500, [], []), ("b", 501, [3], [0.0])]
    join = pairs.SparseJoin(spark.createDataFrame(rows, SPARSE), 0.8, block)
    got = [(x["bank"], x["a"], x["b"], round(x["score"], 6)) for x in join.pairs().collect()]
    assert len({g[:3] for g in got}) == len(got)
    assert {g[:3]: g[3] for g in got} == brute(rows, 0.8)
    ways = {x["bank"]: x["candidates"] < x["pairs"] for x in join.costs.collect()}
    assert ways == {"b": True, "narrow": False}


def test_unlike_texts_are_hardly_compared(spark):
    """Compared pairs grow with the rows, not with their square, where texts share nothing but a common word."""
    compared = []
    for n in (200, 400, 800):
        rows = [("b", i, [0, *range(1 + 5 * i, 6 + 5 * i)], [1.0] + [2.0] * 5) for i in range(n)] + [("b", n + i, [0, *range(1 + 5 * i, 6 + 5 * i)], [1.0] + [2.0] * 4 + [2.1]) for i in range(n // 10)]
        join = pairs.SparseJoin(spark.createDataFrame(rows, SPARSE), 0.8)
        assert join.pairs().count() == n // 10
        compared.append(join.costs.first()["compared"])
    assert compared[2] <= 2.2 * compared[1] <= 4.8 * compared[0]


def test_a_threshold_of_nothing_is_refused(spark):
    with pytest.raises(ValueError):
        pairs.SparseJoin(spark.createDataFrame([], SPARSE), 0.0)


def test_floors_hold_for_scores_as_they_are(spark):
    y = [0.7999999996, float(np.sqrt(1 - 0.7999999996**2))]
    entries = spark.createDataFrame([("b", 1, [1.0, 0.0]), ("b", 2, y)], "bank string, id long, vector array<double>")
    assert pairs.similar_pairs(entries, 0.8).count() == 0
    assert pairs.similar_pairs(entries, 0.7999999995).count() == 1


def test_contained_texts_of_any_length(spark):
    r = random.Random(6)
    alphabet = ["a", "bc", "d e", "é", "🙂", "the fox", "x\ny"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(120)] + ["a", "🙂", "é🙂", "the", " the ", "", "  ", "fox the fox", "b", "\n"]
    texts += ["one two three four", "two three", "xone two three fourx", "one two three four"]
    rows = [(f"b{i % 2}", i, t) for i, t in enumerate(texts)]
    clean = {i: (b, t.strip()) for b, i, t in rows}
    want = {(b, i, j) for i, (b, t) in clean.items() for j, (c, u) in clean.items() if i < j and b == c and t and u and (t in u or u in t)}
    got = [tuple(x) for x in pairs.contained_pairs(spark.createDataFrame(rows, "bank string, id long, content string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_short_texts_do_not_meet_a_whole_bank(spark, monkeypatch):
    """Texts of one or two words meet the words that hold theirs, not every text or word of the bank."""
    met = []
    monkeypatch.setattr(pairs, "_words_around", (lambda f: lambda *a: met.append(x := f(*a)) or x)(pairs._words_around))
    rows = [("b", i, f"long text number {i * 7919} that goes on for a while") for i in range(400)] + [("b", 1000 + i, f"{i * 7919} that") for i in range(300)]
    assert pairs.contained_pairs(spark.createDataFrame(rows, "bank string, id long, content string")).count() >= 300
    assert met[0].count() < 1000 < 300 * 400


def greedy(rows, threshold):
    kept = []
    for i, v in sorted(rows):
        if all(round(float(np.dot(v, k) / ((np.linalg.norm(v) * np.linalg.norm(k)) or 1)), 12) < threshold for _, k in kept):
            kept.append((i, v))
    return [i for i, _ in kept]


@pytest.mark.parametrize("block", [7, 4096])
def test_leaders_equal_the_sequential_rule(spark, block):
    rng = np.random.default_rng(2)
    groups = {"one": rng.normal(size=(120, 3)), "two": rng.normal(size=(5, 3)), "zero": np.zeros((30, 2)), "same": np.ones((40, 3))}
    rows = [(d, i, [float(x) for x in v]) for d, x in groups.items() for i, v in enumerate(x)]
    got = clusters.concept_clusters(spark.createDataFrame(rows, "doc string, id long, vector array<double>").repartition(5), 0.7, block).collect()
    for d, x in groups.items():
        assert sorted(r["id"] for r in got if r["doc"] == d) == greedy(list(enumerate(x)), 0.7)


def test_leaders_of_one_large_group(spark):
    """100,000 vectors of one group against the same rule on one array."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16))
    x = np.round(centres[rng.integers(0, 300, 100_000)] + rng.normal(size=(100_000, 16)) * 0.15, 3)
    want = clusters.greedy_leaders(x, 0.8)
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * 16)
    rows = spark.createDataFrame(pa.table({"doc": np.zeros(len(x), np.int64), "id": np.arange(len(x)), "vector": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))})).repartition(8)
    got = clusters.concept_clusters(rows, 0.8, block=4096).collect()
    assert sorted(r["id"] for r in got) == want.tolist()
