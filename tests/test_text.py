"""Text columns against plain models of the same rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallforge.functions import hashing, text

words = st.lists(st.sampled_from(["a", "bb", "été", "x.", "ok!", "q?", "z"]), max_size=260)
gaps = st.sampled_from([" ", "\n", "  ", "\t", " \n"])


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def windows(content, size=80, overlap=20):
    data = content.encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\f\r]+", data)]
    if not spans:
        return []
    if len(spans) <= size:
        return [(0, len(data), content)]
    out, start = [], 0
    while True:
        end = min(start + size, len(spans))
        stop = len(data) if end == len(spans) else spans[end][0]
        body = data[spans[start][0] : stop].decode().rstrip()
        out.append((spans[start][0], spans[start][0] + len(body.encode()), body))
        if end == len(spans):
            return out
        start += size - overlap


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(words, gaps, st.booleans()), min_size=1, max_size=12))
def test_windows(spark, cases):
    texts = [("  " if lead else "") + gap.join(w) for w, gap, lead in cases] + ["", "   ", "one two three four five"]
    got = column(spark, texts, text.windows)
    assert [[tuple(w) for w in ws] for ws in got] == [windows(t) for t in texts]


def test_small_windows(spark):
    content = "a b c d e f g h"
    got = column(spark, [content], lambda c: text.windows(c, 3, 1))[0]
    assert [w["text"] for w in got] == ["a b c", "c d e", "e f g", "g h"]
    assert [w["offset"] for w in got] == [0, 4, 8, 12]


def sentences(content):
    parts = [p.strip() for p in re.findall(r"[^.!?]*[.!?]|[^.!?]+", content)]
    return [p for p in parts if 8 <= len(p.split()) <= 40]


@settings(max_examples=5, deadline=None)
@given(st.lists(words, min_size=1, max_size=10))
def test_sentences_and_distinct(spark, cases):
    texts = [" ".join(w) for w in cases]
    got = column(spark, texts, text.sentences)
    assert got == [sentences(t) for t in texts]
    firsts = []
    for t in texts:
        seen = {}
        for s in sentences(t):
            key = "".join(c for c in s.lower() if c.isalnum() or c.isspace()).strip()
            if key:
                seen.setdefault(key, s)
        firsts.append(list(seen.values()))
    assert column(spark, texts, lambda c: text.distinct_sentences(text.sentences(c))) == firsts


def test_slugs(spark):
    got = column(spark, ["Hello, World! Foo", "!!!", "", "Été Ça", "x" * 60, None], text.slugify)
    assert [g and g[:-7] for g in got] == ["hello-world-foo", "memory", "memory", "Été-Ça", "x" * 40, None]
    assert got[1] != got[2]


def test_summaries(spark):
    long = "word " * 20
    assert column(spark, ["a  b\n c", long, None], text.summarize) == ["a b c", long[:60] + "…", None]
    assert column(spark, ["x" * 121], text.snippet) == ["x" * 120 + "…"]


def test_frontmatter(spark):
    cases = ["---\na: 1\n---\n\nbody", "---\n---\nbody", "no\n---\n---\n", "---\nopen"]
    assert column(spark, cases, text.strip_frontmatter) == ["body", "---\n---\nbody", "no\n---\n---\n", "---\nopen"]


def test_remotes(spark):
    cases = ["git@host:owner/repo.git", "https://host/owner/repo", "https://host/owner/repo.git/", "repo"]
    assert column(spark, cases, text.remote_slug) == ["owner-repo", "owner-repo", "owner-repo.git", "repo"]


def test_handles(spark):
    good = column(spark, ["x"], hashing.blob_handle)[0]
    cases = [good, good.upper(), good[:-1], good + "0", "zzz_" + good[4:], None]
    assert column(spark, cases, hashing.is_handle) == [True] + [False] * 5
