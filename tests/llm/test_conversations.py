"""Conversation repair against all edits of short conversations and a plain search for longer ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from recallforge.llm import conversations as c
from recallforge.llm.queries import queries

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def best(rows):
    """(cost, audit, repaired rows) of rows (initial, role, text, must go, truncated), by plain search."""

    @lru_cache(None)
    def rest(i, q, inserted):
        found = []
        if i == len(rows) and q in (0, 3):
            found.append((0, "", ()))
        if inserted < 2:
            to = 3 if q == 2 else 2
            cost, audit, out = rest(i, to, inserted + 1)
            found.append((cost + 5, "I" + audit, (("assistant" if q == 2 else "user", ""), *out)))
        if i < len(rows):
            initial, role, text, gone, cut = rows[i]
            cost, audit, out = rest(i + 1, q, 0)
            found.append((cost + 2, "D" + audit, out))
            if not gone:
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                if to is not None:
                    cost, audit, out = rest(i + 1, to, 0)
                    found.append((cost + 5 * cut, "K" + audit, ((role, text), *out)))
                to = 3 if q == 2 else 2
                cost, audit, out = rest(i + 1, to, 0)
                found.append((cost + 1 + 5 * cut, "R" + audit, (("assistant" if q == 2 else "user", text), *out)))
        return min(found, default=(1 << 30, "", ()))

    return rest(0, 0, 0)


def all_edits(rows):
    """The least (cost, audit) over every edit of every row and up to two inserts in every gap."""
    gaps = [("", 0, ""), *((x, 5 * len(x), "I" * len(x)) for x in ("u", "a", "ua", "au", "uu", "aa"))]
    choices = []
    for initial, _, _, gone, cut in rows:
        own = [("", 2, "D")]
        if not gone:
            own += [(initial or "?", 5 * cut, "K"), ("u", 1 + 5 * cut, "R"), ("a", 1 + 5 * cut, "R")]
        choices.append(own)
    found = []
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            steps = [inserts[0], *(x for e, g in zip(edits, inserts[1:]) for x in (e, g))]
            if LEGAL.fullmatch("".join(s[0] for s in steps)):
                found.append((sum(s[1] for s in steps), "".join(s[2] for s in steps)))
    return min(found)


def row(r):
    initial = r.choice(["s", "u", "a", "u", "a", "t", ""])
    return (initial, initial, "x", r.random() < 0.2, r.random() < 0.3)


def codes(rows):
    return bytes(c._code(i, gone, cut) for i, _, _, gone, cut in rows)


def test_all_edits_of_short_conversations():
    r = random.Random(1)
    for n in (1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2):
        rows = [row(r) for _ in range(n)]
        assert c.repair_codes(codes(rows)) == all_edits(rows) == best(rows)[:2]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_longer_conversations_by_plain_search(block, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", block)
    c.repair_codes.cache_clear()
    r = random.Random(2)
    for _ in range(300):
        rows = [row(r) for _ in range(r.randint(1, 40))]
        assert c.repair_codes(codes(rows)) == best(rows)[:2]


def damaged(rows):
    """The damage of the query, by its definition; rows (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    return out


def expected(rows, of):
    out = {}
    for conv in {x[0] for x in of}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), hashlib.sha256(x[3].encode()).hexdigest()))
        turns, seen, faults, ready = {x[1] for x in own} - {None}, set(), [], []
        for _, _, role, text in own:
            core = text.rstrip(c.SPACES)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            ready.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, repaired = best(tuple(ready))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(ready, ready[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def results(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[x] for x in (*c.STATS, "audit", "repaired_sha256")) for r in rows}


def test_query_against_plain_search(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(queries()["op11_conversation_repair"](spark, SF))
    assert got == expected(damaged(given), given)
    assert all(any(x[i] for x in got.values()) for i in range(6))


def odd_rows():
    r = random.Random(5)
    texts = ["Fine.", "Yes!", "no end", "", " \t\n", "Why?  ", "a.b", None, "x" * 20_000 + ".", ".", " "]
    rows = [(conv, r.choice([None, 0, 1, 2, 3, 5, 9, -4]), r.choice(["system", "user", "assistant", "tool", "", None, "user"]), r.choice(texts)) for conv in (None, 0, 1, 2, 3, 4) for _ in range(25)]
    return rows + [(7, None, "user", "Hi."), (8, None, None, None)] + [(9, i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(120)]


@pytest.mark.parametrize("long_rows", [0, 60, 20_000])
def test_nulls_ties_and_long_conversations(spark, long_rows, monkeypatch):
    monkeypatch.setattr(c, "PIECE", 7)
    monkeypatch.setattr(c, "BLOCK", 3)
    rows = odd_rows()
    given = spark.createDataFrame(rows, ROWS).withColumns({"kind": F.lit(1), "digest": F.lit("x"), "piece": F.lit(0)})
    got = results(c.repair_digests(c.damage(given), given.select("conv_id"), long_rows, 20))
    assert got == expected(damaged(rows), rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = [x for x in odd_rows() if x[0] in (1, 2, 9)]
    given = spark.createDataFrame(rows, ROWS)
    found = c.audits(given)
    turns = c.repaired_turns(given, found).collect()
    for audit in found.collect():
        own = sorted((t for t in turns if t["conv_id"] == audit["conv_id"]), key=lambda t: t["place"])
        assert [t["place"] for t in own] == list(range(len(own)))
        assert LEGAL.fullmatch("".join(t["role"][:1] for t in own))
        assert "".join(t["edit"] for t in own) == audit["audit"].replace("D", "")


def test_empty_table(spark):
    given = spark.createDataFrame([], ROWS)
    assert c.repair_digests(c.damage(given), given.select("conv_id")).collect() == []


def test_a_conversation_that_lost_all_rows(spark):
    none = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(none, 0, "user", "Hi.")], ROWS)
    assert results(c.repair_digests(c.damage(given), given.select("conv_id"))) == {none: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_sql_says_the_same_of_nulls_and_ties():
    import duckdb
    import pandas as pd

    from recallforge.llm.sql import OP11_SQL

    rows = odd_rows()
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT * FROM given")
    got = con.execute(f"SELECT conv_id, {', '.join(c.STATS)}, audit, repaired_sha256 FROM ({OP11_SQL})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == expected(damaged(rows), rows)
