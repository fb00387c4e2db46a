"""Different texts with one job id: the job is the first document's, as in the query's SQL."""

import hashlib

import duckdb

import __spark_entry__


def colliding():
    seen = {}
    for n in range(10**6):
        t = "x" * 40 + str(n)
        other = seen.setdefault(hashlib.sha256(t.encode()).hexdigest()[:6], t)
        if other != t and len(other) != len(t):
            return other, t


def test_the_first_of_different_texts_with_one_id_is_the_job(spark, tmp_path):
    short, long = sorted(colliding(), key=len)
    rows = [(3, short if short > long else long), (1, min(short, long)), (2, "another text")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", sorted(rows))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["stage_jobs"]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()["stage_jobs"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 2
