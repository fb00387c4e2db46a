"""Sentences in one pass of one expression."""

import random
import re

from pyspark.sql import functions as F

from recallforge.functions import text


def test_sentences_of_every_length_and_ending(spark):
    r = random.Random(3)
    gaps, ends = [" ", "\n", "\x0b", " 　", "\xa0", "\x85 ", " "], [".", "!", "?", " .", " !", "..", " ", "", ". ", "　?\n", "\x1c."]
    texts = ["", " ", ".", " . ! "]
    for _ in range(600):
        parts = []
        for _ in range(r.randint(1, 3)):
            n = r.choice([0, 1, 6, 7, 8, 9, 38, 39, 40, 41, 42, 90])
            parts.append(r.choice(["", " ", "\xa0"]) + "".join(r.choice(["a", "été", "x-1", "🙂", "​z"]) + r.choice(gaps) * (i < n - 1) for i in range(n)) + r.choice(ends))
        texts.append("".join(parts))
    space = "[" + re.escape(text.SPACES) + "]"
    want = []
    for t in texts:
        cut = [s.strip(text.SPACES) for s in re.findall(r"[^.!?]*[.!?]|[^.!?]+", t)]
        want.append([s for s in cut if 8 <= len([w for w in re.split(f"{space}+", s) if w]) <= 40])
    rows = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, t string").orderBy("i")
    got = [x[0] for x in rows.select(text.sentences(F.col("t"))).collect()]
    assert got == [*want, None]
    assert sum(map(len, want)) > 300


def test_sentences_take_one_regular_expression(spark):
    plan = spark.createDataFrame([("a",)], "t string").repartition(1).select(text.sentences(F.col("t")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("regexp", plan)) == 1 and "trim(" not in plan
