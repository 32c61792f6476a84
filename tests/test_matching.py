"""Containment joins and matches with their places, against plain code."""

import random
import re

from pyspark.sql import functions as F

from basaltine.operators import matches, substrings


def test_containment_loses_no_needle(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé漢") for _ in range(n))
    texts = [(k, word(rng.randrange(40))) for k in range(120)] + [(200, None), (201, ""), (202, "ab"), (203, "ab")]
    needles = [(k, word(rng.choice([0, 1, 2, 3, 4, 5, 9]))) for k in range(90)] + [(200, None), (201, "aaaaaaaaaaaaaaaaaaaaaaaaaaa"), (202, "ab"), (203, "ab")]
    n, t = spark.createDataFrame(needles, "i int, needle string"), spark.createDataFrame(texts, "j int, text string")
    want = sorted((i, j) for i, x in needles for j, y in texts if x and y is not None and x in y)
    for q in (1, 3, 4):
        got = sorted((r.i, r.j) for r in substrings.contained(n.withColumnRenamed("needle", "what"), t, "what", "text", q).collect())
        assert got == want
    assert substrings.contained(n.where("false").withColumnRenamed("needle", "what"), t, "what", "text").count() == 0


def test_matches_are_those_of_a_search_from_the_left(spark):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice(["a", "b", "é", "\n", "aa\nb", "😀", " "]) for _ in range(rng.randrange(80)))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "ab\n" * 3000), (102, "ab\n" * 3000), (103, "b" * 60000)]
    patterns = {"one": "a+", "two": "a(b|\\n)(é|b)?", "three": "(?i)B\\s+A", "far": "a.*?é"}
    df = spark.createDataFrame(texts, "id int, text string").withColumn("row", F.lit(1)).repartition(3)
    got = sorted((r.id, r.pattern, r.n, r.start, r.end, r.line, r.end_line, r.match) for r in matches.all_matches(df, "text", patterns).collect())
    want = []
    for i, t in texts:
        for name, p in patterns.items():
            for n, m in enumerate(re.finditer(p, t or ""), 1):
                line = lambda at: t.count("\n", 0, at) + 1
                want.append((i, name, n, m.start(), m.end(), line(m.start()), line(m.end()), m.group()))
    assert got == sorted(want)
