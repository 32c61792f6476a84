"""Sharding, quality rules, line dedup and URL filters against plain code."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basaltine.llm import quality_rules as Q
from basaltine.llm.line_dedup import LineRuns, dedup_lines, document_keys
from basaltine.llm.sharding import shard, write_shards
from basaltine.llm.url_filter import rules_table, url_filter

SPACE = " \t\n\x0b\f\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 4000])
def test_shards_hold_all_rows_evenly(docs, corpus, bucket_bytes):
    out = shard(docs.withColumn("shard", F.lit("old")), 5, bucket_bytes=bucket_bytes).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in corpus]
    assert {r.doc_id: r.text for r in out} == dict(corpus)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    first = [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.shard))]
    assert first != sorted(first)


def test_shards_of_nothing_and_of_repeated_rows(spark, none, tmp_path):
    assert shard(none, 4).count() == 0
    same = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.create_map(F.lit("a"), F.lit(1)).alias("size_"))
    out = shard(same, 3, bucket_bytes=100)
    assert out.groupBy("shard").count().agg(F.sum("count")).first()[0] == 200
    write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200


def test_sharding_query_like_plain_code(spark, docs, corpus, tmp_path):
    queries = pytest.importorskip("basaltine.llm.queries")
    docs.withColumn("shard", F.lit(1)).unionByName(docs.limit(3).withColumn("shard", F.lit(2))).write.parquet(str(tmp_path / "documents.parquet"))
    want = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    out = queries.QUERIES["op1_sharding"](spark, str(tmp_path)).collect()
    plain = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in want)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == plain
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)} and {r.shard for r in out} == set(range(24))
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(24)}
    assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {len(want) // 24, len(want) // 24 + 1}


def base(t):
    w = words(t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_quality_rules(spark, docs, corpus):
    rows = [(i, 1 if i < 20 else 0) for i, _ in corpus] + [(3, None), (3, 1), (9999, 1), (None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality_rules(docs.withColumn("score", F.lit("x")), labels, threshold=-0.2, buckets=512).collect()}
    assert len(got) == len(corpus)
    marked = docs.select("text", (F.col("doc_id") < 20).alias("t"))
    grams = {r.text: r.g for r in docs.select("text", Q.ngrams(Q.words_of(F.col("text")), 512).alias("g")).collect()}
    raw, good = [1.0] * 512, [1.0] * 512
    for i, t in corpus:
        for g in grams[t]:
            raw[g] += 1
            good[g] += i < 20
    model = [math.log(g / sum(good)) - math.log(r / sum(raw)) for g, r in zip(good, raw)]
    assert max(abs(a - b) for a, b in zip(model, Q.fit(marked, F.col("t"), "text", 512))) < 1e-9
    for i, t in corpus:
        r, g = got[i], grams[t]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), i
        assert len(g) == max(0, 2 * r.n_words - 1)
        score = sum(model[b] for b in g) / len(g) if g else 0.0
        assert abs(score - r.score) < 1e-4
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= -0.2)


def test_quality_rules_without_labels_or_documents(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality_rules(docs, labels).select("score").distinct().collect()} == {0.0}
    assert Q.quality_rules(none, labels).count() == 0


def drop(corpus, least):
    keys = {i: [lower(x.strip(SPACE)) for x in (t or "").split("\n")] for i, t in corpus}
    n = Counter(k for ks in keys.values() for k in set(ks) if k)
    out = {}
    for i, t in corpus:
        kept = [x for x, k in zip((t or "").split("\n"), keys[i]) if n[k] < least]
        out[i] = (len(keys[i]), len(keys[i]) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, corpus, batches):
    clash = docs.withColumns({"ta_": F.lit(1), "n_lines": F.lit("x"), "kill_": F.lit(2)})
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(clash, min_docs=10, batches=batches).collect()}
    assert got == drop(corpus, 10)
    assert sum(n for _, n, _ in got.values()) >= 28


def test_runs_are_merged_and_saturated_keys_are_left_out(spark, docs):
    runs = LineRuns(spark, 3, fanout=2)
    keys = document_keys(docs, "text", 1)
    for _ in range(5):
        runs.add(keys)
    assert sum(map(len, runs.levels)) <= 3 and len(runs.levels) >= 2
    assert runs.counts().count() == keys.distinct().count()
    n = {(r.a, r.b): r["count"] for r in keys.groupBy("a", "b").count().collect()}
    assert all(r.n >= min(3, 5 * n[r.a, r.b]) and r.n <= 5 * n[r.a, r.b] for r in runs.counts().collect())
    assert runs.saturated().count() == keys.distinct().count()


def test_runs_do_not_move_when_they_are_merged(spark, docs):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = LineRuns(spark, 3, fanout=9)
        keys = document_keys(docs, "text", 1)
        runs.add(keys)
        runs.add(keys)
        plan = runs.merged(keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2, plan
        plan = runs.counts()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        runs.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_line_dedup_of_very_long_texts(spark):
    lines = [f"line {k}" for k in range(60_000)]
    rows = [(k, "\n".join(lines)) for k in range(10)] + [(10, "\n".join(["kept", *lines, "", "kept too", "line 3"]))]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: (60_000, 60_000, "") for k in range(10)}, 10: (60_004, 60_001, "kept\n\nkept too")}


def test_line_dedup_of_nothing_and_of_nulls(spark, none):
    assert dedup_lines(none).count() == 0
    same = spark.range(12).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a\n\nb").alias("text"))
    assert {(r.n_lines, r.n_dropped, r.text) for r in dedup_lines(same).collect()} == {(3, 2, "")}


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "net", "/de/"), ("block", "org", "")]
URLS = [
    "http://A.Example.COM/en/7?x#y", "http://example.com/en/8", "https://notexample.com/en/7", "http://x.net/de/9", "org", "http://a.org", "ftp://b.org#/en/",
    "http://" + "a." * 4000 + "com/en/", "http://a.com/en/" + "x/" * 20000, "http://com/en/", "http://xcom/en/", "", None, "://", "http://", "x://h://com/en/", "http://www.example.com/EN/7", "http://b.org/é?", "http://ÀB.org/", "http://a.com/en/\n7",
]


def judged(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = lower(m[1]), m[2]
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter(spark):
    rows = list(enumerate(URLS + URLS))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "short": F.lit(2), "u": F.lit(3), "u_": F.lit(4), "R_": F.lit(5)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, rules_table(spark, RULES)).collect()}
    assert got == {i: judged(u) for i, u in rows}
    assert url_filter(pages.limit(0), rules_table(spark, RULES)).count() == 0


def test_hashes_of_kept_text(docs, corpus):
    got = {r.doc_id: r.h for r in dedup_lines(docs).select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    assert got == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in drop(corpus, 10).items()}
