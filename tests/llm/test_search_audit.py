"""Fill-in-middle, exact top-k and the divergence audit against plain code."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basaltine.llm import divergence as D
from basaltine.llm.fill_in_middle import Checkpoints, fill_in_middle, restored
from basaltine.llm.topk import Blocks, exact_type, similar_order, tiles, top_k


def cut(doc_id, text, rate, spm, seed):
    t = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("step,piece", [(1, 1), (3, 7), (64, 1 << 20)])
def test_checkpoints_know_every_border(step, piece):
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 300):
        text = "".join(rng.choice(["\n", "é", "a", "漢", "😀", "\n\n", "word "]) for _ in range(n))
        index = Checkpoints(text.encode(), step, piece)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert (index.n, index.chars) == (len(lines), len(text))
        assert len(index.units) == 1 + text.count("\n") // step
        for u in range(len(lines) + 2):
            before = "".join(lines[:u])
            assert index.cut(u) == (len(before.encode()), len(before))


@pytest.mark.parametrize("rate,spm,step", [(100, 50, 64), (60, 30, 1), (0, 0, 64)])
def test_fill_in_middle_like_plain_code(spark, docs, corpus, rate, spm, step):
    more = [(i, t) for i, t in enumerate(["a\n<P>b\n", "<", "<P", "\n\n\n", "ü\n漢字\n😀", "x<\n<S\n>S>\n<", "line\n" * 40000, "no border " * 30000], 1000)] + [(None, "a\nb\nc\nd"), (7, "q\nr")] * 2
    rows = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs).withColumns({"N": F.lit("old"), "body_": F.lit(1), "m": F.create_map(F.lit(1), F.lit(2))})
    out = fill_in_middle(rows, rate=rate, spm_rate=spm, step=step)
    assert out.columns == ["doc_id", "text", "body_", "m", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(more) + len(corpus)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(r.doc_id, r.text, rate, spm, 7), r.doc_id
        assert r.again == (r.text or "")
    if rate == 100:
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_other_sentinels(spark, none, docs):
    assert fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(none, sentinels=("aba", "<S>", "<M>"))
    marks = ("[PRE](1)", "\\Esuf", "|")
    out = fill_in_middle(docs, sentinels=marks).withColumn("again", restored(F.col("output"), F.col("form"), marks))
    assert all(r.again == (r.text or "") for r in out.collect())


def brute(rows, asks, k, scale=256):
    """{(query_id, vector): [(score, vec_id)]} over rows whose vectors are lists of finite numbers."""
    whole = {(i, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for i, q in whole:
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if (j, x) != (i, q))[:k]
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(found))
    return out


def found(df):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("tile_bytes", [1 << 20, 900])
def test_top_k_like_brute_force(spark, tile_bytes):
    rng = np.random.default_rng(5)
    near = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (near[i % 6] + 0.05 * rng.normal(size=8)).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[4][1]) for i in range(300, 380)] + [rows[0], rows[0], (0, rows[1][1])]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (None, rows[2][1]), (600, []), (650, [1.0, -2.0]), (700, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"ID": F.lit(1), "v": F.lit("x"), "asks": F.lit(0)}).repartition(5)
    got = found(top_k(df, F.col("vec_id") % 25 == 0, k=5, block=8, tile_bytes=tile_bytes))
    assert got == brute(rows, lambda i: i % 25 == 0, 5)
    assert all(n == 1 for n in got.values()) and len({q for q, *_ in got}) == 19


def test_top_k_of_few_rows_and_of_large_numbers(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, F.lit(True)).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], none.schema), F.lit(True)).count() == 0
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[3e12, 1.0], [-2e11, 5.0], [7.0, 3e9], [3e12, 1.0]])]
    got = found(top_k(spark.createDataFrame(rows, none.schema), F.lit(True), k=2))
    most = (1 << 63) - 1
    want = Counter((q, n, i, max(-most - 1, min(most, s))) for q, n, i, s in brute(rows, lambda i: True, 2))
    assert got == want


def test_blocks_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    near = rng.normal(size=(40, 16)) * 100
    x = np.floor(near[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 3)
    order = similar_order(x, 64)
    assert sorted(order) == list(range(6000))
    blocks = Blocks(x.astype(np.float32), np.arange(6000), np.zeros(6000, np.int64), 64)
    q = x[:50].astype(np.float32)
    assert exact_type(q, x) is np.float32 and exact_type(q * 1e4, x) is np.float64 and exact_type(q * 1e9, x * 1e9) is object
    assert ((q @ blocks.x.T).reshape(50, -1)[:, blocks.starts] <= blocks.bounds(q)).all()
    who, ids, _, scores = blocks.search(q, (np.arange(50), np.zeros(50, np.int64)), 5)
    s = q @ x.T.astype(np.float32)
    s[np.arange(50), np.arange(50)] = -np.inf
    want = [sorted(zip(-row, range(6000)))[:5] for row in s]
    assert [(int(w), int(i), float(v)) for w, i, v in zip(who, ids, scores)] == [(w, i, -v) for w, r in enumerate(want) for v, i in r]
    assert blocks.scored < 0.25 * blocks.could


def test_tiles_hold_their_bound():
    for rows, queries in ((0, 0), (10, 10), (10 << 30, 200 << 20), (3 << 40, 60 << 30)):
        a, b = tiles(rows, queries, 200)
        assert rows / a <= 32 << 20 and queries / b <= 32 << 20
    assert tiles(300 << 10, 1, 200) == (1, 1) and tiles(64 << 20, 1, 8) == (8, 1)


def audit(rows, least, top, pseudo, scale):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(g or "", s or "", term.findall((t or "").translate(lower))) for t, g, s in rows]
    out = Counter()
    for lang in {g for g, _, _ in docs}:
        mine = [(s, w) for g, s, w in docs if g == lang]
        df, whole = Counter(t for _, w in mine for t in set(w)), Counter(t for _, w in mine for t in w)
        kept = [t for t in df if df[t] >= least]
        share = lambda n: {t: 1 + scale * (n[t] + pseudo) // (sum(n[u] for u in kept) + pseudo * len(kept)) for t in kept}
        counts = {s: Counter(t for x, w in mine if x == s for t in w) for s, _ in mine}
        p, q = {s: share(n) for s, n in counts.items()}, share(whole)
        for s in p:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            high = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(high)[:top])):
                out.update((lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found))
    return out


@pytest.mark.parametrize("scale", [10**9, 10**15])
def test_divergence_like_plain_code(spark, monkeypatch, scale):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("w", "É", "漢", "Wort") for b in "abcdefghijklmnopqrst"]
    rows = [(" ".join(rng.choices(vocabulary, range(1, 81), k=rng.randrange(60))) + rng.choice(["", "1,2x", "\tÀ"]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "é", "z", None, ""])) for _ in range(400)]
    rows += [("", "en", "bare"), (None, "en", "void"), ("only once", "xx", "a"), ("other", "xx", "b"), ("1 2 3", "yy", "a"), ("Wa " * 30000, "de", "long")] + [rows[0]] * 5
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "N": F.lit("x"), "docs": F.lit(None).cast("int")}).repartition(6)
    for least, top in ((30, 50), (3, 4)):
        got = Counter(tuple(r) for r in D.divergence(df, min_docs=least, top=top, scale=scale).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == audit(rows, least, top, 5, scale)
        assert ("xx", "a", "pair", "b", 0, 1) in got


def test_counts_are_passed_on_when_they_are_many(monkeypatch):
    monkeypatch.setattr(D, "HELD", 10)
    texts, size = [f"a b{'x' * k} c{'y' * k}" for k in range(1, 21)], 4
    made = [pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts[i : i + size]]), pa.array(["l"] * size), pa.array(["s"] * size)], names=["text", "lang", "source"]) for i in range(0, 20, size)]
    out = list(D._count(iter(made)))
    assert len(out) > 3
    n = Counter()
    for b in out:
        n.update({r["term"]: r["docs"] for r in b.to_pylist()})
    assert n["a"] == 20 and n[None] == 20 and n["bxx"] == 1 and len(n) == 42


def test_divergence_of_nothing_and_terms_cut_in_pieces(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    text = "Ab c_d é漢 x1y " * 50
    assert [w for p in D.pieces(text.encode(), 10) for w in p] == [w.encode() for w in ["ab", "c", "d", "é漢", "x", "y"]] * 50
