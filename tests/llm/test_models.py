"""Near-duplicates, decontamination, tokenisation and the classifiers against plain code."""

import hashlib
import math
import random
import re
import struct
import sys
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltine.llm import bpe, components, decontaminate, importance, language, minhash, texthash, toxicity

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_word_hashes():
    texts = [b"a b\tc  dd\n", b"", b"x", b" a dd ", b"y" * 3_000_000 + b" z", b"q " * 700_000]
    h, at = texthash.word_hashes_of(texts)
    for k, t in enumerate(texts):
        assert list(np.diff(at))[k] == len(t.split())
        assert np.array_equal(h[at[k] : at[k + 1]], texthash.word_hashes(t))
    assert texthash.word_hashes(b"x y x")[0] == texthash.word_hashes(b"x y x")[2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, part in ((2000, 0.5), (40, 0.75), (300, 0.9)):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * part)], rng.integers(0, 1 << 63, 10).astype(np.uint64)]))
        s = minhash.signatures([a, b, a[:1], np.empty(0, np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.15
        assert (s[3] == ~np.uint64(0)).all() and len(set(s[2].tolist())) == 128


def reachable(corpus):
    sets = {i: shingles(t) for i, t in corpus}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == reachable(corpus)
    kept = {r.doc_id for r in minhash.deduplicated(docs.withColumns({"hash_": F.lit(1), "k_": F.lit(2)})).collect()}
    assert kept == {i for i, x in got.items() if x[2]}


def test_chain_whose_ends_are_not_alike(spark):
    w = [f"v{k}" for k in range(100)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 60])) for k in range(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == reachable(rows) and {x[1] for x in got.values()} == {0}


def test_large_group_of_near_copies_with_outliers(spark):
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(90)], []
    for k in range(1500):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 1, 2, 2, 3))):
            w[rng.randrange(90)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    at = {g: i for i, g in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for k, x in enumerate(sets):
        m[k, [at[g] for g in x]] = 1
    common, n = m @ m.T, m.sum(1)
    uf = components.UnionFind()
    for a, b in zip(*np.nonzero(100 * common >= 75 * (n[:, None] + n[None, :] - common))):
        uf.union(int(a), int(b))
    want = {k: uf.find(k) for k in range(len(rows))}
    assert 100 < sum(r == k for k, r in want.items()) < 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_tiles_count_like_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    for wide in (7, 1000):
        minhash.WIDE, kept = wide, minhash.WIDE
        got = minhash.shared_counts(sets[:11], sets[11:])
        minhash.WIDE = kept
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[11:]] for a in sets[:11]]


def test_near_duplicates_of_nothing_and_of_nulls(spark, none):
    assert minhash.near_duplicates(none).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (5, "A b c"), (5, "A b c"), (7, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(None, 5): 2, (5, 5): 2, (7, 7): 1}


def test_components_like_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    uf = components.UnionFind()
    for a, b in links:
        uf.union(a, b)
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    for chunk in (7, 1000):
        got = {r.node: r.root for r in components.components(df, chunk).collect()}
        assert got == {x: uf.find(x) for ab in links if ab[0] != ab[1] for x in ab}
    path = spark.range(100).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(7)
    assert {r.root for r in components.components(path, 20).collect()} == {0}
    assert components.components(path.limit(0)).count() == 0


def planted(corpus):
    rng = random.Random(4)
    items = [(k, " ".join(f"b{rng.randrange(500)}" for _ in range(n))) for k, n in enumerate((12, 25, 33, 40, 57, 3, 2, 1))] + [(50, None), (51, " "), (52, None)]
    docs = [(i, t) for i, t in corpus]
    for k, (i, t) in enumerate(items[:5]):
        w = t.split()
        docs.append((1000 + k, f"lead in {t.upper()} and out"))
        docs.append((1100 + k, " ".join(w[:-1] + ["other"] if len(w) > 20 else w)))
        docs.append((1200 + k, "pre " + " ".join(w[: len(w) // 2]) + " post and more words that follow here"))
    docs.append((1300, "b" * 10 + " x " + items[5][1] + " y"))
    return items, docs


def test_decontamination_like_brute_force(spark, corpus):
    items, rows = planted(corpus)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(docs, bench).collect()}
    index = decontaminate.Items(items)
    want = {}
    for i, t in rows:
        words = texthash.word_hashes((t or "").encode().lower())
        for k, n in enumerate(index.lengths):
            s = texthash.shingle_hashes(words, min(n, 5))
            size = max(1, n - 4)
            best = max((index.similarity(s[p : p + size], k) for p in range(len(s))), default=0.0)
            if best >= 0.75:
                want[i, index.ids[k]] = round(best, 9)
    assert got == want and (1300, 5) in got
    assert {(1000 + k, k) for k in range(5)} <= set(got) and not any(1200 <= d < 1300 for d, _ in got)
    left = decontaminate.decontaminated(docs.withColumn("hash_", F.lit(1)), bench)
    assert left.columns == ["doc_id", "text", "hash_"] and left.count() == len(rows) - len({d for d, _ in got})


def test_hamming_search_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"t{x}" for x in rng.integers(0, 999, 30))) for k in range(20)]
    index = decontaminate.Items(items)
    n = decontaminate.grid_length(30)
    members, marks, _ = index.classes[n]
    prints = []
    for _ in range(2000):
        flips = rng.choice(64, rng.integers(0, 25), replace=False)
        prints.append(int(marks[rng.integers(len(marks))]) ^ sum(1 << int(b) for b in flips))
    prints = np.array(prints, np.uint64)
    found = set(zip(*(x.tolist() for x in index.near(prints, n))))
    want = {(w, int(members[k])) for w in range(len(prints)) for k in range(len(marks)) if bin(int(prints[w]) ^ int(marks[k])).count("1") <= decontaminate.RADIUS}
    assert found == want


def test_search_names_few_of_many_items_of_a_length():
    rng = np.random.default_rng(13)
    items = [(k, " ".join(f"t{x}" for x in rng.integers(0, 9999, 30))) for k in range(1500)]
    n = decontaminate.grid_length(30)
    edges, members = decontaminate.postings(np.array([decontaminate.simhash(texthash.word_hashes(t.encode())) for _, t in items], np.uint64).view(np.uint16)[::4])
    named = np.diff(edges)
    assert named.sum() == len(members) == 1500 * 697 and named.mean() < 0.02 * 1500  # of a window's 1500 items a block names 1 %
    index = decontaminate.Items(items)
    assert len(index.near(rng.integers(0, 1 << 63, 3000).astype(np.uint64), n)[0]) < 3000 * 1500 * 1e-4


def test_recall_near_the_limit():
    """Of the windows at a similarity from 0.75 to 0.8 all but a few in a thousand are found."""
    rng = random.Random(21)
    items = [(k, " ".join(f"b{rng.randrange(20000)}" for _ in range(rng.randint(36, 90)))) for k in range(150)]
    index, wanted, found = decontaminate.Items(items), 0, 0
    for _ in range(6):
        for k, t in items:
            w = t.split()
            for _ in range(max(1, round(len(w) / 36))):
                w[rng.randrange(len(w))] = f"c{rng.randrange(20000)}"
            lead = [f"d{rng.randrange(20000)}" for _ in range(rng.randrange(30))]
            words = texthash.word_hashes(" ".join(lead + w + lead).encode())
            s = texthash.shingle_hashes(words, 5)
            if 0.75 <= max(index.similarity(s[p : p + len(w) - 4], k) for p in range(len(s))) < 0.8:
                wanted += 1
                found += any(h[1] == k for h in index.hits(words, np.array([0, len(words)])))
    assert wanted > 300 and found >= 0.995 * wanted, (found, wanted)


def test_decontamination_of_long_repeated_and_null_rows(spark):
    rng = random.Random(2)
    long = " ".join(f"l{rng.randrange(3000)}" for _ in range(40_000))
    items = [(0, long), (1, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (3, "one two three four five six")]
    rows = [(1, f"x {long} y"), (2, "z one two three four five six z"), (2, "z one two three four five six z"), (None, "q seven eight nine ten eleven twelve"), (5, "clean words only")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == {(1, 0): 1, (2, 1): 2, (2, 3): 2, (None, None): 1}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [5]


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench).count() == docs.count()


ODD = ["ΑΣ ΟΔΟΣ", "it's I'LL don't", "a<|endoftext|>B", "<|ENDOFTEXT|>", "½Ⅷ٣²", "e\u0301 İI", "a\x1cb\x85c\u2003d", "😀漢字ﬁ‍", "x" * 300, "#$%^ -- 12 3"]


def test_bpe_like_the_library(spark, docs, corpus, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = corpus + list(enumerate(ODD, 5000))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("old"))
    got = bpe.encode_decode(df, path, outputs=list(bpe.OUTPUTS)).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        want = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(want, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), text), t
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(none, path).count() == 0


def test_bpe_cache_is_bounded(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, b = tokenizers.Tokenizer.from_file(path), bpe.loaded(path)
    monkeypatch.setattr(bpe, "CACHE", 20)
    for k in range(10):
        texts = [f"word{k} thing{j} again, and{j * k}" for j in range(15)]
        for t, raw in zip(texts, b.encode(texts)):
            assert list(memoryview(raw).cast("I")) == lib.encode(t, add_special_tokens=False).ids
    assert len(b.known) + len(b.older) < 200


def test_bpe_fails_without_the_library(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(0, "a word")], "doc_id long, text string")
    bpe.unicode_differences.cache_clear()
    monkeypatch.setitem(sys.modules, "tokenizers", None)  # as if it weren't there
    try:
        for call in (lambda: bpe.loaded(path), lambda: bpe.encode_decode(docs, path)):
            with pytest.raises(ImportError):
                call()
    finally:
        bpe.unicode_differences.cache_clear()


def test_bpe_knows_every_sign():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, b = tokenizers.Tokenizer.from_file(path), bpe.loaded(path)
    signs = [chr(n) for n in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = [" ".join(f"a{c}B" for c in signs[k : k + 500]) for k in range(0, len(signs), 500)]
    for at in range(0, len(texts), 200):
        want = lib.encode_batch(texts[at : at + 200], add_special_tokens=False)
        for t, w, raw in zip(texts[at : at + 200], want, b.encode(texts[at : at + 200]), strict=True):
            assert list(memoryview(raw).cast("I")) == w.ids, [c for c in t.split(" ")][:3]


def test_bpe_of_long_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, b = tokenizers.Tokenizer.from_file(path), bpe.loaded(path)
    rng = random.Random(1)
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 1_000_000):
        word = "".join(rng.choices("etaoinshrdlu", k=n))
        began = time.process_time()
        raw = next(b.encode([word]))
        assert time.process_time() - began < 60
        assert list(memoryview(raw).cast("I")) == lib.encode(word, add_special_tokens=False).ids
        assert b.decode(raw) == lib.decode(memoryview(raw).cast("I").tolist(), skip_special_tokens=False)


def test_importance_keeps_the_clean(spark, none):
    rng = random.Random(8)
    clean = [" ".join(rng.choice(["the", "of", "and", "house", "river", "green"]) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(rng.choice(["$$$", "buy", "%%%", "win", "!!!"]) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(clean + junk + [clean[0], "", None])) + [(0, clean[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 80 else 0) for k in range(0, 120, 2)] + [(1, None), (999, 1), (None, 0)], "doc_id long, quality int")
    out = importance.classify(docs, labels).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id for r in out if r.kept}
    assert set(range(80)) <= kept and not kept & set(range(80, 120)) and 120 in kept
    keys = sorted((r.gumbel_key for r in out), reverse=True)
    least = min(r.gumbel_key for r in out if r.kept)
    assert all(r.kept == (r.gumbel_key >= least) for r in out) and keys.index(least) + 1 <= len(out)
    assert importance.resample(docs.withColumn("hash_", F.lit(1)), labels).count() == sum(r.kept for r in out)
    assert importance.classify(none, labels).count() == 0
    assert importance.classify(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_importance_like_plain_code(spark):
    rng = random.Random(18)
    words = {1: [f"good{k}" for k in range(40)], 0: [f"bad{k}" for k in range(40)]}
    kinds = [int(rng.random() < 0.7) for _ in range(400)]
    texts = [" ".join(rng.choice(words[y if rng.random() < 0.8 else 1 - y]) for _ in range(rng.randint(1, 60))) for y in kinds]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, kinds[k]) for k in range(0, 400, 2)], "doc_id long, quality int")

    def grams(t):
        return importance._grams([t])[0].tolist()

    raw, good = Counter(), Counter()
    for k, t in enumerate(texts):
        raw.update(grams(t))
        good.update(grams(t) if k % 2 == 0 and kinds[k] else [])
    n = 1 << importance.BITS

    def log_ratio(t):
        logs = [math.log((good[g] + 1) / (good.total() + n)) - math.log((raw[g] + 1) / (raw.total() + n)) for g in grams(t)]
        return sum(logs) / (len(logs) + importance.NEUTRAL)

    out = {r.doc_id: r for r in importance.classify(docs, labels, k=150).collect()}
    noise = []
    for k, t in enumerate(texts):
        assert abs(out[k].ratio - log_ratio(t)) < 1e-9 and abs(out[k].log_weight - importance.LENGTH * out[k].ratio) < 1e-9
        noise.append(out[k].gumbel_key - out[k].log_weight)
    assert {k for k in out if out[k].kept} == set(sorted(out, key=lambda k: -out[k].gumbel_key)[:150])
    assert abs(np.mean(noise) - 0.5772) < 0.25 and abs(np.std(noise) - 1.2825) < 0.25  # a Gumbel draw
    assert {k for k in out if out[k].kept} != set(sorted(out, key=lambda k: -out[k].log_weight)[:150])  # that has an effect
    a, b = importance.logistic(np.array([out[k].ratio for k in range(0, 400, 2)]), np.array([float(kinds[k]) for k in range(0, 400, 2)]))
    p = {k: 1 / (1 + math.exp(-(a * out[k].ratio + b))) for k in out}
    out = importance.classify(docs, labels)
    assert out.where("kept").count() == max(round(sum(p.values())), sum(x >= 0.5 for x in p.values()))


def test_kth_largest(spark):
    values = [5, -3, 7, 7, 0, 1 << 60, -(1 << 62)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k, want in enumerate(sorted(values, reverse=True), 1):
        assert importance.kth_largest(df, "x", k) == want


def test_draw_follows_the_weights(spark):
    """Equal texts with ids of their own have equal weights and noise of their own: how many stay is how likely each is."""
    kinds = {"good words here and there": 400, "plain words over here": 400, "plain tokens over some words": 400, "junk tokens": 400}
    rows = [(k, t) for k, t in enumerate(t for t, n in kinds.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 400, 2)] + [(k, 1) for k in range(400, 500)] + [(k, 0) for k in range(1200, 1600, 2)], "doc_id long, quality int")
    texts, stayed = dict(rows), []
    for length in (30, 10):
        out = importance.classify(docs, labels, k=500, length=length).collect()
        weight = {texts[r.doc_id]: r.log_weight for r in out}
        assert len(weight) == 4 and sum(r.kept for r in out) == 500
        kept = Counter(texts[r.doc_id] for r in out if r.kept)
        low, high = -60.0, 60.0
        for _ in range(100):  # the time at which 500 of all exponential clocks with these rates have rung
            at = (low + high) / 2
            rung = {t: 1 - math.exp(-math.exp(min(50.0, w + at))) for t, w in weight.items()}
            low, high = (at, high) if sum(400 * p for p in rung.values()) < 500 else (low, at)
        for t, p in rung.items():
            assert abs(kept[t] - 400 * p) < 4 * math.sqrt(400 * p * (1 - p)) + 4, (length, t, kept[t], 400 * p)
        stayed.append(sorted(kept.values(), reverse=True))
    assert stayed[0][0] > stayed[1][0]  # a smaller length mixes more


def test_toxicity(spark, none):
    rng = random.Random(6)
    plain = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(200)]
    bad = [f"{t} {rng.choice(['scoundrel', 'scoundrels', 'villain'])} {t[:20]}" for t in plain[:80]]
    rows = list(enumerate(plain + bad + ["", None, "VILLAIN!"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 200)) for k in range(280)] + [(3, None), (5000, 1)], "doc_id long, toxic int")
    learn = F.col("doc_id") % 4 != 0
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels, learn).collect()}
    assert len(out) == len(rows)
    assert all(out[k].predicted == int(k >= 200) for k in range(280))
    assert out[282].predicted == 1 and out[280].score == out[281].score < 0.5 and out[280].evidence == []
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert {e.id % 4 for r in out.values() for e in r.evidence} <= {1, 2, 3}
    assert toxicity.toxicity(none, labels, learn).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0), learn).collect()} == {0.0}


def plain_terms(text):
    return Counter(re.findall(r"\w+", text.lower()))


class PlainIndex:
    """TF-IDF cosine, votes, curve and scores, one example at a time."""

    def __init__(self, texts, toxic, weight):
        counts = [plain_terms(t) for t in texts]
        n, bad = len(texts), sum(toxic)
        df, tf = Counter(g for c in counts for g in c), Counter(g for c, y in zip(counts, toxic) for g in c if y)
        self.idf = {}
        for g, d in df.items():
            a, b = 2 * bad / n, 2 * (n - bad) / n  # two more examples, split as the classes are
            lean = (tf[g] + a) / (bad + a) / ((d - tf[g] + b) / (n - bad + b))
            self.idf[g] = math.log(1 + n / d) * max(1, math.log2(1 + lean))
        self.vectors, self.toxic, self.weight = [self.vector(c) for c in counts], toxic, weight
        self.prior = sum(w * y for w, y in zip(weight, toxic)) / sum(weight)

    def vector(self, counts):
        raw = {g: (1 + math.log(k)) * self.idf[g] for g, k in counts.items() if g in self.idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {g: x / norm for g, x in raw.items()}

    def near(self, q, k, but=None):
        dots = [(round(sum(w * v.get(g, 0.0) for g, w in q.items()), 12), d) for d, v in enumerate(self.vectors) if d != but]
        return sorted((x for x in dots if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k]

    def vote(self, near):
        yes = self.prior + sum(s * self.weight[d] for s, d in near if self.toxic[d])
        return math.log(yes / (1 - self.prior + sum(s * self.weight[d] for s, d in near if not self.toxic[d])))


def made_up_examples():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["foo", "bar", "baz", "qux", "quux", "foolish", "fooling"]) * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    toxic = np.array([int("foo" in t and rng.random() < 0.9) for t in texts])
    return texts, toxic, np.where(toxic == 1, 1.0, 3.0)


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_nearest_votes_and_scores_like_plain_code(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    texts, toxic, weight = made_up_examples()
    index, plain = toxicity.Index(list(range(300)), texts, toxic, weight), PlainIndex(texts, toxic, weight)
    queries = texts[:30] + ["foolhardy qux", "BAR, baz!", "foo " * 5000 + "nothing"]
    scores = index.scores(queries)
    a, b = index.curve
    for t, (score, near) in zip(queries, scores):
        want = plain.near(plain.vector(plain_terms(t)), toxicity.K)
        assert [(round(s, 9)) for s, _ in near] == [round(s, 9) for s, _ in want]
        if len({round(s, 9) for s, _ in want}) == len(want):  # without ties the examples agree as well
            assert [d for _, d in near] == [d for _, d in want]
        assert abs(score - 1 / (1 + math.exp(-(a * plain.vote(near) + b)))) < 1e-9
    votes = np.array([plain.vote(plain.near(v, toxicity.K, but=k)) for k, v in enumerate(plain.vectors)])
    wanted = importance.logistic(votes, toxic.astype(float), weight / weight.mean())
    assert np.allclose(index.curve, wanted, atol=0.05)


def test_blocks_that_cannot_hold_a_neighbour_are_not_read():
    rng = random.Random(5)
    texts = [" ".join(f"t{k % 40}x{rng.randrange(30)}" for _ in range(20)) + " common words" for k in range(4000)]
    toxic = np.array([k % 2 for k in range(4000)])
    index = toxicity.Index(list(range(4000)), texts, toxic, np.ones(4000))
    index.read = index.total = 0
    index.scores(texts[:50])
    assert index.total > 50 * 50 and index.read < 0.3 * index.total


def test_scores_answer_to_all_labelled_rows():
    """With clean examples thinned out, their weight keeps the mean score at the true share of toxic texts."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(30)) for _ in range(1500)]
    toxic = np.array([int(rng.random() < 0.12) for _ in texts])
    texts = [f"{t} villain" if y and rng.random() < 0.8 else t for t, y in zip(texts, toxic)]
    some = [k for k in range(1000) if toxic[k] or k % 5 == 0]
    clean = [k for k in some if not toxic[k]]
    weight = np.array([1.0 if toxic[k] else (1000 - toxic[:1000].sum()) / len(clean) for k in some])
    index = toxicity.Index(some, [texts[k] for k in some], toxic[some], weight)
    mean = np.mean([s for s, _ in index.scores(texts[1000:])])
    assert abs(mean - toxic[1000:].mean()) < 0.04


def test_toxicity_uses_every_term():
    """A rare insult, and words without any, find the examples that hold them."""
    rng = random.Random(12)
    plain = [" ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(120)]
    texts = [f"{t} scoundrel" if k % 2 else t for k, t in enumerate(plain)] + ["you absolute nincompoop", "fine weather today"]
    toxic = np.array([k % 2 for k in range(120)] + [1, 0])
    index = toxicity.Index(list(range(122)), texts, toxic, np.ones(122))
    assert index.scores(["nincompoop"])[0][1][0][1] == 120
    assert index.scores(["the weather"])[0][1][0][1] == 121
    for k in range(0, 120, 10):  # clean texts have neighbours like others, first of all themselves
        near = index.scores([texts[k]])[0][1]
        assert len(near) == toxicity.K and near[0][1] == k and near[0][0] > 0.999


def test_language(spark, none):
    rng = random.Random(10)
    sounds = {"aa": "aeiou rst", "bb": "kqzxw vgh", "cc": "éèà çñü mnl"}
    rows = []
    for k in range(240):
        lang = list(sounds)[k % 3]
        rows.append((k, "".join(rng.choice(sounds[lang]) for _ in range(rng.randint(60, 400))), lang))
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "123 ... !!", "cc"), (303, "aeiou " * 3000, None), (304, "kqz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.languages(docs, F.col("doc_id") % 4 != 2).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in range(240) if k % 4 == 2]
    assert np.mean([got[k].lang_pred == list(sounds)[k % 3] for k in held]) > 0.95
    assert [got[k].lang_pred for k in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert language.languages(none.withColumn("lang", F.lit("x")), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.languages(docs, F.lit(False)).collect()} == {"und"}


def test_pooled_probabilities_like_plain_code(spark):
    net = language.Network(3, hidden=4)
    w = {k: v.astype(float) for k, v in net.p.items()}

    def states(window, d):
        h, out = np.zeros(4), {}
        for t in range(len(window)) if d == 0 else range(len(window) - 1, -1, -1):
            a = w[f"E{d}"][window[t]]
            gates = np.clip(0.2 * (a[:8] + h @ w[f"U{d}"]) + 0.5, 0, 1)
            c = np.tanh(a[8:] + (gates[4:] * h) @ w[f"W{d}"])
            out[t] = h = (1 - gates[:4]) * h + gates[:4] * c
        return out

    def pooled(text):
        total = np.zeros(3)
        for at in range(0, len(text), language.WINDOW):
            window = text[at : at + language.WINDOW]
            f, b = states(window, 0), states(window, 1)
            for t in range(len(window)):
                o = np.exp(np.concatenate([f[t], b[t]]) @ w["V"] + w["c"])
                total += o / o.sum()
        return total / max(len(text), 1)

    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(32, 127)) for _ in range(n)).encode() for n in (1, 5, 127, 128, 129, 300, 1000)] + ["é".encode()]
    assert np.allclose(language.read(net, texts), [pooled(t) for t in texts], atol=1e-5)


def test_language_of_repeated_rows_and_clashing_names(spark):
    rows = [(k % 40, ("aei ou " if k % 2 else "kqz xw ") * 9, "a" if k % 2 else "k", 1, 2) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k_ int, n_ int")
    got = language.languages(docs, F.lit(True)).collect()
    assert len(got) == 80 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 40 and all(r.lang_pred == ("a" if r.doc_id % 2 else "k") for r in got)


def test_superminhash_varies_less_than_minhash():
    """On sets smaller than the signature, where correlated ranks matter, the estimates' variance is lower."""
    rng = np.random.default_rng(4)
    ours, plain = [], []
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 45).astype(np.uint64)
        a, b = x[:30], x[15:]  # a third in common
        s = minhash.signatures([np.unique(a), np.unique(b)])
        ours.append((s[0] == s[1]).mean())
        seeds = rng.integers(0, 1 << 63, minhash.SLOTS).astype(np.uint64)[:, None]
        plain.append((texthash.mix(a[None, :] ^ seeds).min(1) == texthash.mix(b[None, :] ^ seeds).min(1)).mean())
    assert abs(np.mean(ours) - 1 / 3) < 0.02 and np.var(ours) < 0.75 * np.var(plain), (np.var(ours), np.var(plain))


def test_toxicity_without_words_and_with_repeats(spark):
    docs = spark.createDataFrame([(1, "..."), (2, None), (3, "bad"), (3, "bad"), (3, "worse " * 20000), (None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()}) == 1  # examples without a term: an empty vocabulary
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs.withColumns({"k": F.lit(1), "h": F.lit(2), "body": F.lit(3)}), labels, F.lit(True)).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 3 and r.evidence and r.evidence[0].similarity > 0.99}) <= 2


def test_gradients():
    net = language.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(0, 256, (3, 7)).astype(np.uint8), np.array([0, 1, 2])
    _, g = net.gradients(x, y)
    for name, at in (("U0", (1, 1)), ("W1", (2, 0)), ("E0", (x[0, 2], 5)), ("V", (3, 2)), ("c", (1,))):
        old, step = net.p[name][at], 1e-3
        net.p[name][at] = old + step
        up = net.gradients(x, y)[0]
        net.p[name][at] = old - step
        down = net.gradients(x, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-5
