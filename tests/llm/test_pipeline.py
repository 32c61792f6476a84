"""The pipeline's stages one after the other, each against plain code on what its predecessor kept."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from test_models import reachable  # noqa: E402
from test_native import drop  # noqa: E402

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus):
    rng = random.Random(21)
    item = " ".join(f"b{rng.randrange(500)}" for _ in range(30))
    junk = [" ".join(rng.choice(["$$$", "buy%%%", "&&&", "win!!!"]) for _ in range(70)) for _ in range(25)]
    rows = [(i, t) for i, t in corpus] + [(100 + k, t) for k, t in enumerate(junk)] + [(200, f"x y {item} z")]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 100 <= i < 125), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes and out.columns == NAMES, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name == "quality_classifier":
            assert not [r for r in rows if 100 <= r.doc_id < 125]
            assert all(r.text == before[r.doc_id] for r in rows)
            lost = set(range(30)) - {r.doc_id for r in rows}
            assert len(lost) <= 1, lost
        elif name == "line_dedup":
            want = drop(list(before.items()), 10)
            assert {r.doc_id: r.text for r in rows} == {i: x[2] for i, x in want.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "minhash_dedup":
            assert {r.doc_id for r in rows} == {i for i, x in reachable(list(before.items())).items() if x[2]}
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == set(before) - {200} and 200 in before
        else:
            lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {r.doc_id: r.ids for r in rows} == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in before.items()}
        before = {r.doc_id: r.text for r in rows} if "text" in docs.columns else {}
    last = {(r.doc_id, r.n_tokens) for r in docs.collect()}
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()} == last


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_repeats_null_ids_and_other_columns(spark, folder, tmp_path):
    """Copies of a row stay or go together, rows without id are rows like others, further columns come through four stages whatever their names."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    some = docs.where("doc_id in (0, 1, 30, 105, 200)")
    lost = docs.where("doc_id in (2, 3, 110, 200)").withColumn("doc_id", F.lit(None).cast("long"))
    extra = {"h_": F.lit("x"), "kept": F.lit(True), "K": F.col("n_chars"), "score": F.lit(0.5), "component_id": F.lit(7), "words": F.array(F.lit("w")), "ids": F.lit("mine")}
    rows = docs.unionByName(some).unionByName(some).unionByName(lost).unionByName(lost).withColumns(extra)
    shape, clean = rows.dtypes, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = Counter((r.doc_id, r.text) for r in rows.collect())
        out = stage(spark, rows, folder)
        if k < 4:
            assert out.dtypes == shape, name
        out.write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        now = rows.collect()
        if k in (0, 2, 3):
            after = Counter((r.doc_id, r.text) for r in now)
            assert all(n == before[key] for key, n in after.items()), name
        if k == 0:
            assert not [r for r in now if r.text and "win!!!" in r.text] and after[None, clean[2]] == 2 and after[0, clean[0]] == 3
        elif k == 1:
            assert len(now) == sum(before.values())
        elif k == 3:
            assert not [r for r in now if r.doc_id == 200 or (r.text and r.text.startswith("x y b"))]
            assert {n for (i, _), n in after.items() if i == 0} == {3}
    assert len(now) == sum(after.values()) and all(r.h_ == "x" if hasattr(r, "h_") else True for r in now)
