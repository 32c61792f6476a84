"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed word n-grams (single words and pairs) are fitted: one on the trusted documents, one on
the whole raw corpus, the trusted ones included. A document's score is the mean over its n-grams of
log(p_trusted / p_raw), so long and short documents compare. Every document is judged by that number alone: under the
threshold it is rejected. The models have a fixed number of buckets, so they have the same size for any corpus; the
corpus is counted in full, summed on the map side.

Null and empty texts have no word; they score 0 and fail the base rules. Labels of documents that aren't there, null
labels and repeated labels change nothing (a document is trusted if any of its labels says so). Repeated rows count
as often as they occur. Without trusted documents all scores are 0. A document that scores exactly the threshold is
kept. Texts of any length are read whole, in time that goes with their length. An empty table gives an empty result.
Columns of the input that are named like a result column are replaced; others may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.common import broadcast_if_small, fresh, let

#: Hash buckets of the two models.
BUCKETS = 1 << 16
#: Documents that score less are rejected.
THRESHOLD = -0.15
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed value: what parts words.
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def _at(a: Column, i: Column) -> Column:
    """a[i] from 0."""
    return F.get(a, i)


def ngrams(words: Column, buckets: int) -> Column:
    """Hash buckets of the words and of the pairs of neighbours."""

    def both(w: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.pmod(F.hash(_at(w, i - 1), _at(w, i)), F.lit(buckets))
        )
        single = F.transform(w, lambda x: F.pmod(F.hash(x), F.lit(buckets)))
        return F.when(F.size(w) < 2, single).otherwise(F.concat(single, pairs))

    return let(words, both)


def repeat_words(words: Column) -> Column:
    """Words that stand in 3-word windows found twice or more. Windows are told apart by 64-bit hashes."""

    def covered(starts: Column) -> Column:
        """Length of the union of the windows at these ascending starts."""
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(starts) - 1), lambda i: F.least(F.lit(3), _at(starts, i) - _at(starts, i - 1))
        )
        return F.when(F.size(starts) < 2, F.size(starts) * 3).otherwise(
            F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)
        )

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                s, lambda x, i: (x.h == F.get(s, i - 1).h).eqNullSafe(True) | (x.h == F.get(s, i + 1).h).eqNullSafe(True)
            ),
        )
        return let(F.array_sort(F.transform(twice, lambda x: x.i)), covered)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeated(hashes))

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(_at(w, i - 2), _at(w, i - 1), _at(w, i))
        )

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), counted))).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def fit(docs: DataFrame, trusted: Column, text: str = "text", buckets: int = BUCKETS) -> list[float]:
    """log(p_trusted / p_raw) of each bucket; both counts are raised by one. All zeros without trusted documents."""
    grams = docs.select(trusted.alias("t"), F.explode(ngrams(words_of(F.col(text)), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("good")).collect()
    raw, good = [1.0] * buckets, [1.0] * buckets
    for b, r, g in counts:
        raw[b] += r
        good[b] += g
    all_raw, all_good = sum(raw), sum(good)
    if all_good == buckets:
        return [0.0] * buckets
    return [math.log(g / all_good) - math.log(r / all_raw) for r, g in zip(raw, good)]


def model_column(model: list[float]) -> Column:
    """The model as a constant; it is folded once, when the query is planned."""
    return F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")


def score(words: Column, model: list[float]) -> Column:
    """Mean of the model over the n-grams; 0 without any."""
    table = model_column(model)
    grams = ngrams(words, len(model))

    def mean(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total / F.size(g))

    return let(grams, mean)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """docs with the counts, the score and the verdict of each document."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    (mark,) = fresh(docs, "trusted_")
    trusted = labels.where(F.col(quality) == 1).select(key).distinct().withColumn(mark, F.lit(True))
    trusted = broadcast_if_small(trusted, key)  # beyond that the texts are shuffled
    marked = docs.select(key, text).join(trusted, key, "left")
    model = fit(marked, F.coalesce(F.col(mark), F.lit(False)), text, buckets)
    (w,) = fresh(docs, "words_")
    body = F.coalesce(F.col(text), F.lit(""))
    n_symbols = F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))
    counted = docs.withColumn(w, words_of(F.col(text))).select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x)).alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        dup_lines(F.col(text)).alias("n_dup_lines"),
        repeat_words(F.col(w)).alias("n_repeat_words"),
        score(F.col(w), model).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
