"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models over hashed word n-grams (words and pairs, a fixed number of buckets) are counted in full: one
on the target documents (label quality 1), one on the whole raw corpus. A document's importance weight is the ratio of
its likelihoods under the two. It is normalised in length, or long texts alone would be drawn: the log ratio per
n-gram, with NEUTRAL n-grams of ratio 1 added to each text so that a few words say little, times `length`, as if each
document had that many n-grams. length is the inverse of the draw's temperature: noise of standard deviation 1.28 is added to
the log weights, so two documents whose ratios per n-gram differ by 1.28 / length change places about as often as not. At
LENGTH = 100 that is 0.013, far less than what parts clean texts from junk (README), so that a filter keeps clean texts; a
smaller length mixes more. k documents are drawn without replacement in proportion to the weights: log weight plus
seeded Gumbel noise, the k largest stay. k is a parameter; if it is not given it is the number of target-like
documents, counted by a logistic curve from the log ratio to the probability of being target, which is fitted to a bounded
sample of labelled documents (SAMPLE): the sum of the probabilities, or the number of those that are one half or more if
that is larger. The curve sets nothing but k. The k-th largest key is found by four rounds of counting 16 bits, so no
step sorts all documents in one task.

Documents without words have a log ratio of 0. Very long texts are counted whole. Repeated rows (same id, same text)
draw the same noise and stay or go together; ties with the k-th key stay. Labels that are null or of unknown documents
change nothing; of repeated labels the largest counts; without labels of both kinds every document stays. An empty
table gives an empty result. Only key and text are read, so other columns may have any names; columns of the input
named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.common import broadcast_if_small, checkpointed, without
from basaltine.llm.texthash import mix, word_hashes_of

BITS = 16
#: Labelled documents to which the logistic curve is fitted at most.
SAMPLE = 20_000
#: N-grams that every document's ratio is taken for, and n-grams of ratio 1 that are added to each.
LENGTH, NEUTRAL = 100, 20
RESULTS = ("ratio", "probability", "log_weight", "gumbel_key", "kept")


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the text that each belongs to."""
    words, bounds = word_hashes_of([(t or "").encode() for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    same = doc[:-1] == doc[1:]
    shift = np.uint64(64 - BITS)
    grams = np.concatenate([words >> shift, pairs[same] >> shift]).astype(np.int64)
    return grams, np.concatenate([doc, doc[:-1][same]])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fit(docs: DataFrame, text: str, target: Column) -> np.ndarray:
    """Log ratios of the two models by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in _parts(batches):
            grams, doc = _grams(b.column(0).to_pylist())
            is_target = np.array(b.column(1).to_pylist(), dtype=bool)
            raw += np.bincount(grams, minlength=1 << BITS)
            good += np.bincount(grams[is_target[doc]], minlength=1 << BITS)
        seen = np.flatnonzero(raw)
        columns = [pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])]
        yield pa.RecordBatch.from_arrays(columns, names=["b", "raw", "good"])

    counted = docs.select(F.col(text), target).mapInArrow(count, "b long, raw long, good long")
    rows = counted.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # one a bucket
    raw, good = np.ones(1 << BITS), np.ones(1 << BITS)
    for r in rows:
        raw[r.b] += r.raw
        good[r.b] += r.good
    if good.sum() == len(good):
        return np.zeros(1 << BITS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def ratios(docs: DataFrame, key: str, text: str, model: np.ndarray) -> DataFrame:
    """(key, h, ratio): the log ratio of each document per n-gram; h seeds its noise."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            grams, doc = _grams(b.column(2).to_pylist())
            n = np.bincount(doc, minlength=b.num_rows) + NEUTRAL
            total = np.bincount(doc, weights=model[grams], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total / n)], names=[key, "h", "ratio"])

    rows = docs.select(key, F.xxhash64(key, text).alias("h"), F.col(text))
    return rows.mapInArrow(score, f"`{key}` {dict(docs.dtypes)[key]}, h long, ratio double")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a small ridge."""
    w = np.zeros(2)
    weight = np.ones_like(x) if weight is None else weight
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _sortable(x: Column) -> Column:
    """A long that sorts as the non-NaN double does, scaled; ties below 2^-32 count as equal."""
    return F.floor(x * F.lit(float(1 << 32))).cast("long")


def kth_largest(keys: DataFrame, name: str, k: int) -> int:
    """The k-th largest of a column of longs: rounds of counting by 16 bits, the highest first."""
    low = 0
    left = k
    prefix = keys.select((F.col(name).bitwiseXOR(F.lit(-(1 << 63)))).alias("u"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        here = prefix if shift == 48 else prefix.where(F.shiftrightunsigned("u", shift + 16) == F.lit(low))
        counts = dict(here.groupBy(digit.alias("d")).count().collect())  # 65536 rows at most
        for d in sorted(counts, reverse=True):
            if left <= counts[d]:
                low = (low << 16) | d
                break
            left -= counts[d]
    return low - (1 << 63)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    k: int | None = None,
    seed: int = 7,
    length: float = LENGTH,
) -> DataFrame:
    """(key, h, ratio, probability, log_weight, gumbel_key, kept), one row for each document; h tells its text."""
    known = labels.where(F.col(quality).isNotNull()).groupBy(key).agg(F.max(quality).alias("target_"))
    known = broadcast_if_small(known, key)
    marked = docs.select(key, text).join(known, key, "left")
    model = fit(marked, text, F.coalesce(F.col("target_") == 1, F.lit(False)))
    scored = checkpointed(ratios(docs, key, text, model))
    sample = scored.join(known, key).select("h", "ratio", "target_").orderBy(F.xxhash64("h")).limit(SAMPLE).collect()
    x, y = np.array([r.ratio for r in sample]), np.array([float(r.target_ == 1) for r in sample])
    if len(set(y.tolist())) == 2:
        a, b = logistic(x, y)
    else:
        a, b = 0.0, 40.0
    odds = F.lit(a) * F.col("ratio") + F.lit(b)
    log_p = F.when(odds > 0, -F.log1p(F.exp(-odds))).otherwise(odds - F.log1p(F.exp(odds)))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = (
        scored.withColumn("log_weight", F.lit(float(length)) * F.col("ratio"))
        .withColumn("probability", F.exp(log_p))
        .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit)))
    )
    if k is None:
        sums = keyed.agg(F.sum("probability"), F.count_if(F.col("probability") >= 0.5)).first()
        k = max(int(round(sums[0] or 0.0)), sums[1] or 0)
    k = min(k, scored.count())
    order = _sortable(F.col("gumbel_key"))
    least = kth_largest(keyed.select(order.alias("o")), "o", k) if k else None
    return keyed.withColumn("kept", order >= F.lit(least) if k else F.lit(False))


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality"
) -> DataFrame:
    """The documents that were drawn, with all their columns."""
    gone = classify(docs, labels, key, text, quality).where(~F.col("kept"))
    return without(docs, gone.select(F.col(key).alias("k_"), F.col("h").alias("h_")), key, F.xxhash64(key, text))
