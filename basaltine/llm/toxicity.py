"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index over all terms.

Terms are the lower-cased words (runs of word characters) of whole texts, as 64-bit hashes. Every term of an example is
indexed and every term of a text is looked up; terms that no example holds can't match and don't count in the text's
norm. A term weighs (1 + log count) * log(1 + examples / examples that have it) * its lean to the toxic side, log2(1 +
ratio of its shares of toxic and other examples), 1 at least: words that both sides use weigh as usual, insults more.
Shares are smoothed as if SMOOTH more examples had the term, of either class as many as its part of all, so a word of one
or two examples leans little. Without the lean the method can't give right results on whole texts (figures in the
README). Examples are a
bounded sample of the labelled rows' different texts, PER_CLASS of each class at most, those with the smallest hashes; a
class weighs as much as it does among all labelled rows.

Examples are ordered so that similar ones stand together and cut into blocks of BLOCK. A term's posting list is a list
of blocks, each with the largest weight in it and the weights by example. A text's terms give each block a bound; the
blocks are summed up in the order of their bounds until no bound reaches the K-th best similarity, so the K nearest
are exact and the other blocks' postings are never read. Equal similarities go by example number. Votes weighted by
nearness, smoothed with the share of toxic rows, are calibrated by a logistic curve fitted to the votes each example
gets from all others, where each example counts as its class weighs. Texts without a term that an example holds have
no neighbour; their score is the share of toxic rows among examples without a term. Empty and null texts are such
texts.

Labels that are null, or of rows that aren't there, are not used; of repeated labels the largest counts, of repeated
ids with different texts the least text is the example; repeated rows are scored alike. Texts of any length are read
whole; work and memory go with the length. Without toxic examples every score is 0. An empty table gives an empty
result. Only the key and the text of the input are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.importance import logistic
from basaltine.llm.texthash import word_hashes_of

GAP = re.compile(r"\W+")
PER_CLASS = 700
SMOOTH = 2
K = 25
#: Examples of a block; blocks that are summed up together.
BLOCK, STEP = 64, 8
#: Examples of a block from which on a term's weights there are kept as a row of all BLOCK weights.
FULL = 14
#: More than the rounding of sums; similarities are 1 at most.
SLACK = 1e-9


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def terms_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each text, terms in ascending order."""
    raw = [GAP.sub(" ", (t or "").lower()).encode() for t in texts]
    words, bounds = word_hashes_of(raw)
    return [np.unique(words[bounds[k] : bounds[k + 1]], return_counts=True) for k in range(len(texts))]


class Index:
    """The labelled examples, ready to be asked for the nearest ones."""

    def __init__(self, ids: list, texts: list[str | None], toxic: np.ndarray, weight: np.ndarray):
        """weight: of each example, for its class."""
        found = terms_of(texts)
        sizes = np.array([len(t) for t, _ in found], np.int64)
        hashes = np.concatenate([t for t, _ in found]) if found else np.empty(0, np.uint64)
        counts = np.concatenate([c for _, c in found]) if found else np.empty(0, np.int64)
        self.vocabulary, terms = np.unique(hashes, return_inverse=True)
        df = np.bincount(terms, minlength=len(self.vocabulary))
        bad = np.bincount(terms[np.repeat(toxic == 1, sizes)], minlength=len(self.vocabulary))
        n_bad, n_good = int(toxic.sum()), len(texts) - int(toxic.sum())
        a, b = SMOOTH * n_bad / max(1, len(texts)), SMOOTH * n_good / max(1, len(texts))
        lean = (bad + a) / max(1e-9, n_bad + a) / np.maximum(1e-9, (df - bad + b) / max(1e-9, n_good + b))
        self.idf = np.log(1 + len(texts) / np.maximum(df, 1)) * np.maximum(1, np.log2(1 + lean))
        total = max(weight.sum(), 1e-9)
        self.prior = float((weight * toxic).sum() / total)
        bare = sizes == 0
        self.bare = float(((weight * toxic)[bare].sum() + self.prior) / (weight[bare].sum() + 1)) if len(sizes) else 0.0
        kept = np.flatnonzero(sizes)
        self.ids = [ids[i] for i in kept]
        self.toxic, self.weight = toxic[kept].astype(float), weight[kept]
        at = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int64)
        raw = (1 + np.log(counts)) * self.idf[terms]
        if len(raw):
            raw /= np.repeat(np.sqrt(np.add.reduceat(raw * raw, at[:-1])), sizes[kept])
        self.vectors = [(terms[x:y], raw[x:y]) for x, y in zip(at[:-1], at[1:])]
        self._post(terms, raw, at)
        self.curve = (1.0, 0.0)
        self.calibrate()

    def _order(self) -> np.ndarray:
        """The examples, similar ones together: by the most similar of some of them."""
        n = len(self.vectors)
        hubs = np.linspace(0, n - 1, min(n, 96)).astype(int) if n else []
        side = np.zeros((len(self.vocabulary), len(hubs)), np.float32)
        for k, h in enumerate(hubs):
            side[self.vectors[h][0], k] = self.vectors[h][1]
        near = np.array([w.astype(np.float32) @ side[t] for t, w in self.vectors]).reshape(n, len(hubs))
        best = near.argmax(1) if n else np.empty(0, int)
        return np.lexsort((-near[np.arange(n), best], best)) if n else best

    def _post(self, terms: np.ndarray, weights: np.ndarray, at: np.ndarray) -> None:
        """The posting lists: term -> blocks -> examples."""
        self.number = self._order()  # of the example at each place
        place = np.empty(len(self.number), np.int64)
        place[self.number] = np.arange(len(self.number))
        where = np.repeat(place, np.diff(at))
        order = np.lexsort((where, terms))
        terms, where = terms[order], where[order]
        self.n_blocks = -(-len(self.number) // BLOCK)
        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (where[1:] // BLOCK != where[:-1] // BLOCK)
        heads = np.flatnonzero(first)
        self.slots, self.values = (where % BLOCK).astype(np.int32), weights[order]
        self.posts = np.append(heads, len(terms))  # where a block of a list begins
        self.blocks = (where[heads] // BLOCK).astype(np.int16 if self.n_blocks < 1 << 15 else np.int32)  # 16 bits sort faster
        self.most = np.maximum.reduceat(self.values, heads) if len(heads) else np.empty(0)
        full = np.flatnonzero(np.diff(self.posts) >= FULL)
        self.row = np.full(len(heads), -1, np.int32)
        self.row[full] = np.arange(len(full))
        self.rows = np.zeros((len(full), BLOCK))
        n = np.diff(self.posts)[full]
        at = ranges(self.posts[full], self.posts[full + 1])
        self.rows[np.repeat(np.arange(len(full)), n), self.slots[at]] = self.values[at]
        self.lists = np.searchsorted(terms[heads], np.arange(len(self.vocabulary) + 1))
        self.read = self.total = 0  # blocks summed up, and blocks that a text shares a term with

    def __getstate__(self) -> dict:
        """Without what only calibration needs."""
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text, as numbers, and their weights; both empty if there are none."""
        if not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == terms
        at = at[hit]
        raw = (1 + np.log(counts[hit])) * self.idf[at]
        return at, raw / max(math.sqrt(raw @ raw), 1e-300)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = K, but: int | None = None) -> list[tuple[float, int]]:
        """The k most similar examples as (similarity, number), best first; without the one called but."""
        terms, w = vector
        starts, ends = self.lists[terms], self.lists[terms + 1]
        entry, w = ranges(starts, ends), np.repeat(w, ends - starts)
        block = self.blocks[entry]
        bound = np.bincount(block, w * self.most[entry], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound)]
        by_block = np.argsort(block, kind="stable")
        entry, w = entry[by_block], w[by_block]
        edges = np.searchsorted(block[by_block], np.arange(self.n_blocks + 1))
        numbers, sums, least = np.empty(0, np.int64), np.empty(0), -1.0
        for first in range(0, len(order), STEP):
            some = order[first : first + STEP]
            if bound[some[0]] + SLACK < least:
                break
            some = some[bound[some] + SLACK >= least]
            self.read += len(some)
            got = self._sums(entry, w, edges[some], edges[some + 1])
            at = np.flatnonzero(got)
            here = self.number[some[at // BLOCK] * BLOCK + at % BLOCK]
            numbers, sums = np.concatenate([numbers, here]), np.concatenate([sums, got[at]])
            if but is not None:
                stay = numbers != but
                numbers, sums = numbers[stay], sums[stay]
            best = np.lexsort((numbers, -sums))[:k]
            numbers, sums = numbers[best], sums[best]
            if len(sums) == k:
                least = sums[-1]
        self.total += len(order)
        return list(zip(sums.tolist(), numbers.tolist()))

    def _sums(self, entry: np.ndarray, w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Similarities to the examples of some blocks, BLOCK each; a block's entries are a range of entry."""
        mine = ranges(starts, ends)
        e, w, local = entry[mine], w[mine], np.repeat(np.arange(len(starts)), ends - starts)
        row = self.row[e]
        full = row >= 0
        out = np.zeros((len(starts), BLOCK))
        if full.any():
            some, cut = local[full], np.flatnonzero(np.diff(local[full], prepend=-1))
            out[some[cut]] = np.add.reduceat(self.rows[row[full]] * w[full][:, None], cut, axis=0)
        e, w, local = e[~full], w[~full], local[~full]
        n = self.posts[e + 1] - self.posts[e]
        post = ranges(self.posts[e], self.posts[e + 1])
        cell = np.repeat(local * BLOCK, n) + self.slots[post]
        return (out.ravel() + np.bincount(cell, self.values[post] * np.repeat(w, n), out.size)).round(12)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Log odds of the votes, weighted by similarity."""
        at = [d for _, d in near]
        w = np.array([s for s, _ in near]) * self.weight[at]
        yes = float((w * self.toxic[at]).sum()) + self.prior
        no = float((w * (1 - self.toxic[at])).sum()) + 1 - self.prior
        return math.log(yes / no)

    def calibrate(self) -> None:
        n = len(self.ids)
        if n < 20 or self.toxic.min() == self.toxic.max():
            return
        votes = [self.vote(self.nearest(v, but=k)) for k, v in enumerate(self.vectors)]
        self.curve = logistic(np.array(votes), self.toxic, self.weight / self.weight.mean())
        if self.curve[0] <= 0:
            self.curve = (1.0, 0.0)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """For each text a score between 0 and 1, and the neighbours that speak for it."""
        out = []
        for terms, counts in terms_of(texts):
            near = self.nearest(vector) if len((vector := self.vector(terms, counts))[0]) else []
            if near:
                x = self.curve[0] * self.vote(near) + self.curve[1]
                out.append((1 / (1 + math.exp(-max(-500.0, min(500.0, x)))), near))
            else:
                out.append((self.bare, []))
        return out


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column) -> Index | None:
    """The index of the sample; learn: which ids may be learnt from. None if there is no toxic example."""
    known = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("toxic"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.alias("body"))
    labelled = rows.select("k", "h").join(known, "k")
    sizes = {r[0]: r[1] for r in labelled.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    if not sizes.get(True):
        return None
    texts = labelled.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("k").alias("k"))
    some = [texts.where(c).orderBy("h").limit(PER_CLASS) for c in ("toxic = 1", "toxic <> 1")]
    picked = F.broadcast(some[0].unionByName(some[1]))
    found = rows.join(picked, ["k", "h"]).groupBy("k", "toxic").agg(F.min("body").alias("body")).collect()
    found.sort(key=lambda r: r.k)
    toxic = np.array([r.toxic == 1 for r in found], int)
    n = {1: max(1, int(toxic.sum())), 0: max(1, int((1 - toxic).sum()))}
    weight = np.where(toxic == 1, sizes.get(True, 0) / n[1], sizes.get(False, 0) / n[0])
    return Index([r.k for r in found], [r.body for r in found], toxic, weight)


def toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """(key, score, predicted, evidence): evidence names the nearest examples (id, similarity, toxic), best first."""
    kind = dict(docs.dtypes)[key]
    index = examples(docs, labels, key, text, label, learn)
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by PER_CLASS
    schema = f"`{key}` {kind}, score double, predicted int, evidence array<struct<id: {kind}, similarity: double, toxic: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                b = rows.slice(at, 256)
                scores, evidence = [], []
                texts = b.column(1).to_pylist()
                for s, near in [(0.0, [])] * len(texts) if index is None else index.scores(texts):
                    scores.append(s)
                    top = [{"id": index.ids[d], "similarity": x, "toxic": int(index.toxic[d])} for x, d in near[:3]]
                    evidence.append(top)
                shape = pa.list_(pa.struct([("id", b.schema.types[0]), ("similarity", pa.float64()), ("toxic", pa.int32())]))
                made = [
                    b.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(evidence, shape),
                ]
                yield pa.RecordBatch.from_arrays(made, names=[key, "score", "predicted", "evidence"])

    return docs.select(key, text).mapInArrow(run, schema)
