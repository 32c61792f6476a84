"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased. Each window of a document gets a 64-bit SimHash of its word pairs: the
bits in which more than half of the pairs' hashes have a one. Windows begin at every word and have the lengths of the
items, on a grid of lengths GRID apart in proportion; a shorter document is one window. The fingerprints of the items
of a length stand in an index of BLOCKS blocks of 16 bits: for each value of a block a posting list names the items
whose own value is within RADIUS // BLOCKS bits. By the pigeonhole principle every item within RADIUS bits of a window
is named by one of the window's values at least; items named are compared in full (among FEW or fewer all are, once one
is named). Last, the windows found and their
neighbours are compared with the item by weighted Jaccard similarity of their sets of 5-word shingles (of shingles of all
its words, if the item is shorter); a shingle weighs log(1 + items / items that have it), counted over the whole
benchmark. Pairs with 0.75 or more are hits.

The items are a stated query set: they are broadcast in blocks of ITEMS, whose index a worker builds once, and all
documents are read for each block. The guarantee of the search is for fingerprints within RADIUS bits; near the limit of
0.75 a few windows lie beyond it (the tests measure how many).

Items without words are ignored; repeated items count each. Null and empty documents have no window. Of windows that
are equally alike the first is told. Repeated rows and null ids give rows like others. Memory goes with a block of words of
one text, not with the text. Documents and benchmarks without rows give an empty result. Only keys and texts are read,
so other columns may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.llm.common import SPACE, checkpointed, without
from basaltine.llm.texthash import mix, shingle_hashes, word_hashes, word_hashes_of

SHINGLE = 5
RADIUS, BLOCKS = 15, 4
GRID = 1.12
ITEMS = 10_000
#: Items of a length up to which it is cheaper to compare all with a window that any list has an item for.
FEW = 48
SIMILARITY = 0.75
#: Words that are fingerprinted at a time.
PIECE = 1 << 15


def grid_length(n: int) -> int:
    """The window length that stands for items of n words."""
    return n if n < 8 else round(GRID ** round(math.log(n, GRID)))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; the last word has none."""
    return mix(words[:-1] * np.uint64(3) + words[1:])


def prefix_bits(features: np.ndarray) -> np.ndarray:
    """How many of the first i features have each of the 64 bits; modulo 2^16 where windows of all of them are short."""
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1)
    kind = np.int16 if len(features) < 1 << 17 else np.int32  # PIECE and the longest window
    out = np.zeros((len(features) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def fingerprints(counts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of windows with n features, from their bit counts."""
    return np.packbits(counts > n // 2, axis=1).view(np.uint64).reshape(-1)


def simhash(words: np.ndarray) -> int:
    """SimHash of a whole sequence; one word is its own feature."""
    features = pair_hashes(words) if len(words) > 1 else words
    return int(fingerprints(prefix_bits(features)[-1:], len(features))[0])


def postings(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, members): members[edges[v]:edges[v + 1]] are those whose 16-bit value is within RADIUS // BLOCKS bits of v."""
    flips = [0]
    for k in range(1, RADIUS // BLOCKS + 1):
        flips += [sum(1 << b for b in c) for c in combinations(range(16), k)]
    near = (values[:, None] ^ np.array(flips, np.uint16)[None, :]).reshape(-1)
    order = np.argsort(near, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))])
    return edges, (order // len(flips)).astype(np.int32)


class Items:
    """The index of a block of items. known: (items of the whole benchmark, how many of them have a shingle), else counted here."""

    def __init__(self, items: list[tuple[object, str]], known: tuple[int, dict[int, int]] | None = None):
        self.ids, self.sets, self.lengths, marks = [], [], [], []
        for item, text in items:
            words = word_hashes((text or "").encode().lower())
            if len(words):
                self.ids.append(item)
                self.sets.append(frozenset(shingle_hashes(words, SHINGLE).tolist()))
                self.lengths.append(len(words))
                marks.append(simhash(words))
        n_items, found = known or (len(self.ids), Counter(g for s in self.sets for g in s))
        self.weights = {g: math.log(1 + n_items / found.get(g, 1)) for g in {g for s in self.sets for g in s}}
        self.other = math.log(1 + n_items)
        self.totals = [sum(map(self.weights.__getitem__, s)) for s in self.sets]
        self.shingles = np.array(sorted(self.weights), dtype=np.uint64)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        by_length: dict[int, list[int]] = {}
        for k, n in enumerate(self.lengths):
            by_length.setdefault(grid_length(n), []).append(k)
        for n, members in by_length.items():
            prints = np.array([marks[k] for k in members], np.uint64)
            lists = [postings(v) for v in prints.view(np.uint16).reshape(-1, BLOCKS).T]
            if len(members) <= FEW:
                lists = [np.diff(edges) > 0 for edges, _ in lists]
            self.classes[n] = np.array(members), prints, lists

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within RADIUS bits among the items of a length."""
        members, marks, lists = self.classes[n]
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        found = [np.empty(0, np.int64)]
        if len(members) <= FEW:
            seen = lists[0][blocks[:, 0]]
            for b in range(1, BLOCKS):
                seen |= lists[b][blocks[:, b]]
            at = np.flatnonzero(seen)
            here = prints[at]
            for k, mark in enumerate(marks):
                found.append(at[np.bitwise_count(here ^ mark) <= RADIUS] * len(members) + k)
            pairs = np.concatenate(found)
            return pairs // len(members), members[pairs % len(members)]
        for b, (edges, posted) in enumerate(lists):
            value = blocks[:, b]
            start = edges[value]
            size = edges[1:][value] - start
            at = np.flatnonzero(size)
            start, size = start[at], size[at]
            ends = np.cumsum(size)
            window = np.repeat(at, size)
            item = posted[np.arange(len(window)) + np.repeat(start - ends + size, size)]
            hit = np.bitwise_count(prints[window] ^ marks[item]) <= RADIUS
            found.append(window[hit] * len(members) + item[hit])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(members), members[pairs % len(members)]

    def similarity(self, window: np.ndarray, item: int) -> float:
        own, weights, other = self.sets[item], self.weights, self.other
        common = rest = 0.0
        for g in set(window.tolist()):
            if g in own:
                common += weights[g]
            else:
                rest += weights.get(g, other)
        return common / (self.totals[item] + rest)

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, items) of the near windows of one run of words."""
        lengths = sorted(self.classes)
        longest = lengths[-1]
        for at in range(0, len(words), PIECE):
            piece = words[at : at + PIECE + longest]
            sums = prefix_bits(pair_hashes(piece)) if len(piece) > 1 else None
            for n in lengths:
                if n == 1:
                    prints = fingerprints(np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1), 1)
                elif sums is None or len(sums) < n:
                    continue
                else:
                    prints = fingerprints(sums[n - 1 :] - sums[: len(sums) - n + 1], n - 1)
                found, items = self.near(prints[:PIECE], n)
                if len(found):
                    yield n, found + at, items

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the best window of each text and item."""
        near: dict[tuple[int, int], set[int]] = {}
        if not len(words) or not self.classes:
            return []
        for n, starts, items in self.windows(words):
            text = np.searchsorted(bounds, starts, "right") - 1
            inside = starts + n <= bounds[text + 1]
            for t, s, i in zip(text[inside].tolist(), starts[inside].tolist(), items[inside].tolist()):
                near.setdefault((t, i), set()).add(s - int(bounds[t]))
        sizes = np.diff(bounds)
        for t in np.flatnonzero((sizes > 0) & (sizes < max(self.classes))).tolist():  # shorter than some windows
            mark = np.array([simhash(words[bounds[t] : bounds[t + 1]])], np.uint64)
            for n in self.classes:
                if n > sizes[t]:
                    for i in self.near(mark, n)[1].tolist():
                        near.setdefault((t, i), set()).add(0)
        return self.verified(near, words, bounds)

    def verified(self, near: dict, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, int]]:
        out, shingled, at = [], {}, -1
        for (t, i), starts in sorted(near.items()):
            if t != at:
                at, shingled = t, {}
            n = self.lengths[i]
            k = min(n, SHINGLE)
            if k not in shingled:
                every = shingle_hashes(words[bounds[t] : bounds[t + 1]], k)
                place = np.minimum(np.searchsorted(self.shingles, every), len(self.shingles) - 1)
                shingled[k] = every, np.concatenate([[0], np.cumsum(self.shingles[place] == every)])
            every, known = shingled[k]
            size = n - k + 1
            slack = abs(n - grid_length(n)) + 1
            around = np.unique((np.array(sorted(starts))[:, None] + np.arange(-slack, slack + 1)).clip(0, len(every) - 1))
            around = around[known[np.minimum(around + size, len(every))] > known[around]]
            if len(around):
                first = self.best_window(every, around.tolist(), size, i)
                similarity = self.similarity(every[first : first + size], i)
                if similarity >= SIMILARITY:
                    out.append((t, i, similarity, first))
        return out

    def best_window(self, every: np.ndarray, starts: list[int], size: int, item: int) -> int:
        """The first of the windows most like an item; starts ascend. Windows that overlap share their sums."""
        own, weights, other, total = self.sets[item], self.weights, self.other, self.totals[item]
        base = starts[0]
        shingles = every[base : starts[-1] + size].tolist()
        inside: dict[int, int] = {}
        common = rest = 0.0
        low = high = 0  # the window that the sums hold
        best, at = -1.0, base
        for s in starts:
            s -= base
            if s >= high:
                inside, common, rest, low, high = {}, 0.0, 0.0, s, s
            while high < min(s + size, len(shingles)):
                g = shingles[high]
                high += 1
                inside[g] = n = inside.get(g, 0) + 1
                if n == 1:
                    if g in own:
                        common += weights[g]
                    else:
                        rest += weights.get(g, other)
            while low < s:
                g = shingles[low]
                low += 1
                inside[g] = n = inside[g] - 1
                if not n:
                    if g in own:
                        common -= weights[g]
                    else:
                        rest -= weights.get(g, other)
            similarity = common / (total + rest)
            if similarity > best + 1e-9:
                best, at = similarity, s + base
        return at


def _search(sent, name: str):
    """The index is built once in each worker. sent: a broadcast of what Items takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Items(*sent.value)
        index = _BUILT[name]
        for rows in batches:
            for at in range(0, rows.num_rows, 64):
                b = rows.slice(at, 64)
                texts = [(t or "").encode().lower() for t in b.column(b.num_columns - 1).to_pylist()]
                found = index.hits(*word_hashes_of(texts))
                if found:
                    take = pa.array([f[0] for f in found], pa.int64())
                    made = [
                        pa.array([index.ids[f[1]] for f in found]),
                        pa.array([f[2] for f in found], pa.float64()),
                        pa.array([f[3] for f in found], pa.int64()),
                        pa.array([index.lengths[f[1]] for f in found], pa.int64()),
                    ]
                    kept = [c.take(take) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=[f"c{k}" for k in range(len(kept) + 4)])

    return run


_BUILT: dict[str, Items] = {}


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, g): the distinct shingles of each item."""
    for b in batches:
        sets = [np.unique(shingle_hashes(word_hashes((t or "").encode().lower()), SHINGLE)) for t in b.column(1).to_pylist()]
        block = b.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
        yield pa.RecordBatch.from_arrays([block, pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["block", "g"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, h, item, similarity, word_start, n_words): the best window of each document and item; h tells the text."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    schema = f"`{key}` {kind}, h long, `{item}` {item_kind}, similarity double, word_start long, n_words long"
    rows = docs.select(key, F.xxhash64(text).alias("h"), text)
    blocks = max(1, -(-benchmark.count() // ITEMS))
    dealt = benchmark.select(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)).alias("block"), F.col(item).alias("item"), F.col(item_text).alias("body"))
    # a shingle that one item has needs no row
    every = dealt.select("block", "body").mapInArrow(_item_shingles, "block long, g long")
    shared = every.groupBy("g").agg(F.count("*").alias("n"), F.collect_set("block").alias("in")).where("n > 1")
    shared = checkpointed(shared.select("g", "n", F.explode("in").alias("block")))
    n_items = dealt.where(F.length(F.translate("body", SPACE, "")) > 0).count()
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        items = [tuple(r) for r in dealt.where(F.col("block") == k).select("item", "body").collect()]
        counts = {r.g % (1 << 64): r.n for r in shared.where(F.col("block") == k).collect()}
        sent = spark.sparkContext.broadcast((items, (n_items, counts)))  # ITEMS items at most
        found = rows.mapInArrow(_search(sent, uuid.uuid4().hex), schema)
        out = found if blocks == 1 else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit."""
    hits = contaminated(docs, benchmark, key, text).select(F.col(key).alias("k_"), F.col("h").alias("h_"))
    return without(docs, hits, key, F.xxhash64(text))
