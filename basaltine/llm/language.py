"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. Each byte of a text is a position. Forward and
backward gated recurrent units of HIDDEN cells read the bytes; a softmax layer over both states labels every position
with a language; a document's probabilities are the means over all its positions. Gates use the hard sigmoid, so a
step costs few operations. Texts are read whole, in windows of WINDOW bytes whose states start at zero and which are
stacked, so that numpy takes one step for thousands of windows at once; a last shorter window is masked.

Examples for training are PER_LANGUAGE documents of each language at most, those with the smallest hash of their id, of
every language there is; the network sees BATCH windows from them in each of STEPS steps, drawn
with a fixed seed, languages in equal parts. The loss is the mean cross-entropy over all positions.

Null texts and texts without a letter get `und` and score 0. Null languages are not learnt. Ties go to the smaller
language name. Without any language to learn everything is `und`. Repeated rows are predicted alike; of repeated ids
with different languages or texts the smallest pair is learnt. Only key, text and language are read, so other columns
may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = 10
WINDOW = 128
PER_LANGUAGE = 300
BATCH, STEPS, RATE = 96, 400, 0.01
#: Windows that take a step together when documents are read.
STACK = 4096
LETTER = regex.compile(r"\p{L}")
f32 = np.float32


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid, in place."""
    x *= f32(0.2)
    x += f32(0.5)
    return np.clip(x, 0, 1, out=x)


class Network:
    """Parameters by name; suffix 0 reads forward, suffix 1 backward."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_out = hidden, n_out
        self.p: dict[str, np.ndarray] = {"V": rng.normal(0, 0.3, (2 * hidden, n_out)), "c": np.zeros(n_out)}
        for d in (0, 1):
            self.p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))  # what each byte adds to update, reset, candidate
            self.p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))
            self.p[f"W{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        self.p = {k: v.astype(f32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, d: int, tape: list | None = None, length: np.ndarray | None = None) -> np.ndarray:
        """States of direction d at every position of windows x, as (position, window, cell).

        length: of each window, if some are shorter; the backward reader starts at their end.
        """
        least = x.shape[1] if length is None or d == 0 else int(length.min())
        n, steps = x.shape
        h_n = self.hidden
        e, u, w = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"W{d}"]
        out = np.empty((steps, n, h_n), f32)
        h = np.zeros((n, h_n), f32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = e[x[:, t]]
            zr = _gate(a[:, : 2 * h_n] + h @ u)
            z, r = zr[:, :h_n], zr[:, h_n:]
            c = np.tanh(a[:, 2 * h_n :] + (r * h) @ w)
            new = h + z * (c - h)
            if tape is not None:
                tape.append((t, h, z, r, c))
            if t >= least:
                new[length <= t] = 0
            out[t] = h = new
        return out

    def probabilities(self, x: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """Of each language at every position, (position, window, language)."""
        v = self.p["V"]
        o = self.states(x, 0) @ v[: self.hidden] + self.states(x, 1, length=length) @ v[self.hidden :] + self.p["c"]
        o -= o.max(axis=2, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(axis=2, keepdims=True)
        return o

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients, by backpropagation through time."""
        n, steps = x.shape
        h_n, p = self.hidden, self.p
        tapes: list[list] = [[], []]
        hs = [self.states(x, d, tapes[d]) for d in (0, 1)]
        both = np.concatenate(hs, axis=2)
        o = both @ p["V"] + p["c"]
        o -= o.max(axis=2, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(axis=2, keepdims=True)
        at = np.arange(n)
        loss = -float(np.log(o[:, at, y] + 1e-12).mean())
        o[:, at, y] -= 1
        o /= n * steps
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"] = np.einsum("tnh,tnk->hk", both, o, optimize=True)
        g["c"] = o.sum(axis=(0, 1))
        dboth = o @ p["V"].T
        for d in (0, 1):
            e, u, w = f"E{d}", f"U{d}", f"W{d}"
            dh = np.zeros((n, h_n), f32)
            for t, h, z, r, c in reversed(tapes[d]):
                dh = dh + dboth[t][:, d * h_n : (d + 1) * h_n]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * (f32(0.2) * ((z > 0) & (z < 1)))
                drh = dc @ p[w].T
                dr = drh * h * (f32(0.2) * ((r > 0) & (r < 1)))
                dzr = np.concatenate([dz, dr], axis=1)
                np.add.at(g[e], x[:, t], np.concatenate([dzr, dc], axis=1))
                g[w] += (r * h).T @ dc
                g[u] += h.T @ dzr
                dh = dh * (1 - z) + drh * r + dzr @ p[u].T
        return loss, g


def train(texts: list[bytes], labels: np.ndarray, n_out: int, steps: int = STEPS, seed: int = 5) -> Network:
    """A network fitted to the texts by Adam. labels: 0 to n_out - 1, each found at least once."""
    net, rng = Network(n_out, seed=seed), np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in range(n_out)]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        y = rng.permutation(np.arange(BATCH) % n_out) if n_out <= BATCH else rng.integers(0, n_out, BATCH)
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for k, label in enumerate(y):
            raw = texts[rng.choice(by_label[label])]
            start = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
            part = (raw[start : start + WINDOW] * (WINDOW // max(1, len(raw)) + 1))[:WINDOW]  # short texts are repeated
            x[k] = np.frombuffer(part, np.uint8)
        _, g = net.gradients(x, y)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * f32(min(1.0, 1.0 / (norm + 1e-9)))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            net.p[k] = (net.p[k] - rate * move).astype(f32)
    return net


def read(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; zeros for empty ones."""
    total = np.zeros((len(texts), net.n_out))
    raw = np.frombuffer(b"".join([t + b" " * (-len(t) % WINDOW) for t in texts]), np.uint8)
    windows = raw.reshape(-1, WINDOW)
    n_windows = [-(-len(t) // WINDOW) for t in texts]
    owner = np.repeat(np.arange(len(texts)), n_windows)
    length = np.full(len(windows), WINDOW)
    last = np.cumsum(n_windows) - 1
    for k, t in enumerate(texts):
        if len(t) % WINDOW:
            length[last[k]] = len(t) % WINDOW
    for at in range(0, len(windows), STACK):
        p = net.probabilities(windows[at : at + STACK], length[at : at + STACK])
        p *= (np.arange(WINDOW)[:, None] < length[at : at + STACK][None, :])[:, :, None]
        np.add.at(total, owner[at : at + STACK], p.sum(axis=0))
    return total / np.maximum([[len(t)] for t in texts], 1) if texts else total


def examples(docs: DataFrame, key: str, text: str, lang: str, learn: Column) -> tuple[list[bytes], list[str]]:
    """The bounded sample of documents to learn from, with their languages."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & learn).select(key, lang)
    counts = known.groupBy(lang).agg(F.count("*").alias("n_"))
    place = F.xxhash64(key).cast("double") / float(1 << 64) + 0.5  # between 0 and 1, in the order of the hash
    few = known.join(F.broadcast(counts), lang).where(place <= F.lit(4.0 * PER_LANGUAGE) / F.col("n_"))  # so few rows are sorted
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(key), key))
    picked = few.withColumn("rank_", rank).where(F.col("rank_") <= PER_LANGUAGE)
    ids = F.broadcast(picked.select(F.col(key).alias("k_")).distinct())
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & learn).select(F.col(key).alias("k_"), F.struct(F.col(lang).alias("l"), F.col(text).alias("t")).alias("r"))
    rows = rows.join(ids, "k_").groupBy("k_").agg(F.min("r").alias("r")).collect()
    kept = [(r.r.t.encode(), r.r.l) for r in sorted(rows, key=lambda r: r.k_) if LETTER.search(r.r.t)]
    return [t for t, _ in kept], [x for _, x in kept]


def languages(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_pred, score), one row for each document. learn: which documents may be learnt from."""
    texts, known = examples(docs, key, text, lang, learn)
    names = sorted(set(known))
    net = train(texts, np.array([names.index(x) for x in known]), len(names)) if names else None
    sent = docs.sparkSession.sparkContext.broadcast((net, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names = sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                b = rows.slice(at, 256)
                texts = b.column(1).to_pylist()
                read_ = [k for k, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if read_:
                    p = read(net, [texts[k].encode() for k in read_])
                    for k, row in zip(read_, p):
                        best = int(row.argmax())
                        langs[k], scores[k] = names[best], min(1.0, float(row[best]))
                made = [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double")
