"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors become integers, floor(scale * component). Searched rows are dealt into tiles and so are the queries; a task gets one
tile of each. In it the rows are put in an order in which near ones are neighbours (halved again and again at the
median of the component that varies most) and cut into ranges, the blocks. A block has the maximum and the minimum of each
component and a forward index, its vectors. For a query the bound of a block is the sum of what each component could
give at most; blocks are visited in falling order of their bounds, scored through their forward indexes, and a query
is done when the next bound is below its k-th score so far. A bound that equals it is still visited: the row may have a
smaller id. The tiles' best k meet in one top-k for each query.

How many tiles there are follows from the bytes of both sides: neither side of a tile has more than TILE_BYTES, and
the number of query tiles times the rows' bytes plus the number of row tiles times the queries' bytes is what moves.
Nothing is collected or broadcast. Products are computed in floats only where a bound of all sums shows that they are
exact, else in whole numbers of any length; scores beyond 64 bits become the nearest that has 64.

Rows that are null or hold a null or non-finite component take no part, nor do rows with a null id. Missing components
of shorter vectors are zeros, an empty vector scores 0. Repeated rows (same id, same vector) count once; rows with one
id and different vectors are rows of their own, a query's own row is the one with its id and vector. Ties go to the
smaller id, then to the smaller vector's hash. An empty table gives an empty result. Further columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.llm.common import written

#: Rows of a block, queries that are searched together, and bytes of vectors of each side of a tile.
BLOCK, TOGETHER, TILE_BYTES = 128, 512, 32 << 20
#: Bytes of rows below which a tile is not made smaller for the sake of more tasks.
LEAST_BYTES = 256 << 10

FOUND = "query_id long, query_row long, vec_id long, row long, score long"


def similar_order(x: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which ranges of block rows are close together."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        part = x[rows[:: max(1, len(rows) // 512)]]
        spread = part.max(axis=0) - part.min(axis=0) if x.shape[1] else np.zeros(1)
        if len(rows) <= block or not spread.any():
            done.append(rows)
            continue
        values = x[rows, int(np.argmax(spread))]
        half = block * max(1, round(len(rows) / block / 2))
        near = np.argpartition(values, half) if half < len(rows) else np.arange(len(rows))
        todo += [rows[near[half:]], rows[near[:half]]]
    return np.concatenate(done) if done else np.arange(0)


class Blocks:
    """The rows of a tile: forward indexes of ranges, with the range's largest and smallest components."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        order = similar_order(x, block)
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.starts = np.arange(0, len(x), block)
        self.ends = np.minimum(self.starts + block, len(x))
        self.top = np.stack([self.x[a:b].max(axis=0) for a, b in zip(self.starts, self.ends)])
        self.low = np.stack([self.x[a:b].min(axis=0) for a, b in zip(self.starts, self.ends)])
        self.scored = self.could = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, blocks): the most that a row of the block could score."""
        return np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
        """(query's place, vec_id, row, score) of the k best rows of each query but its own."""
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth = np.full(len(q), -math.inf, dtype=bounds.dtype)
        best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, self.x.dtype))
        at, step = 0, 1
        active = np.arange(len(q))
        while len(active) and at < len(self.starts):
            wanted = order[active, at : at + step]
            needed = bounds[active[:, None], wanted] >= kth[active][:, None]
            active, wanted, needed = active[needed[:, 0]], wanted[needed[:, 0]], needed[needed[:, 0]]
            who, block = np.repeat(active, needed.sum(axis=1)), wanted[needed]
            by_block = np.argsort(block, kind="stable")
            who, block = who[by_block], block[by_block]
            new = [best]
            cuts = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)]) if len(block) else ():
                rows = slice(self.starts[block[a]], self.ends[block[a]])
                scores = q[who[a:b]] @ self.x[rows].T
                i, j = np.nonzero(scores >= kth[who[a:b]][:, None])
                ids, own_rows, askers = self.ids[rows][j], self.rows[rows][j], who[a:b][i]
                other = (ids != own[0][askers]) | (own_rows != own[1][askers])
                new.append((askers[other], ids[other], own_rows[other], scores[i, j][other]))
            self.scored += len(block)
            self.could += 0 if at else len(q) * len(self.starts)
            best = self._best(new, k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
            last = np.searchsorted(best[0], full, "right") - 1
            kth[full] = best[3][last]
            at, step = at + step, step * 2
        return best

    @staticmethod
    def _best(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
        """The first k of each query by falling score, rising id."""
        who, ids, rows, scores = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((rows, ids, -scores, who)) if scores.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], -scores[i], ids[i], rows[i])), dtype=np.int64)
        who = who[order]
        first = np.searchsorted(who, who, "left")
        order = order[np.arange(len(who)) - first < k]
        return parts_at(order, np.concatenate([p[0] for p in parts]), ids, rows, scores)


def parts_at(order: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(c[order] for c in columns)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as whole numbers, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """A type in which each sum of products of these vectors, in part or whole, is exact. Sums are at most the product of the norms."""
    if not q.size or not x.size:
        return np.float64
    most = [float(np.abs(m).astype(np.float64).max()) * math.sqrt(m.shape[1]) for m in (q, x)]
    most = most[0] * most[1] * 1.001
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _search(k: int, block: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        width = max(int(t.column("v").combine_chunks().value_lengths().to_numpy().max()) for t in (queries, rows))
        q, x = (_matrix(t.column("v"), width) for t in (queries, rows))
        kind = exact_type(q, x)
        ids, names = (rows.column(c).to_numpy() for c in ("id", "row"))
        blocks = Blocks(x.astype(kind), ids, names, block)
        q_ids, q_rows = (queries.column(c).to_numpy() for c in ("id", "row"))
        found = []
        for at in range(0, len(q), TOGETHER):
            part = slice(at, at + TOGETHER)
            who, vec, row, score = blocks.search(q[part].astype(kind), (q_ids[part], q_rows[part]), k)
            if kind is object:
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], np.int64)
            found.append((q_ids[part][who], q_rows[part][who], vec, row, score.astype(np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

    return run


def whole_numbers(vector: Column, scale: float) -> Column:
    """The vector's components as floor(scale * x); null if it is null or a component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.when(vector.isNotNull() & F.forall(wide, lambda x: F.coalesce(finite(x), F.lit(False))), F.transform(wide, lambda x: F.floor(x * scale)))


def tiles(row_bytes: int, query_bytes: int, tasks: int, tile_bytes: int = TILE_BYTES) -> tuple[int, int]:
    """(row tiles, query tiles): few enough to move little, many enough for memory and for the tasks that run at once."""
    rows = max(math.ceil(row_bytes / tile_bytes), min(tasks, row_bytes // LEAST_BYTES), 1)
    return rows, max(math.ceil(query_bytes / tile_bytes), 1)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = BLOCK, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query marks, the k rows with the highest inner products."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), whole_numbers(vectors[vector], scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    rows = written(rows.withColumn("row", F.xxhash64("v")), "top-k-rows")
    largest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    n, asked, width, most = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(largest)).first()
    kind, size = ("smallint", 2) if (most or 0) < 1 << 15 else ("bigint", 8)
    per_row = (width or 0) * size + 16
    many, asking = tiles(n * per_row, asked * per_row, int(spark.conf.get("spark.sql.shuffle.partitions")), tile_bytes)

    slim = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    mine = lambda of: F.pmod(F.xxhash64("id", "row", F.lit(of)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    searched = slim.select("id", "row", "v", mine(many).alias("a"), every(asking).alias("b"))
    asks = slim.where("asks").select("id", "row", "v", mine(asking).alias("b"), every(many).alias("a"))
    found = asks.groupBy("a", "b").cogroup(searched.groupBy("a", "b")).applyInArrow(_search(k, block), FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
