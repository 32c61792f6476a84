"""Searches over an edge list: closure, breadth-first paths, simple paths, cycles, fixpoints.

Each level of a search is a join of the frontier with the edges; the frontier is cut off from its history by a
written table every few levels, so plans stay short and lost executors cost one level. Limits on depth, file crossings
and paths for each source are part of the meaning; there is no limit on the work. Path searches over graphs of a
proven size (SMALL_GRAPH edges) don't need levels: the edges are broadcast and each source is searched in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltine.session import written

EVERY = 4


#: Edges up to which a graph is broadcast.
SMALL_GRAPH = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a written table: unlike a checkpoint it also forgets what the optimizer had inferred, which grows with every level."""
    return written(df, "level")


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): what each seed reaches over (src, dst), with the least depth, itself at 0."""
    edges = edges.select("src", "dst").distinct()
    found = seeds.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0))
    frontier, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): what any of the seeds reaches over (src, dst), with the least depth, the seeds at 0; a row for each node."""
    found = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def bfs_paths(
    edges: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    max_nodes: int = 50,
    max_paths: int = 100,
    max_hops: int | None = None,
    files: DataFrame | None = None,
    small: int | None = None,
) -> DataFrame:
    """(source, path, hops): paths of a first-in first-out search from each source to the targets.

    A target ends its path. Other nodes go on from the first arrival only, where arrivals are ordered by level, then
    by the edges' ord along the path; targets are met on every arrival. With files (node, file) and max_hops, states
    are (node, crossings): an edge to another known file is a crossing, and the last known file is carried along. Graphs of more
    than `small` edges (SMALL_GRAPH) are searched level by level, with the same result.
    """
    e = edges.select("src", "dst", F.col("ord").cast("long").alias("ord"))
    if files is not None:
        e = e.join(files.select(F.col("node").alias("dst"), F.col("file").alias("to_file")), "dst", "left")
    else:
        e = e.withColumn("to_file", F.lit(None).cast("string"))
    goal = targets.select(F.col("node").alias("dst")).distinct().withColumn("hit", F.lit(True))
    e = cut(e.join(goal, "dst", "left").select("src", "dst", "ord", "to_file", F.coalesce("hit", F.lit(False)).alias("hit")))
    start = sources.select(F.col("node").alias("source")).distinct()
    if files is not None:
        start = start.join(files.select(F.col("node").alias("source"), F.col("file").alias("file")), "source", "left")
    else:
        start = start.withColumn("file", F.lit(None).cast("string"))
    start = start.join(goal.withColumnRenamed("dst", "source"), "source", "left_anti")  # a target goes nowhere
    if e.count() <= (SMALL_GRAPH if small is None else small):
        return _queue_search(e, start, max_nodes, max_paths, max_hops)
    return _level_search(e, start, max_nodes, max_paths, max_hops)


def _queue_search(e: DataFrame, start: DataFrame, max_nodes: int, max_paths: int, max_hops: int | None) -> DataFrame:
    """The search with a queue, one source after the other in each task, over edges that are broadcast."""
    adjacent: dict = {}
    for r in e.orderBy("src", "ord", "dst").collect():  # SMALL_GRAPH at most
        adjacent.setdefault(r.src, []).append((r.dst, r.to_file, r.hit))
    sent = e.sparkSession.sparkContext.broadcast(adjacent)
    kind = dict(start.dtypes)["source"]

    def search(source, file) -> Iterator[tuple[list, int]]:
        seen, queue, found = {(source, 0)}, deque([((source,), 0, file)]), 0
        while queue:
            path, hops, last = queue.popleft()
            if len(path) >= max_nodes:
                continue
            for node, to_file, hit in sent.value.get(path[-1], ()):
                there = hops + (last is not None and to_file is not None and last != to_file)
                if node in path or (max_hops is not None and there > max_hops):
                    continue
                if hit:
                    yield [*path, node], there
                    found += 1
                    if found == max_paths:
                        return
                elif (node, there) not in seen:
                    seen.add((node, there))
                    queue.append(((*path, node), there, last if to_file is None else to_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.schema.field("source").type
            for source, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(search(source, file))
                made = [
                    pa.array([source] * len(found), node),
                    pa.array([p for p, _ in found], pa.list_(node)),
                    pa.array([h for _, h in found], pa.int32()),
                    pa.array(range(1, len(found) + 1), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["source", "path", "hops", "rank"])

    return start.select("source", "file").mapInArrow(run, f"source {kind}, path array<{kind}>, hops int, rank int")


def _level_search(e: DataFrame, start: DataFrame, max_nodes: int, max_paths: int, max_hops: int | None) -> DataFrame:
    """The same search, all sources level by level; a level is one job and one written table."""
    frontier = start.select(
        "source",
        F.col("source").alias("node"),
        F.array("source").alias("path"),
        F.array().cast("array<bigint>").alias("order"),
        F.lit(0).alias("hops"),
        "file",
    )
    seen = frontier.select("source", "node", "hops")
    out = []
    for level in range(1, max_nodes):
        step = frontier.join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        crosses = F.coalesce(F.col("file") != F.col("to_file"), F.lit(False)).cast("int")
        step = step.select(
            "source",
            F.col("dst").alias("node"),
            F.concat("path", F.array("dst")).alias("path"),
            F.concat("order", F.array("ord")).alias("order"),
            (F.col("hops") + crosses).alias("hops"),
            F.coalesce("to_file", "file").alias("file"),
            "hit",
        )
        if max_hops is not None:
            step = step.where(F.col("hops") <= max_hops)
        known = step.join(seen.withColumn("known", F.lit(True)), ["source", "node", "hops"], "left")
        first = F.row_number().over(Window.partitionBy("source", "node", "hops").orderBy("order", "path"))
        step = known.withColumn("first", first).where("hit or (known is null and first = 1)").drop("known", "first")
        step = cut(step.withColumn("level", F.lit(level)))
        if step.isEmpty():
            break
        out.append(step.where("hit").select("source", "path", "order", "hops", "level"))
        frontier = step.where("not hit").drop("hit", "level")
        seen = seen.unionByName(frontier.select("source", "node", "hops"))
        if level % EVERY == 0:
            seen = cut(seen.repartition("source", "node", "hops"))
    if not out:
        out = [frontier.where(F.lit(False)).select("source", "path", "order", "hops", F.lit(0).alias("level"))]
    rank = F.row_number().over(Window.partitionBy("source").orderBy("level", "order", "path"))
    found = reduce(DataFrame.unionByName, out).withColumn("rank", rank).where(F.col("rank") <= max_paths)
    return found.select("source", "path", "hops", "rank")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """(path, types): every path without a repeated node from a source to a target, of max_depth edges at most."""
    kind = F.col("type") if "type" in edges.columns else F.lit("edge")
    e = edges.select("src", "dst", kind.alias("type"))
    goal = targets.select(F.col("node").alias("end")).distinct()
    paths = sources.select(F.col("node").alias("end"), F.array("node").alias("path"), F.array().cast("array<string>").alias("types"))
    out = None
    for depth in range(1, max_depth + 1):
        paths = paths.join(e, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = paths.select(
            F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("type")).alias("types")
        )
        if depth % EVERY == 0:
            paths = cut(paths)
            if paths.isEmpty():
                break
        hits = paths.join(goal, "end", "left_semi").select("path", "types")
        out = hits if out is None else out.unionByName(hits)
    return out


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node): the nodes on a cycle or on a way between cycles: what stays when dead ends are taken off again and again."""
    left = edges.select("src", "dst").distinct()
    n = left.count()
    while True:
        left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            return left.select(F.col("src").alias("node")).distinct()
        n = now


def fixpoint_exports(exports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(module, name, origin): exports with those that wildcard re-exports (module, target) add until none is new.

    A name that a module already exports wins; of several new ones in a round the smallest origin.
    """
    known = exports.select("module", "name", "origin")
    links = cut(reexports.select("module", "target").distinct())
    new, level = known, 0
    while True:  # only names that came last can offer something new
        offered = links.join(new.select(F.col("module").alias("target"), "name", "origin"), "target").select("module", "name", "origin")
        offered = offered.groupBy("module", "name").agg(F.min("origin").alias("origin"))
        new = cut(offered.join(known, ["module", "name"], "left_anti"))
        if new.isEmpty():
            return known
        known, level = known.unionByName(new), level + 1
        if level % EVERY == 0:
            known = cut(known.repartition("module", "name"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )
