import random
import time
from collections import deque

import pytest

from basaltine.operators import graph
from basaltine.plans import graph_queries
from pyspark.sql import functions as F


def fifo(edges, source, targets, files, max_nodes, max_paths, max_hops):
    """A literal first-in first-out search."""
    adj = {}
    for s, d, o in sorted(edges, key=lambda e: e[2]):
        adj.setdefault(s, []).append(d)
    out, seen = [], {(source, 0)}
    queue = deque([([source], 0, files.get(source))])
    while queue and len(out) < max_paths:
        path, hops, last = queue.popleft()
        if path[-1] in targets:
            out.append(path)
            continue
        if len(path) >= max_nodes:
            continue
        for n in adj.get(path[-1], []):
            if n in path:
                continue
            f = files.get(n)
            h = hops + (1 if last and f and f != last else 0)
            if max_hops is not None and h > max_hops:
                continue
            if (n, h) not in seen or n in targets:
                seen.add((n, h))
                queue.append((path + [n], h, f or last))
    return [p for p in out if len(p) > 1]


def test_bfs_like_a_queue(spark, monkeypatch):
    rng = random.Random(3)
    for trial in range(2):
        n = 12
        edges = [(rng.randrange(n), rng.randrange(n), k) for k in range(26)]
        files = {k: str(k % 3) for k in range(n)}
        e = spark.createDataFrame(edges, "src long, dst long, ord long")
        f = spark.createDataFrame(list(files.items()), "node long, file string")
        node = lambda *x: spark.createDataFrame([(v,) for v in x], "node long")
        for hops, small in ((None, 0), (1, 0), (None, 1000), (1, 1000)):
            monkeypatch.setattr(graph, "SMALL_GRAPH", small)
            got = graph.bfs_paths(e, node(0, 1), node(7, 9), 8, 50, hops, f if hops is not None else None)
            mine = {s: [list(r.path) for r in sorted(rs, key=lambda r: r["rank"])] for s, rs in _by_source(got.collect()).items()}
            for s in (0, 1):
                assert mine.get(s, []) == fifo(edges, s, {7, 9}, files if hops is not None else {}, 8, 50, hops), (trial, hops, s)


@pytest.mark.parametrize("small", [0, 1000])
def test_bfs_on_a_chain_of_fifty(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    e = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("ord"))
    node = lambda *x: spark.createDataFrame([(v,) for v in x], "node long")
    began = time.monotonic()
    got = {r.source: list(r.path) for r in graph.bfs_paths(e, node(0, 1, 20), node(50)).collect()}
    assert got == {1: list(range(1, 51)), 20: list(range(20, 51))}  # from 0 it would be 51 nodes
    assert time.monotonic() - began < 60


def _by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


def test_target_is_not_expanded_and_gives_no_path_of_its_own(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 3, 1)], "src long, dst long, ord long")
    one, both = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(2,), (3,)], "node long")
    assert [r.path for r in graph.bfs_paths(e, one, both).collect()] == [[1, 2]]
    assert graph.bfs_paths(e, both, both).count() == 0


def test_closure_of_a_cycle_and_of_nothing(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    got = {(r.start, r.node, r.depth) for r in graph.closure(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 2)}
    assert graph.closure(e.where(F.lit(False)), spark.createDataFrame([(1,)], "node long")).count() == 1
    assert {r.node for r in graph.cycle_nodes(e.union(spark.createDataFrame([(3, 9)], "src long, dst long"))).collect()} == {1, 2, 3}
    assert graph.cycle_nodes(e.where("src = 1")).count() == 0


def test_own_export_wins_over_a_wildcard(spark):
    own = spark.createDataFrame([(1, "f", 1), (2, "g", 2), (3, "f", 3)], "module long, name string, origin long")
    wild = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "module long, target long")
    got = {(r.module, r.name): r.origin for r in graph.fixpoint_exports(own, wild).collect()}
    assert got == {(1, "f"): 1, (1, "g"): 2, (2, "g"): 2, (2, "f"): 3, (3, "f"): 3, (3, "g"): 2}


def test_path_queries_go_beyond_twelve_nodes(spark, tmp_path):
    """Against a literal search; this seed gives a path of 13 nodes."""
    rng = random.Random(12044)
    rows = [(k, rng.randrange(25)) for k in range(20)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    edges = [(r.src, r.dst, r.ord) for r in graph_queries.edges(spark, str(tmp_path)).collect()]
    files = {k: str(v % 5) for k, v in rows}
    sources, targets = [k for k, v in rows if v == 2], {k for k, v in rows if v == 7}
    longest = 0
    for query, file_of, max_paths, hops in ((graph_queries.graph_rule_paths, {}, 100, None), (graph_queries.graph_hop_budget, files, 200, 2)):
        got = _by_source(query(spark, str(tmp_path)).collect())
        for s in sources:
            mine = [[int(x) for x in r.path.split(">")] for r in sorted(got.get(s, []), key=lambda r: r["rank"])]
            assert mine == fifo(edges, s, targets, file_of, 50, max_paths, hops)
            longest = max([longest, *map(len, mine)])
    assert longest > 12
