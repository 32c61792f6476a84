"""Taint rules and the flows from sources to sinks, met in the middle.

Forward levels from all sources together and backward levels from all sinks give each node its least distance to either;
only nodes on a way that is short enough stay. In that part of the graph the sources search forward over half of the
way and the sinks backward over the other half, and they meet on nodes that are exactly half of the way off. So no
search goes to places from which no sink is reached, and none is deeper than half.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.operators import graph

#: Taint rules as (name, type of node, words in its name).
SOURCES = [
    ("function_parameter", "PARAMETER", ["*"]),
    ("http_request_data", "CALL_EXPRESSION", ["request.get", "request.post", "request.args", "request.form"]),
    ("user_input", "CALL_EXPRESSION", ["input", "raw_input", "stdin"]),
    ("file_read", "CALL_EXPRESSION", ["read", "open", "readlines"]),
]
SINKS = [
    ("sql_execution", "CALL_EXPRESSION", ["execute", "executemany", "raw", "query", "filter"]),
    ("command_execution", "CALL_EXPRESSION", ["system", "popen", "exec", "eval", "subprocess"]),
    ("file_write", "CALL_EXPRESSION", ["write", "writelines"]),
]
#: Edges that carry taint; nodes on the longest path; nodes up to which a path has a severity.
CARRIERS = ["DFG_FLOW", "CFG_NEXT", "TAINT_FLOW"]
LONGEST = 20
SEVERITIES = [("critical", 3), ("high", 6), ("medium", 10)]


def rule_of(kind: Column, name: Column, rules: list[tuple[str, str, list[str]]]) -> Column:
    """The first rule that fits a node: its type, and a word in its name whatever the case; parameters need no word. Else null."""
    out = F.when(F.lit(False), "")
    for rule, wanted, words in rules:
        fits = F.lit(wanted == "PARAMETER")
        for w in words:
            fits = fits | F.contains(F.lower(name), F.lit(w.lower()))
        out = out.when((kind == wanted) & fits, rule)
    return out


def severity(nodes: Column) -> Column:
    """Of a path by the number of its nodes."""
    out = F.when(F.lit(False), "")
    for word, most in SEVERITIES:
        out = out.when(nodes <= most, word)
    return out.otherwise("low")


def _both(a: Callable[[], DataFrame], b: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two searches that don't need each other, their jobs side by side."""
    with ThreadPoolExecutor(2) as pool:
        found = [pool.submit(f) for f in (a, b)]
        return found[0].result(), found[1].result()


def between(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_edges: int | None = None) -> DataFrame:
    """(src, dst): the edges on some way from a source to a sink, of so many edges at most."""
    e = edges.select("src", "dst").distinct()
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead, back = _both(lambda: graph.levels(e, sources, max_edges), lambda: graph.levels(turned, sinks, max_edges))
    met = e.join(ahead.select(F.col("node").alias("src"), F.col("depth").alias("ahead")), "src")
    met = met.join(back.select(F.col("node").alias("dst"), F.col("depth").alias("back")), "dst")
    if max_edges is not None:
        met = met.where(F.col("ahead") + 1 + F.col("back") <= max_edges)
    return met.select("src", "dst")


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_edges: int = LONGEST - 1) -> DataFrame:
    """(source, sink, depth): which sink (node) each source (node) reaches over edges (src, dst), and over how few; 0 if a source is a sink."""
    part = graph.cut(between(edges, sources, sinks, max_edges))
    half = (max_edges + 1) // 2
    turned = part.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    forward, backward = _both(lambda: graph.closure(part, sources, half), lambda: graph.closure(turned, sinks, max_edges - half))
    forward = forward.withColumnRenamed("start", "source")
    ends = sinks.select("node").distinct()
    near = forward.join(ends, "node").select("source", F.col("node").alias("sink"), "depth")
    backward = backward.select(F.col("start").alias("sink"), "node", F.col("depth").alias("rest"))
    far = forward.where(F.col("depth") == half).join(backward, "node").select("source", "sink", (F.col("depth") + F.col("rest")).alias("depth"))
    return near.unionByName(far).groupBy("source", "sink").agg(F.min("depth").alias("depth"))


def taint_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, sink, source_rule, sink_rule, depth, severity): the flows of nodes (node, type, name) by the default rules over edges (src, dst, type)."""
    by = lambda rules: rule_of(F.col("type"), F.col("name"), rules)
    roles = graph.cut(nodes.select("node", by(SOURCES).alias("source_rule"), by(SINKS).alias("sink_rule")).where("source_rule is not null or sink_rule is not null"))
    sources, sinks = roles.where("source_rule is not null"), roles.where("sink_rule is not null")
    found = flows(edges.where(F.col("type").isin(CARRIERS)), sources.select("node"), sinks.select("node"))
    named = found.join(sources.select(F.col("node").alias("source"), "source_rule"), "source").join(sinks.select(F.col("node").alias("sink"), "sink_rule"), "sink")
    return named.select("source", "sink", "source_rule", "sink_rule", "depth", severity(F.col("depth") + 1).alias("severity"))
