"""Rules over a code graph: sources and sinks by pattern, guards, paths between them, slices.

Nodes are (node, ord, type, name, value, role, metadata, file, line, source_code, language), edges (src, dst, ord,
type). Rules are constants of the plan: which rules a node is a source, sink or sanitizer of is one projection of the
nodes, without a join. All rules are searched at once, on the graph whose nodes are (rule, node).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.functions.text import label_matches
from basaltine.operators.graph import bfs_paths
from basaltine.operators.rules import Catalog, Rule, downgraded

#: Names of parameters that count as sources.
SOURCE_NAMES = ["input", "user_input", "data", "payload", "body", "query", "params", "username", "password", "token", "auth", "user", "userid", "id"]
#: The edge types that a path pattern follows; the first pattern that is named in a rule's counts.
EDGE_TYPES = {
    "DFG_FLOW": ["DFG_FLOW", "TAINT_FLOW", "DFG_INTERP", "DFG_PARAM_PASS", "DFG_RET", "DFG_ATTR", "DATA_FLOW", "CALL_GRAPH", "DFG_TEMPLATE"],
    "TAINT_FLOW": ["TAINT_FLOW", "DFG_FLOW", "DFG_INTERP", "DFG_PARAM_PASS"],
    "CFG_NEXT": ["CFG_NEXT"],
    "ANY": ["DFG_FLOW", "TAINT_FLOW", "CFG_NEXT", "DFG_INTERP", "DFG_PARAM_PASS"],
    "OTHER": ["DFG_FLOW", "DFG_INTERP", "DFG_PARAM_PASS"],
}
SLICE = "rule_id string, pattern string, source string, sink string, path array<string>, rank int"


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def label() -> Column:
    return F.lower(F.coalesce(F.nullif("name", F.lit("")), F.col("node").cast("string")))


def holds(column: str, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(word.lower())), F.lit(False))


def is_source(pattern: str) -> Column:
    """Whether a node matches a source pattern. PARAMETER decides alone about parameters: a source by role or by its name."""
    parameter, subscript = F.col("type") == "PARAMETER", F.col("type") == "SUBSCRIPT"
    found = label_matches(label(), F.lit(pattern.lower())) | (subscript & F.contains(label(), F.lit(pattern.lower())))
    found = found | holds("value", pattern) | holds("metadata", pattern)
    if pattern in ("input", "user_input"):
        found = found | parameter
    if pattern == "PARAMETER":
        named = F.coalesce((F.col("role") == "source") | F.lower("name").isin(SOURCE_NAMES), F.lit(False))
        found = F.when(parameter, named).otherwise(found)
    return F.coalesce(found, F.lit(False))


#: Languages of a file by its end; none: rules for any language look at it.
LANGUAGE_OF = {".py": ["python"], ".js": ["javascript"], ".ts": ["typescript"], ".tsx": ["typescript", "javascript"], ".jsx": []}


def is_sink(pattern: str) -> Column:
    """Whether a node matches a sink pattern: by its label or type alone."""
    found = label_matches(label(), F.lit(pattern.lower()))
    found = found | ((F.col("type") == "SUBSCRIPT") & F.contains(label(), F.lit(pattern.lower())))
    if pattern == "PARAMETER":
        found = found | (F.col("type") == "PARAMETER")
    return F.coalesce(found, F.lit(False))


def is_sanitizer(rule: Rule) -> Column:
    """Whether a node is a sanitizer of a rule: by role, label or a part of its code; never, if the rule names none."""
    if not rule.sanitizers:
        return F.lit(False)
    named = any_of([label_matches(label(), F.lit(s.lower())) | holds("source_code", s) for s in rule.sanitizers])
    return F.coalesce(F.col("role") == "sanitizer", F.lit(False)) | named


def allowed(rule: Rule) -> Column:
    """Whether a rule looks at a node's language, which the end of its file tells, else its column; unknown ones pass.

    Typed markup (.tsx) is looked at for either script language, plain markup (.jsx) always.
    """
    if not rule.languages:
        return F.lit(True)
    wanted = {x.lower() for x in rule.languages}
    out, file, lang = None, F.lower("file"), F.lower("language")
    for end, any_of_these in LANGUAGE_OF.items():
        hit = F.endswith(file, F.lit(end))
        fits = F.lit(not any_of_these or bool(wanted & set(any_of_these)))
        out = F.when(hit, fits) if out is None else out.when(hit, fits)
    return out.otherwise(F.coalesce((lang == "") | lang.isin(sorted(wanted)), F.lit(True)))


def roles(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """(rule_id, is_source, is_sink, is_sanitizer) beside the nodes' columns, for each rule that a node plays a part in."""
    rows = []
    for r in catalog.rules.values():
        source, sink, clean = any_of([is_source(p) for p in r.sources]), any_of([is_sink(p) for p in r.sinks]), is_sanitizer(r)
        source, sink = source & allowed(r), sink & allowed(r)
        row = F.struct(F.lit(r.rule_id).alias("rule_id"), source.alias("is_source"), sink.alias("is_sink"), clean.alias("is_sanitizer"))
        rows.append(F.when(source | sink | clean, row))
    if not rows:
        return nodes.where(F.lit(False)).selectExpr("*", "'' AS rule_id", "false AS is_source", "false AS is_sink", "false AS is_sanitizer")
    return nodes.select("*", F.inline(F.array_compact(F.array(*rows))))


def guarded(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """(rule_id): the rules of which a required guard is anywhere in the graph."""
    rules = [r for r in catalog.rules.values() if r.required_guards]
    if not rules:
        return nodes.select(F.lit("").alias("rule_id")).where(F.lit(False))
    has = [F.coalesce(F.max(any_of([F.contains(label(), F.lit(g.lower())) | holds("source_code", g) for g in r.required_guards])), F.lit(False)) for r in rules]
    one = nodes.agg(*[h.alias(f"g{k}") for k, h in enumerate(has)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"g{k}").alias("found")) for k, r in enumerate(rules)]))).where("found").select("rule_id")


def edge_kind(pattern: str) -> str:
    return next((k for k in ("DFG_FLOW", "TAINT_FLOW", "CFG_NEXT") if k in pattern), "ANY" if pattern == "ANY" else "OTHER")


def paths(nodes: DataFrame, edges: DataFrame, catalog: Catalog, max_nodes: int = 50, max_paths: int = 100) -> DataFrame:
    """(rule_id, pattern, source, sink, path, rank): the paths of every rule and path pattern, max_paths for each of them."""
    played = roles(nodes, catalog).select("rule_id", F.col("node").cast("string").alias("node"), "ord", "is_source", "is_sink")
    wanted = [
        (r.rule_id, p, t, "AND NOT exists" in p and bool(r.required_guards))
        for r in catalog.rules.values()
        for p in r.patterns
        if not p.startswith(("CALL(", "ASSIGNMENT(", "LITERAL("))
        for t in EDGE_TYPES[edge_kind(p)]
    ]
    spark = nodes.sparkSession
    asked = spark.createDataFrame(wanted, "rule_id string, pattern string, type string, asks boolean")
    asked = asked.join(guarded(nodes, catalog).withColumn("has", F.lit(True)), "rule_id", "left").where("not (asks and coalesce(has, false))")
    both = played.groupBy("rule_id").agg(F.bool_or("is_source").alias("a"), F.bool_or("is_sink").alias("b")).where("a and b")
    asked = asked.join(both.select("rule_id"), "rule_id", "left_semi").select("rule_id", "pattern", "type")
    space = F.concat_ws("\x1f", "rule_id", "pattern")  # each rule and pattern searches a graph of its own
    name = lambda c: F.concat_ws("\x1f", space, F.col(c).cast("string"))
    e = edges.join(F.broadcast(asked), "type").select(name("src").alias("src"), name("dst").alias("dst"), "ord")
    ends = played.join(F.broadcast(asked.select("rule_id", "pattern").distinct()), "rule_id")
    found = bfs_paths(e, ends.where("is_source").select(name("node").alias("node")), ends.where("is_sink").select(name("node").alias("node")), max_nodes, max_paths)
    parts = F.split("source", "\x1f")
    bare = F.transform("path", lambda x: F.element_at(F.split(x, "\x1f"), -1))
    out = found.select(parts[0].alias("rule_id"), parts[1].alias("pattern"), parts[2].alias("source"), bare.alias("path"), "rank")
    out = out.withColumn("sink", F.element_at("path", -1))
    first = played.where("is_source").select("rule_id", F.col("node").alias("source"), "ord")
    order = F.row_number().over(_window("rule_id", "pattern", "ord", "source", "rank"))
    out = out.join(first, ["rule_id", "source"]).withColumn("nth", order).where(F.col("nth") <= max_paths)
    return out.select("rule_id", "pattern", "source", "sink", "path", F.col("nth").alias("rank"))


def _window(rule: str, pattern: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(rule, pattern).orderBy(*order)


def slices(nodes: DataFrame, edges: DataFrame, catalog: Catalog, max_nodes: int = 50, max_paths: int = 100) -> DataFrame:
    """The paths with what a finding needs: lines, labels, sanitizers on the way, severity, confidence and the reason."""
    p = paths(nodes, edges, catalog, max_nodes, max_paths)
    keys = ["rule_id", "pattern", "rank"]
    steps = p.select(*keys, F.posexplode("path").alias("pos", "node"), F.size("path").alias("length"))
    facts = nodes.select(F.col("node").cast("string").alias("node"), "name", "file", "line")
    clean = roles(nodes, catalog).where("is_sanitizer").select("rule_id", F.col("node").cast("string").alias("node"), F.lit(1).alias("clean"))
    steps = steps.join(facts, "node").join(clean, ["rule_id", "node"], "left")
    shown = F.coalesce(F.nullif("name", F.lit("")), "node")
    head, tail = F.col("pos") == 0, F.col("pos") == F.col("length") - 1
    facts = steps.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("line") > 0, F.col("line"))), F.lit(1)).alias("start_line"),
        F.coalesce(F.max(F.when(F.col("line") > 0, F.col("line"))), F.lit(1)).alias("end_line"),
        F.count("clean").alias("sanitizers"),
        F.max(F.when(head, shown)).alias("source_label"),
        F.max(F.when(tail, shown)).alias("sink_label"),
        F.coalesce(F.max(F.when(head, F.nullif("file", F.lit("")))), F.max(F.when(tail, F.nullif("file", F.lit("")))), F.lit("input")).alias("file"),
    )
    spark = nodes.sparkSession
    rules = [(r.rule_id, r.name, r.owasp, r.cwe, r.severity, r.confidence) for r in catalog.rules.values()]
    known = spark.createDataFrame(rules, "rule_id string, rule_name string, owasp string, cwe string, severity string, confidence string")
    out = p.join(facts, keys).join(F.broadcast(known), "rule_id")
    severity, confidence = downgraded(F.col("severity"), F.col("confidence"), F.col("sanitizers") > 0, F.lit("violation"))
    reason = F.format_string("Potential %s: User input from '%s' flows to dangerous sink '%s' via %s without sanitization.", "rule_name", "source_label", "sink_label", "pattern")
    noted = F.when(F.col("sanitizers") > 0, F.format_string(" Sanitizers observed: %d.", "sanitizers")).otherwise("")
    return out.withColumns({"reason": F.concat(reason, noted), "new_severity": severity, "new_confidence": confidence}).select(
        "rule_id", "rule_name", "owasp", "cwe", "pattern", "rank", "source", "sink", "path", "file", "start_line", "end_line", "source_label", "sink_label",
        "sanitizers", F.col("new_severity").alias("severity"), F.col("new_confidence").alias("confidence"), "reason",
    )


def execute(nodes: DataFrame, edges: DataFrame, files: DataFrame, catalog: Catalog, path: str = "file", text: str = "content") -> DataFrame:
    """(rule_id, pattern, file, start_line, end_line, sink_label, length, severity, confidence): findings of paths and texts.

    Of findings of one rule, sink and place the strongest stays: data flow, then confidence, severity and the shorter path.
    Rules without a source or a sink in the graph have findings in texts only, and all of those stay.
    """
    from basaltine.operators.dedupe import best_per_key
    from basaltine.operators.rules import scan

    found = slices(nodes, edges, catalog).select(
        "rule_id", "pattern", "file", "start_line", "end_line", "sink_label", F.size("path").alias("length"), "severity", "confidence"
    )
    line = F.col("first_line").cast("int")
    in_text = scan(files.select(path, text), catalog, text).select(
        "rule_id", F.lit("REGEX").alias("pattern"), F.col(path).alias("file"), line.alias("start_line"), line.alias("end_line"), "sink_label",
        F.lit(0).alias("length"), "severity", "confidence",
    )
    played = roles(nodes, catalog).groupBy("rule_id").agg(F.bool_or("is_source").alias("a"), F.bool_or("is_sink").alias("b"))
    both = F.broadcast(played.where("a and b").select("rule_id"))  # rules, as many as the catalog has
    alone = in_text.join(both, "rule_id", "left_anti")
    strength = lambda c, *names: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.lower(c)), F.lit(0))
    order = [
        F.desc(F.contains("pattern", F.lit("DFG_FLOW"))),
        F.desc(strength("confidence", "low", "medium", "high")),
        F.desc(strength("severity", "low", "medium", "high", "critical")),
        F.asc("length"),
        F.asc("pattern"),
    ]
    met = found.unionByName(in_text.join(both, "rule_id", "left_semi"))
    return best_per_key(met, ["rule_id", "sink_label", "file", "start_line", "end_line"], order).unionByName(alone)
