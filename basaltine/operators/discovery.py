"""Path discovery: flows from any rule's sources to any rule's sinks, scored, attributed and cut to the best.

Nodes are (node, ord, type, name, role, scope, file, line, source_code), edges (src, dst, ord, type). Which rules own a
node is one projection with the patterns as constants; the search counts file crossings; scores come from one aggregation
over the paths' nodes and one over their edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltine.functions import scoring
from basaltine.functions.text import label_matches
from basaltine.operators.execution import any_of, holds, label
from basaltine.operators.graph import bfs_paths
from basaltine.operators.rules import Catalog

#: The edge types that a path may use; limits of a search and of its result.
FOLLOWED = ["DFG_FLOW", "DFG_PARAM_PASS", "DFG_RET", "DFG_INTERP", "DFG_TEMPLATE", "TAINT_FLOW", "DATA_FLOW", "CALL_GRAPH", "AUTH_COVERAGE", "HTTP_ROUTE"]
MAX_NODES, MAX_PATHS, MAX_HOPS, THRESHOLD, BEST = 50, 200, 2, 0.35, 200
UNKNOWN = ("PATH_DISCOVERY", "Unclassified Data-Flow Finding")


def owners(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """nodes with source_rules and sink_rules, the sorted ids of the rules that name them, and is_source, is_sink."""

    def rules(words: dict[str, list[str]]):
        named = [F.when(any_of([label_matches(label(), F.lit(w.lower())) for w in ws]), F.lit(k)) for k, ws in words.items() if ws]
        return F.array_sort(F.array_compact(F.array(*named))) if named else F.array().cast("array<string>")

    out = nodes.withColumns(
        {"source_rules": rules({r.rule_id: r.sources for r in catalog.rules.values()}), "sink_rules": rules({r.rule_id: r.sinks for r in catalog.rules.values()})}
    )
    role = F.coalesce("role", F.lit(""))
    return out.withColumns({"is_source": (F.size("source_rules") > 0) | (role == "source"), "is_sink": (F.size("sink_rules") > 0) | (role == "sink")})


def features(paths: DataFrame, nodes: DataFrame, edges: DataFrame, sanitizers: list[str]) -> DataFrame:
    """(id, length, crossings, explicit, heuristic, calls, routes, covered, start_line, end_line, file) of paths (id, path).

    Crossings are the different files less one and the different scopes less one; a missing file counts as one, a missing
    scope doesn't. A node is an explicit sanitizer by its role, else a heuristic one by its label or code.
    """
    heuristic = any_of([label_matches(label(), F.lit(s.lower())) | holds("source_code", s) for s in sanitizers if s])
    explicit = F.coalesce(F.col("role") == "sanitizer", F.lit(False))
    facts = nodes.select(
        "node", F.coalesce("file", F.lit("\x00")).alias("f"), F.nullif("scope", F.lit("")).alias("scope"), F.when(F.col("line") > 0, F.col("line")).alias("line"),
        explicit.alias("explicit"), (~explicit & heuristic).alias("heuristic"),
    )
    steps = paths.select("id", F.posexplode("path").alias("pos", "node"), F.size("path").alias("length")).join(facts, "node")
    by_node = steps.groupBy("id", "length").agg(
        (F.greatest(F.count_distinct("f") - 1, F.lit(0)) + F.greatest(F.count_distinct("scope") - 1, F.lit(0))).alias("crossings"),
        F.count_if("explicit").alias("explicit"),
        F.count_if("heuristic").alias("heuristic"),
        F.coalesce(F.min("line"), F.lit(1)).alias("start_line"),
        F.coalesce(F.max("line"), F.lit(1)).alias("end_line"),
        F.nullif(F.min_by("f", "pos"), F.lit("\x00")).alias("file"),
    )
    nxt = F.lead("node").over(Window.partitionBy("id").orderBy("pos"))
    pairs = paths.select("id", F.posexplode("path").alias("pos", "node")).withColumn("dst", nxt).where("dst is not null").withColumnRenamed("node", "src")
    met = pairs.join(edges.select("src", "dst", "type"), ["src", "dst"])
    by_edge = met.groupBy("id").agg(
        F.count_if(F.col("type") == "CALL_GRAPH").alias("calls"), F.count_if(F.col("type") == "HTTP_ROUTE").alias("routes"), F.count_if(F.col("type") == "AUTH_COVERAGE").alias("covered")
    )
    return by_node.join(by_edge, "id", "left").fillna(0, ["calls", "routes", "covered"])


def discover(nodes: DataFrame, edges: DataFrame, catalog: Catalog, threshold: float = THRESHOLD, best: int = BEST) -> DataFrame:
    """(source, sink, path, hops, score, severity, rule_id, rule_name, ...): the best paths, the most likely first."""
    owned = owners(nodes, catalog)
    files = nodes.where("file is not null").select("node", "file")
    e = edges.where(F.col("type").isin(FOLLOWED)).select("src", "dst", "ord")
    found = bfs_paths(e, owned.where("is_source").select("node"), owned.where("is_sink").select("node"), MAX_NODES, MAX_PATHS, MAX_HOPS, files)
    found = found.select(F.concat_ws("\x1f", F.col("source").cast("string"), "rank").alias("id"), "source", F.element_at("path", -1).alias("sink"), "path", "hops", "rank")
    words = sorted({s for r in catalog.rules.values() for s in r.sanitizers})
    out = found.join(features(found.select("id", "path"), nodes, edges, words), "id")
    start = owned.select(F.col("node").alias("source"), "source_rules", F.col("name").alias("source_label"), F.col("ord").alias("s_ord"))
    end = owned.select(F.col("node").alias("sink"), "sink_rules", F.col("name").alias("sink_label"), F.col("type").alias("sink_type"), F.col("role").alias("sink_role"))
    out = out.join(start, "source").join(end, "sink")
    exposed = F.col("sink_type").isin("HTTP_ENDPOINT", "HTTP_RESPONSE") | F.coalesce(F.col("sink_role") == "sink", F.lit(False))
    score = scoring.path_score(F.col("length"), F.col("crossings"), F.col("explicit"), F.col("heuristic"), scoring.auth_gap(F.col("covered") > 0, exposed))
    out = out.withColumn("score", score).where(F.col("score") >= threshold)
    out = out.orderBy(F.desc(F.round("score", 9)), "s_ord", "rank").limit(best)
    known = [(r.rule_id, r.name, r.owasp, r.cwe) for r in catalog.rules.values()]
    rules = nodes.sparkSession.createDataFrame(known, "rule_id string, rule_name string, owasp string, cwe string")
    shared = F.get(F.array_sort(F.array_intersect("source_rules", "sink_rules")), 0)
    out = out.withColumn("rule_id", shared).join(F.broadcast(rules), "rule_id", "left")
    return out.select(
        F.coalesce("rule_id", F.lit(UNKNOWN[0])).alias("rule_id"),
        F.coalesce("rule_name", F.lit(UNKNOWN[1])).alias("rule_name"),
        "owasp", "cwe", "source", "sink", "path", "hops", "score", scoring.score_severity(F.col("score")).alias("severity"), F.lit("medium").alias("confidence"),
        "file", "start_line", "end_line", "crossings", "explicit", "heuristic", "calls", "routes", "covered", "source_label", "sink_label",
    )


def path_snippets(found: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, context: int = 3) -> DataFrame:
    """found with snippet: the path's nodes, its edges' types, and a numbered block for each file with three lines around.

    files: (file, content). Files go by their first place on the path; files without text have an empty block.
    """
    paths = found.select(F.xxhash64("path", "source").alias("id"), "path").dropDuplicates(["id"])
    steps = paths.select("id", F.posexplode("path").alias("pos", "node")).join(nodes.select("node", "name", "file", "line"), "node")
    shown = F.coalesce(F.nullif("name", F.lit("")), F.col("node").cast("string"))
    heads = steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("n")))), lambda x: x["n"]), " -> ").alias("names"))
    pairs = paths.select("id", F.posexplode("path").alias("pos", "src")).withColumn("dst", F.lead("src").over(Window.partitionBy("id").orderBy("pos"))).where("dst is not null")
    typed = pairs.join(edges.select("src", "dst", "type"), ["src", "dst"], "left").groupBy("id", "pos").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("t"))
    typed = typed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("t") == "", "unknown").otherwise(F.col("t")).alias("t")))), lambda x: x["t"]).alias("types"))
    blocks = steps.where("file is not null and line > 0").groupBy("id", "file").agg(F.min("pos").alias("pos"), F.collect_set("line").alias("marked"))
    blocks = blocks.join(files.select("file", F.split("content", "\n", -1).alias("rows")), "file", "left")
    low, high = F.greatest(F.lit(1), F.array_min("marked") - context), F.least(F.size("rows"), F.array_max("marked") + context)
    mark = lambda i: F.when(F.array_contains("marked", i), ">>> ").otherwise("    ")
    lines = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: F.format_string("%s%4d | %s", mark(i), i, F.get("rows", i - 1))))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("FILE: "), "file")), F.coalesce(lines, F.array().cast("array<string>"))), "\n")
    body = blocks.select("id", "pos", block.alias("b")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n\n").alias("body"))
    whole = F.concat(F.lit("PATH NODES:\n"), "names", F.lit("\nPATH EDGES:\n"), F.array_join("types", " -> "), F.lit("\n\n"), "body")
    text = heads.join(typed, "id", "left").join(body, "id", "left").select("id", F.coalesce(whole, F.lit("")).alias("snippet"))
    return found.withColumn("id", F.xxhash64("path", "source")).join(text, "id", "left").drop("id")
