"""Rules executed on a graph: nodes and flows are derived from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators import discovery, execution
from basaltine.operators.rules import Catalog, Rule
from basaltine.plans.graph_queries import CROSSED, EDGES_SQL, edges, paths_sql
from basaltine.plans.registry import query
from basaltine.session import table

KINDS = ["CALL_EXPRESSION", "IDENTIFIER", "PARAMETER", "SUBSCRIPT", "LITERAL"]
CATALOG = Catalog(
    [
        Rule("FLOW", "Flow", severity="critical", confidence="high", sources=["n2"], sinks=["n7", "n8.call_1"], sanitizers=["call_3"], patterns=["DFG_FLOW"]),
        Rule("GUARDED", "Guarded", sources=["n2"], sinks=["n7"], required_guards=["n9.call"], patterns=["DFG_FLOW AND NOT exists(auth)"]),
        Rule("PARAM", "Parameter", severity="low", sources=["PARAMETER"], sinks=["n11"], languages=["python"], patterns=["CFG_NEXT"]),
        Rule("NO_SINK", "No sink", sources=["n2"], sinks=["nowhere"], patterns=["ANY"]),
    ]
)
NODES_SQL = """nodes AS (SELECT s_suppkey AS node, ['CALL_EXPRESSION', 'IDENTIFIER', 'PARAMETER', 'SUBSCRIPT', 'LITERAL'][1 + s_suppkey % 5] AS type,
'n' || s_nationkey || '.call_' || s_suppkey % 4 AS name, 'f' || s_nationkey % 3 || ['.py', '.tsx', '.JSX', '.txt'][1 + s_suppkey % 4] AS file, 1 + s_suppkey % 50 AS line,
CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE s_suppkey % 3 <> 1 END AS ok, CASE WHEN s_suppkey % 3 = 0 THEN 'python' WHEN s_suppkey % 3 = 1 THEN 'go' END AS language, CASE WHEN s_suppkey % 11 = 0 THEN 'source' END AS role FROM supplier)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    third = key % 3
    return table(spark, sf_dir, "supplier").select(
        key.alias("node"),
        key.alias("ord"),
        F.get(F.array(*[F.lit(k) for k in KINDS]), (key % 5).cast("int")).alias("type"),
        F.concat(F.lit("n"), nation.cast("string"), F.lit(".call_"), (key % 4).cast("string")).alias("name"),
        F.lit(None).cast("string").alias("value"),
        F.when(key % 11 == 0, "source").alias("role"),
        F.lit(None).cast("string").alias("metadata"),
        F.concat(F.lit("f"), (nation % 3).cast("string"), F.get(F.array(*map(F.lit, (".py", ".tsx", ".JSX", ".txt"))), (key % 4).cast("int"))).alias("file"),
        (key % 50 + 1).cast("int").alias("line"),
        F.lit(None).cast("string").alias("source_code"),
        F.when(third == 0, "python").when(third == 1, "go").alias("language"),
    )


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("type", F.when(F.col("ord") == 0, "DFG_PARAM_PASS").otherwise("CFG_NEXT"))


TOKENS_SQL = "tok AS (SELECT *, regexp_split_to_array(name, '[^a-z0-9_]+') AS t FROM nodes)"


@query(
    "rule_resolution",
    f"""WITH {NODES_SQL}, {TOKENS_SQL}, roles AS (SELECT 'FLOW' AS rule_id, node, list_contains(t, 'n2') OR (type = 'SUBSCRIPT' AND contains(name, 'n2')) AS src,
    list_contains(t, 'n7') OR contains(name, 'n8.call_1') OR (type = 'SUBSCRIPT' AND contains(name, 'n7')) AS snk, list_contains(t, 'call_3') AS clean FROM tok
    UNION ALL SELECT 'GUARDED', node, list_contains(t, 'n2') OR (type = 'SUBSCRIPT' AND contains(name, 'n2')), list_contains(t, 'n7') OR (type = 'SUBSCRIPT' AND contains(name, 'n7')), false FROM tok
    UNION ALL SELECT 'PARAM', node, type = 'PARAMETER' AND coalesce(role = 'source', false) AND ok,
    (list_contains(t, 'n11') OR (type = 'SUBSCRIPT' AND contains(name, 'n11'))) AND ok, false FROM tok
    UNION ALL SELECT 'NO_SINK', node, list_contains(t, 'n2') OR (type = 'SUBSCRIPT' AND contains(name, 'n2')), false, false FROM tok)
    SELECT rule_id, node, src AS is_source, snk AS is_sink, clean AS is_sanitizer FROM roles WHERE src OR snk OR clean""",
)
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution.roles(nodes(spark, sf_dir), CATALOG).select("rule_id", "node", "is_source", "is_sink", "is_sanitizer")


@query(
    "rule_guards",
    f"WITH {NODES_SQL} SELECT 'GUARDED' AS rule_id FROM nodes WHERE contains(name, 'n9.call') HAVING count(*) > 0",
)
def rule_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution.guarded(nodes(spark, sf_dir), CATALOG)


def slices_sql() -> str:
    """Rule FLOW over data flow edges and rule PARAM over control flow edges; each source's search, then the rule's 100 first paths."""
    source = "(list_contains(t, 'n2') OR (type = 'SUBSCRIPT' AND contains(name, 'n2')))"
    sink = "(list_contains(t, 'n7') OR contains(name, 'n8.call_1') OR (type = 'SUBSCRIPT' AND contains(name, 'n7')))"
    return f"""WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, {TOKENS_SQL},
    ends AS (SELECT 'FLOW' AS rule_id, node, {source} AS src, {sink} AS snk FROM tok
    UNION ALL SELECT 'PARAM', node, type = 'PARAMETER' AND coalesce(role = 'source', false) AND ok,
    (list_contains(t, 'n11') OR (type = 'SUBSCRIPT' AND contains(name, 'n11'))) AND ok FROM tok),
    g AS (SELECT 'FLOW' AS rule_id, src, dst FROM edges WHERE ord = 0 UNION ALL SELECT 'PARAM', src, dst FROM edges WHERE ord = 1),
    t(rule_id, source, node, path) USING KEY (rule_id, source, node) AS (
    SELECT rule_id, node, node, [node] FROM ends WHERE src AND NOT snk UNION SELECT t.rule_id, t.source, g.dst, list_append(t.path, g.dst)
    FROM t JOIN g ON g.rule_id = t.rule_id AND g.src = t.node JOIN ends x ON x.rule_id = t.rule_id AND x.node = g.dst
    WHERE len(t.path) < 50 AND NOT x.snk AND NOT list_contains(t.path, g.dst)
    AND NOT EXISTS (SELECT 1 FROM recurring.t r WHERE r.rule_id = t.rule_id AND r.source = t.source AND r.node = g.dst)),
    found AS (SELECT t.rule_id, t.source, g.dst AS sink, list_append(t.path, g.dst) AS path FROM t JOIN g ON g.rule_id = t.rule_id AND g.src = t.node
    JOIN ends x ON x.rule_id = t.rule_id AND x.node = g.dst WHERE len(t.path) < 50 AND x.snk AND NOT list_contains(t.path, g.dst)),
    p AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY source, len(path)) AS rank FROM found),
    l AS (SELECT rule_id, rank, min(n.line) AS start_line, max(n.line) AS end_line, count(*) FILTER (rule_id = 'FLOW' AND list_contains(t, 'call_3')) AS sanitizers
    FROM (SELECT rule_id, rank, unnest(path) AS node FROM p) s JOIN tok n ON n.node = s.node GROUP BY ALL)
    SELECT p.rule_id, array_to_string(p.path, '>') AS path, CAST(rank AS INT) AS rank, a.file, start_line, end_line, a.name AS source_label, b.name AS sink_label, sanitizers,
    CASE WHEN p.rule_id = 'FLOW' AND sanitizers > 0 THEN 'medium' WHEN p.rule_id = 'FLOW' THEN 'critical' ELSE 'low' END AS severity,
    CASE WHEN sanitizers > 0 THEN 'low' WHEN p.rule_id = 'FLOW' THEN 'high' ELSE 'medium' END AS confidence
    FROM p JOIN l USING (rule_id, rank) JOIN nodes a ON a.node = p.source JOIN nodes b ON b.node = p.sink WHERE rank <= 100"""


@query("rule_slices", slices_sql())
def rule_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execution.slices(nodes(spark, sf_dir), typed_edges(spark, sf_dir), CATALOG)
    return out.select(
        "rule_id", F.array_join("path", ">").alias("path"), "rank", "file", F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"), "source_label", "sink_label", "sanitizers", "severity", "confidence",
    )


DISCOVERED = Catalog([Rule("FLOW", "Flow", "A03", "CWE-20", sources=["n2"], sinks=["n7"])])
DISCOVERY_SQL = f"""WITH p AS ({paths_sql(CROSSED, "coalesce(f.file, t.file)", "source, path, hops, rank", f"{CROSSED} <= 2", 200)}),
s AS (SELECT source, path, hops, rank, string_split(path, '>') AS l FROM p),
c AS (SELECT source, rank, count(DISTINCT s_nationkey % 5) - 1 AS crossings FROM (SELECT source, rank, unnest(l) AS node FROM s) x JOIN supplier ON s_suppkey = CAST(node AS BIGINT) GROUP BY ALL),
z AS (SELECT s.source, path, hops, rank, crossings, 0.35::DOUBLE / (1 + len(l)) + 0.25::DOUBLE / len(l) + 0.2::DOUBLE * least(1.0::DOUBLE, crossings * 0.2::DOUBLE) + 0.1::DOUBLE + 0.1::DOUBLE * 0.5 AS score FROM s JOIN c USING (source, rank))
SELECT 'FLOW' AS rule_id, source, path, hops, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS severity, crossings
FROM z WHERE score >= 0.2 ORDER BY round(score, 9) DESC, source, rank LIMIT 200"""


@query("path_discovery", DISCOVERY_SQL)
def path_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).withColumn("scope", F.lit(None).cast("string")).withColumn("role", F.lit(None).cast("string"))
    n = n.withColumn("file", (F.regexp_extract("name", r"^n(\d+)", 1).cast("int") % 5).cast("string"))
    found = discovery.discover(n, edges(spark, sf_dir).withColumn("type", F.lit("DFG_FLOW")), DISCOVERED, threshold=0.2)
    return found.select("rule_id", "source", F.array_join("path", ">").alias("path"), "hops", F.round("score", 6).alias("score"), "severity", "crossings")
