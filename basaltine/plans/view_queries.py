"""Views, figures and registers over tables that are derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators import verdicts, views
from basaltine.plans.registry import query
from basaltine.session import table

NODE_KINDS, EDGE_KINDS = ["AST", "CFG", None, "AST"], ["AST", "CHILD", "CFG", "CONTROL_FLOW", "DFG", "DFG_TEMPLATE", None, "OTHER"]
GRAPH_SQL = """n AS (SELECT p_partkey AS node, ['AST', 'CFG', NULL, 'AST'][CAST(p_size % 4 AS INT) + 1] AS node_type FROM part WHERE p_size % 9 <> 8),
e AS (SELECT p_partkey AS src, p_partkey + 1 + p_size % 3 AS dst, ['AST', 'CHILD', 'CFG', 'CONTROL_FLOW', 'DFG', 'DFG_TEMPLATE', NULL, 'OTHER'][CAST(p_partkey % 8 AS INT) + 1] AS edge_type FROM part)"""


def _pick(kinds: list[str | None], n):
    return F.get(F.array(*[F.lit(k).cast("string") for k in kinds]), n.cast("int"))


@query(
    "graph_views",
    f"""WITH {GRAPH_SQL} SELECT 'AST' AS kind, src, dst FROM e WHERE (edge_type IN ('AST', 'CHILD') OR edge_type IS NULL)
        AND src IN (SELECT node FROM n WHERE node_type = 'AST' OR node_type IS NULL) AND dst IN (SELECT node FROM n WHERE node_type = 'AST' OR node_type IS NULL)
    UNION ALL SELECT 'CFG', src, dst FROM e WHERE edge_type IN ('CFG', 'CONTROL_FLOW') AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)
    UNION ALL SELECT 'DFG', src, dst FROM e WHERE edge_type IN ('DFG', 'DATA_FLOW', 'DFG_INTERP', 'DFG_TEMPLATE') AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)
    UNION ALL SELECT 'CPG', src, dst FROM e UNION ALL SELECT 'AST node', node, NULL FROM n WHERE node_type = 'AST' OR node_type IS NULL""",
)
def graph_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    nodes = p.where("p_size % 9 <> 8").select(key.alias("node"), _pick(NODE_KINDS, size % 4).alias("node_type"))
    edges = p.select(key.alias("src"), (key + 1 + size % 3).alias("dst"), _pick(EDGE_KINDS, key % 8).alias("edge_type"))
    out = views.view(nodes, edges, "AST")[0].select(F.lit("AST node").alias("kind"), F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"))
    for kind in views.VIEWS:
        out = out.unionByName(views.view(nodes, edges, kind)[1].select(F.lit(kind).alias("kind"), "src", F.col("dst").cast("long")))
    return out


@query(
    "file_views",
    r"""WITH n AS (SELECT page_id AS node, lower(regexp_extract(url, '://([^?#]*)', 1)) AS file FROM pages),
    f AS (SELECT DISTINCT regexp_extract(file, '/([a-z]+/[0-9]+)', 1) AS path FROM n WHERE regexp_matches(file, '/[a-z]+/[0-9]+')),
    i AS (SELECT path, node FROM n JOIN f ON file = path OR ends_with(file, '/' || path) OR ends_with(path, '/' || file)), e AS (SELECT a.page_id AS src, b.page_id AS dst FROM pages a JOIN pages b ON b.page_id = (a.page_id * 7) % 50)
    SELECT path, node, NULL AS dst FROM i UNION ALL SELECT a.path, e.src, e.dst FROM e JOIN i a ON a.node = e.src JOIN i b ON b.node = e.dst AND a.path = b.path""",
)
def file_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of each file that is asked for by the end of its path; pages are nodes."""
    pages = table(spark, sf_dir, "pages")
    nodes = pages.select(F.col("page_id").alias("node"), F.regexp_extract("url", "://([^?#]*)", 1).alias("file"))
    asked = nodes.select(F.regexp_extract(F.lower("file"), "/([a-z]+/[0-9]+)", 1).alias("path")).where("path <> ''")
    edges = pages.select(F.col("page_id").alias("src"), (F.col("page_id") * 7 % 50).alias("dst"))
    inside, between = views.file_views(nodes, edges, asked)
    none = F.lit(None).cast("long").alias("dst")
    return inside.select("path", "node", none).unionByName(between.select("path", F.col("src").alias("node"), "dst"))


@query(
    "repository_statistics",
    """SELECT (SELECT count(*) FROM supplier) AS total_modules, (SELECT CAST(sum(s_suppkey % 5) AS BIGINT) FROM supplier) AS total_exports, (SELECT CAST(sum(s_suppkey % 3) AS BIGINT) FROM supplier) AS total_imports,
    (SELECT count(*) FROM supplier WHERE s_nationkey % 3 = 0) AS python_modules, (SELECT count(*) FROM supplier WHERE s_nationkey % 3 <> 0 AND s_nationkey % 5 <> 4) AS javascript_modules,
    (SELECT count(*) FROM part) AS total_nodes, (SELECT count(*) FROM lineitem) AS total_edges, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS cross_file_edges""",
)
def repository_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("s_nationkey") % 3
    language = F.when(third == 0, "python").when(F.col("s_nationkey") % 5 == 4, "go").when(third == 1, "javascript").otherwise("typescript")
    modules = table(spark, sf_dir, "supplier").select(language.alias("language"), (F.col("s_suppkey") % 5).alias("exports"), (F.col("s_suppkey") % 3).alias("imports"))
    edges = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("cross_file"))
    return views.statistics(modules, table(spark, sf_dir, "part"), edges)


@query(
    "failing_register",
    """WITH f AS (SELECT 'V' || c_custkey AS control_id FROM customer WHERE c_custkey % 3 = 0),
    e AS (SELECT 'V' || o_custkey AS control_id, o_orderkey AS ord, trim(coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_clerk END, '') || ':' || coalesce(CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 90 END AS VARCHAR), '')
        || ' — ' || coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, ''), ' —') AS text FROM (SELECT *, o_orderstatus AS o_clerk FROM orders)),
    r AS (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY ord) AS k FROM e),
    s AS (SELECT control_id, string_agg(text, chr(10) ORDER BY k) FILTER (WHERE k <= 4) AS evidence, count(*) AS n FROM r GROUP BY 1)
    SELECT control_id, coalesce(n, 0) AS n, coalesce(evidence, 'No inline evidence recorded.') AS evidence FROM f LEFT JOIN s USING (control_id)""",
)
def failing_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    results = table(spark, sf_dir, "customer").select(F.concat(F.lit("V"), "c_custkey").alias("control_id"), F.when(F.col("c_custkey") % 3 == 0, "fail").otherwise("pass").alias("verdict"))
    evidence = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("V"), "o_custkey").alias("control_id"),
        key.alias("ord"),
        F.when(key % 4 != 0, F.col("o_orderstatus")).alias("file"),
        F.when(key % 5 != 0, key % 90).alias("line"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("note"),
    )
    return views.failing_register(results, evidence)


@query(
    "verdict_dispatch",
    """WITH c AS (SELECT 'V' || c_custkey AS control_id, c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'config_inspection' WHEN 1 THEN 'dynamic_probe' WHEN 2 THEN 'manual_attestation' END AS strategy FROM customer),
    o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'not_tested' END AS v, (o_orderkey % 10)::DOUBLE / 10 AS k FROM orders),
    g AS (SELECT o_custkey, bool_or(v = 'fail') AS f, bool_or(v = 'pass') AS p, max(k) FILTER (v = 'fail') AS kf, max(k) FILTER (v = 'pass') AS kp, max(k) AS ka FROM o GROUP BY 1)
    SELECT c.control_id, CASE WHEN g.f IS NULL OR strategy IS NULL OR strategy = 'manual_attestation' THEN 'not_tested' WHEN strategy = 'config_inspection' AND c_custkey = 4 THEN CASE WHEN p THEN 'pass' WHEN f THEN 'fail' ELSE 'not_tested' END
        ELSE CASE WHEN f THEN 'fail' WHEN p THEN 'pass' ELSE 'not_tested' END END AS verdict,
    CASE WHEN strategy = 'config_inspection' THEN CASE WHEN c_custkey = 4 THEN coalesce(kp, kf) WHEN f THEN kf ELSE ka END WHEN strategy = 'dynamic_probe' THEN coalesce(kf, kp) END AS confidence
    FROM c LEFT JOIN g ON o_custkey = c_custkey""",
)
def verdict_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fourth = F.col("c_custkey") % 4
    strategy = F.when(fourth == 0, "config_inspection").when(fourth == 1, "dynamic_probe").when(fourth == 2, "manual_attestation")
    controls = table(spark, sf_dir, "customer").select(F.concat(F.lit("V"), "c_custkey").alias("control_id"), strategy.alias("strategy"))
    v = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("not_tested")
    found = table(spark, sf_dir, "orders").select(F.concat(F.lit("V"), "o_custkey").alias("control_id"), v.alias("verdict"), ((F.col("o_orderkey") % 10).cast("double") / 10).alias("confidence"))
    of = lambda judge: lambda ids: judge(found.join(ids, "control_id", "left_semi"), ["control_id"])
    judges = {"config_inspection": of(verdicts.fail_wins), "dynamic_probe": of(verdicts.any_fail_wins), "either": of(verdicts.pass_wins)}
    return views.dispatch(controls, judges, {("config_inspection", "V4"): "either"})


@query(
    "tuple_unpacking",
    """WITH r AS (SELECT p_partkey AS f, k AS pos, p_partkey * 100 + (p_size % 2) * 10 + k AS element FROM part, (VALUES (0), (1), (2)) v(k) WHERE k <= p_size % 4),
    a AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS assignment, l_partkey AS f, l_linenumber % 3 AS n FROM lineitem)
    SELECT DISTINCT element AS src, assignment * 10 + r.pos AS dst, r.pos FROM a JOIN r ON a.f = r.f AND r.pos <= a.n""",
)
def tuple_unpacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("pos")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", three).where("pos <= p_size % 4")
    element = lambda ret: F.col("p_partkey") * 100 + ret * 10 + F.col("pos")
    first = p.select(F.col("p_partkey").alias("function"), (F.col("p_size") % 2).alias("ret"), "pos", element(F.col("p_size") % 2).alias("element"))
    later = p.select(F.col("p_partkey").alias("function"), (F.col("p_size") % 2 + 1).alias("ret"), "pos", element(F.col("p_size") % 2 + 1).alias("element"))
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("assignment"), F.col("l_partkey").alias("callee"), (F.col("l_linenumber") % 3).alias("n"))
    targets = li.select("assignment", "n", three).where("pos <= n").select("assignment", "pos", (F.col("assignment") * 10 + F.col("pos")).alias("target")).distinct()
    return views.unpacked(li.select("assignment", "callee").distinct(), first.unionByName(later), targets)
