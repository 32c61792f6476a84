"""Enrichment and projections over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators import enrich, projections, routes, scans
from basaltine.plans.registry import query
from basaltine.session import table

CALL_TEXTS = ["eval(x)", "os.system(x)", "requests.get(x)", "cursor.execute(x)", "len(x)"]


@query(
    "call_subtypes",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 OR l_partkey % 7 = 0 THEN 'EVAL_CALL' WHEN l_linenumber % 5 = 1 THEN 'SYSTEM_CALL'
    WHEN l_linenumber % 5 = 2 THEN 'EXTERNAL_CALL' WHEN l_linenumber % 5 = 3 THEN 'ORM_QUERY' ELSE 'CALL_EXPRESSION' END AS kind FROM lineitem""",
)
def call_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(t) for t in CALL_TEXTS]), F.col("l_linenumber") % 5)
    text = F.when(F.col("l_partkey") % 7 == 0, F.concat(text, F.lit(" or EXEC(y)"))).otherwise(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", enrich.call_kind(text).alias("kind"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"),
        F.when(kind == 0, "FUNCTION").when(kind == 1, "ROUTE_DECORATOR").when(kind == 2, "AUTH_GUARD").otherwise("MIDDLEWARE").alias("type"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("source_code"),
        F.col("l_orderkey").cast("string").alias("file"),
        F.col("l_linenumber").alias("line"),
        F.lit(0).alias("col"),
    ).dropDuplicates(["node"])


@query(
    "http_auth_edges",
    """WITH n AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS node, l_linenumber % 4 AS k FROM lineitem),
    s AS (SELECT r.f, r.node AS route, min(h.line) AS h_line FROM n r JOIN n h ON r.f = h.f AND r.k = 1 AND h.k = 0 AND h.line >= r.line GROUP BY ALL),
    d AS (SELECT *, f * 10 + h_line AS handler FROM s)
    SELECT route AS src, handler AS dst, 'HTTP_ROUTE' AS type FROM d UNION SELECT n.node, handler, 'HTTP_MIDDLEWARE' FROM d JOIN n ON n.f = d.f AND n.k = 3
    UNION SELECT handler, n.node, 'AUTH_COVERAGE' FROM d JOIN n ON n.f = d.f AND n.k = 2 AND n.line <= h_line
    UNION SELECT n.node, handler, 'PERMISSION_FLOW' FROM d JOIN n ON n.f = d.f AND n.k = 2 AND n.line <= h_line""",
)
def http_auth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.http_edges(_nodes(spark, sf_dir))


@query(
    "path_edge_features",
    """WITH e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS src, l_orderkey * 10 + l_linenumber + 1 AS dst, l_returnflag AS type FROM lineitem),
    p AS (SELECT o_orderkey AS id, unnest(range(1, 7)) AS i FROM orders)
    SELECT id, type, count(*) AS n FROM p JOIN e ON e.src = id * 10 + i AND e.dst = id * 10 + i + 1 GROUP BY ALL""",
)
def path_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    e = table(spark, sf_dir, "lineitem").select(src.alias("src"), (src + 1).alias("dst"), F.col("l_returnflag").alias("type"))
    paths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.col("o_orderkey") * 10 + i).alias("path"))
    return enrich.path_features(paths, e)


@query(
    "graph_edge_statistics",
    "SELECT l_shipmode AS type, count(*) AS n, count(*) FILTER (l_discount < 0.05) AS uncertain FROM (SELECT l_returnflag AS l_shipmode, l_discount FROM lineitem) GROUP BY 1",
)
def graph_edge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.when(F.col("l_discount") < 0.05, 0.5).otherwise(1.0).alias("confidence"))
    return enrich.edge_statistics(e)


@query(
    "form_route_handlers",
    """WITH r AS (SELECT '/' || n_name AS route, n_nationkey AS h FROM nation UNION ALL SELECT '/' || r_name || '/<int:id>', 100 + r_regionkey FROM region),
    a AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/' || n_name WHEN 1 THEN n_name || '/' ELSE '/' || r_name || '/' || (CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'x' END) END AS action
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, action, coalesce((SELECT min(h) FROM r WHERE route = action), (SELECT min(h) FROM r WHERE trim(route, '/') = trim(action, '/')),
    (SELECT min(h) FROM r WHERE contains(route, '<') AND regexp_matches(action, '^' || replace(route, '<int:id>', '[0-9]+') || '$'))) AS handler FROM a""",
)
def form_route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = n.select(F.concat(F.lit("/"), "n_name").alias("route"), F.col("n_nationkey").alias("handler"))
    known = known.unionByName(r.select(F.concat(F.lit("/"), "r_name", F.lit("/<int:id>")).alias("route"), (F.col("r_regionkey") + 100).alias("handler")))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    last = F.when(key % 2 == 0, key.cast("string")).otherwise("x")
    action = F.when(key % 3 == 0, F.concat(F.lit("/"), "n_name")).when(key % 3 == 1, F.concat("n_name", F.lit("/"))).otherwise(F.concat(F.lit("/"), "r_name", F.lit("/"), last))
    return routes.resolve_actions(s.select("s_suppkey", action.alias("action")), known).select("s_suppkey", "action", "handler")


@query(
    "finding_type_groups",
    """SELECT CASE p_size % 4 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' WHEN 2 THEN 'broken_access_control' ELSE replace(replace(lower(p_type), ' ', '_'), '-', '_') END AS kind, count(*) AS n FROM part GROUP BY 1""",
)
def finding_type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    name = F.when(k == 0, "Blind SQL Injection").when(k == 1, "Stored XSS").when(k == 2, "IDOR in orders").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy(projections.type_group(name).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "scan_log_states",
    """WITH l AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING'
    WHEN 'signup' THEN CASE WHEN event_id % 50 = 0 THEN 'DELETED' ELSE 'CANCELLED' END ELSE 'PENDING' END AS state FROM events)
    SELECT user_id AS scan_id, coalesce(arg_min(state, (ts, event_id)) FILTER (state IN ('COMPLETED', 'FAILED', 'CANCELLED')), arg_max(state, (ts, event_id)) FILTER (state <> 'DELETED')) AS state,
    arg_min(event_id, (ts, event_id)) AS first_event, arg_min(event_id, (ts, event_id)) FILTER (state IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS last_event
    FROM l GROUP BY user_id HAVING NOT bool_or(state = 'DELETED')""",
)
def scan_log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").when(kind == "click", "RUNNING")
    state = state.when((kind == "signup") & (F.col("event_id") % 50 == 0), "DELETED").when(kind == "signup", "CANCELLED").otherwise("PENDING")
    none = F.lit(None).cast("string")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scan_id"), none.alias("user_id"), none.alias("repo_id"), none.alias("input_type"), state.alias("state"), F.struct("ts", "event_id").alias("at")
    )
    return scans.current(log).select("scan_id", "state", F.col("created_at.event_id").alias("first_event"), F.col("finished_at.event_id").alias("last_event"))
