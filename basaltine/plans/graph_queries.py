"""Graph searches over edges that are derived from suppliers; conversations serve as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators import graph
from basaltine.plans.registry import query
from basaltine.session import table

EDGES_SQL = """n AS (SELECT count(*) AS c FROM supplier),
edges AS (SELECT s_suppkey AS src, (s_suppkey * 3 + s_nationkey) % c AS dst, 0 AS ord FROM supplier, n
UNION ALL SELECT s_suppkey, (s_suppkey + s_nationkey + 1) % c, 1 FROM supplier, n WHERE s_suppkey % 2 = 0)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    s = s.withColumn("c", s.agg(F.count("*")).scalar())
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    a = s.select(key.alias("src"), ((key * 3 + nation) % F.col("c")).alias("dst"), F.lit(0).alias("ord"))
    b = s.where("s_suppkey % 2 = 0").select(key.alias("src"), ((key + nation + 1) % F.col("c")).alias("dst"), F.lit(1).alias("ord"))
    return a.unionByName(b)


def of_nation(spark: SparkSession, sf_dir: str, *nations: int) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(F.col("s_nationkey").isin(*nations)).select(F.col("s_suppkey").alias("node"))


@query(
    "graph_reachable_k",
    f"""WITH RECURSIVE {EDGES_SQL}, r(start, node, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_nationkey = 3
    UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN edges e ON r.node = e.src WHERE r.depth < 4)
    SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL""",
)
def graph_reachable_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(edges(spark, sf_dir), of_nation(spark, sf_dir, 3), 4)


@query(
    "graph_simple_paths",
    f"""WITH RECURSIVE {EDGES_SQL}, p(node, path) AS (SELECT s_suppkey, [s_suppkey] FROM supplier WHERE s_nationkey = 5
    UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN edges e ON p.node = e.src WHERE len(p.path) <= 5 AND NOT list_contains(p.path, e.dst))
    SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length, CASE WHEN len(path) <= 3 THEN 'critical' WHEN len(path) <= 6 THEN 'high' ELSE 'medium' END AS severity
    FROM p JOIN supplier s ON p.node = s.s_suppkey WHERE s.s_nationkey = 9 AND len(path) > 1""",
)
def graph_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.simple_paths(edges(spark, sf_dir), of_nation(spark, sf_dir, 5), of_nation(spark, sf_dir, 9), 5)
    n = F.size("path")
    severity = F.when(n <= 3, "critical").when(n <= 6, "high").otherwise("medium")
    return found.select(F.array_join("path", ">").alias("path"), (n - 1).cast("long").alias("length"), severity.alias("severity"))


def paths_sql(hops: str, last: str, columns: str, budget: str, most: int) -> str:
    """Paths in first-in first-out order: the first arrival at each node and number of crossings, then all arrivals at targets."""
    return f"""WITH RECURSIVE {EDGES_SQL}, goal AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey = 7),
    f AS (SELECT s_suppkey AS node, s_nationkey % 5 AS file FROM supplier),
    t(source, node, hops, path, ords, file) USING KEY (source, node, hops) AS (
    SELECT s_suppkey, s_suppkey, 0, [s_suppkey], CAST([] AS INT[]), s_nationkey % 5 FROM supplier
    WHERE s_nationkey = 2 AND s_suppkey NOT IN (SELECT node FROM goal)
    UNION SELECT source, node, hops, path, ords, file FROM (
    SELECT t.source, e.dst AS node, {hops} AS hops, list_append(t.path, e.dst) AS path, list_append(t.ords, e.ord) AS ords, {last} AS file,
    row_number() OVER (PARTITION BY t.source, e.dst, {hops} ORDER BY list_append(t.ords, e.ord)) AS k
    FROM t JOIN edges e ON t.node = e.src LEFT JOIN f ON f.node = e.dst WHERE len(t.path) < 50 AND NOT list_contains(t.path, e.dst) AND {budget}
    AND e.dst NOT IN (SELECT node FROM goal)
    AND NOT EXISTS (SELECT 1 FROM recurring.t r WHERE r.source = t.source AND r.node = e.dst AND r.hops = {hops})) WHERE k = 1),
    found AS (SELECT t.source, array_to_string(list_append(t.path, e.dst), '>') AS path, {hops} AS hops,
    row_number() OVER (PARTITION BY t.source ORDER BY len(t.path), list_append(t.ords, e.ord)) AS rank
    FROM t JOIN edges e ON t.node = e.src JOIN goal g ON g.node = e.dst LEFT JOIN f ON f.node = e.dst
    WHERE len(t.path) < 50 AND NOT list_contains(t.path, e.dst) AND {budget})
    SELECT {columns} FROM found WHERE rank <= {most}"""


CROSSED = "t.hops + (CASE WHEN t.file <> f.file THEN 1 ELSE 0 END)"


@query("graph_rule_paths", paths_sql("0", "t.file", "source, path, CAST(rank AS INT) AS rank", "true", 100))
def graph_rule_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.bfs_paths(edges(spark, sf_dir), of_nation(spark, sf_dir, 2), of_nation(spark, sf_dir, 7))
    return found.select("source", F.array_join("path", ">").alias("path"), "rank")


@query(
    "graph_hop_budget",
    paths_sql(CROSSED, "coalesce(f.file, t.file)", "source, path, hops, CAST(rank AS INT) AS rank", f"{CROSSED} <= 2", 200),
)
def graph_hop_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).cast("string").alias("file"))
    found = graph.bfs_paths(
        edges(spark, sf_dir), of_nation(spark, sf_dir, 2), of_nation(spark, sf_dir, 7), max_paths=200, max_hops=2, files=files
    )
    return found.select("source", F.array_join("path", ">").alias("path"), "hops", "rank")


@query(
    "graph_level_paths",
    paths_sql(CROSSED, "coalesce(f.file, t.file)", "source, path, hops, CAST(rank AS INT) AS rank", f"{CROSSED} <= 3", 100),
)
def graph_level_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of graphs that are not small: level by level, three crossings at most."""
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).cast("string").alias("file"))
    found = graph.bfs_paths(
        edges(spark, sf_dir), of_nation(spark, sf_dir, 2), of_nation(spark, sf_dir, 7), max_hops=3, files=files, small=0
    )
    return found.select("source", F.array_join("path", ">").alias("path"), "hops", "rank")


@query(
    "graph_cycle_nodes",
    f"""WITH RECURSIVE {EDGES_SQL}, r(start, node) AS (SELECT src, dst FROM edges UNION SELECT r.start, e.dst FROM r JOIN edges e ON r.node = e.src),
    c AS (SELECT DISTINCT start AS node FROM r WHERE start = node)
    SELECT DISTINCT x.node FROM (SELECT r.start AS node FROM r JOIN c ON r.node = c.node UNION SELECT node FROM c) x
    JOIN (SELECT r.node FROM r JOIN c ON r.start = c.node UNION SELECT node FROM c) y ON x.node = y.node""",
)
def graph_cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_nodes(edges(spark, sf_dir))


@query(
    "graph_ancestors",
    """SELECT a.conv_id, a.turn AS node, b.turn AS ancestor, a.turn - b.turn AS distance FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn < a.turn AND a.turn - b.turn <= 5""",
)
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "turn")
    up = c.select(F.col("node").alias("src"), (F.col("node") - 1).alias("dst"), "turn").where("turn > 0").select("src", "dst")
    r = graph.closure(up, c, 5).where("depth > 0")
    thousand = F.lit(1000).cast("long")
    return r.select(
        F.expr("start div 1000").alias("conv_id"),
        (F.col("start") % thousand).alias("node"),
        (F.col("node") % thousand).alias("ancestor"),
        F.col("depth").cast("long").alias("distance"),
    )


@query(
    "reexport_fixpoint",
    f"""WITH RECURSIVE {EDGES_SQL}, x(module, name, depth) AS (SELECT s_suppkey, s_nationkey, 0 FROM supplier WHERE s_suppkey % 4 = 1
    UNION SELECT e.src, x.name, 0 FROM x JOIN edges e ON e.dst = x.module)
    SELECT module, CAST(name AS BIGINT) AS name FROM x GROUP BY ALL""",
)
def reexport_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1")
    own = own.select(F.col("s_suppkey").alias("module"), F.col("s_nationkey").cast("long").alias("name"), F.col("s_suppkey").alias("origin"))
    wild = edges(spark, sf_dir).select(F.col("src").alias("module"), F.col("dst").alias("target")).distinct()
    return graph.fixpoint_exports(own, wild).select("module", "name").distinct()


@query(
    "induced_subgraph",
    f"WITH {EDGES_SQL}, k AS (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0) "
    "SELECT src, dst, ord FROM edges WHERE src IN (SELECT s_suppkey FROM k) AND dst IN (SELECT s_suppkey FROM k)",
)
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("node"))
    return graph.induced(keep, edges(spark, sf_dir)).select("src", "dst", "ord")


@query(
    "graph_context_nodes",
    f"""WITH {EDGES_SQL}, p AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey = 4)
    SELECT node FROM p UNION SELECT dst FROM edges WHERE src IN (SELECT node FROM p) UNION SELECT src FROM edges WHERE dst IN (SELECT node FROM p)""",
)
def graph_context_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = edges(spark, sf_dir), of_nation(spark, sf_dir, 4)
    after = e.join(p.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    before = e.join(p.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return p.unionByName(after).unionByName(before).distinct()


@query(
    "cross_edge_lift",
    f"""WITH {EDGES_SQL} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.dst = b.dst)""",
)
def cross_edge_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select("src", "dst").distinct()
    two = e.withColumnRenamed("dst", "mid").join(e.withColumnsRenamed({"src": "mid"}), "mid").where("src <> dst").select("src", "dst").distinct()
    return two.join(e, ["src", "dst"], "left_anti")
