"""Access, quotas, routes, ranking and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltine.functions.time import epoch_us
from basaltine.functions.web import is_public_url, normal_route, route_regex
from basaltine.operators import dedupe, joins
from basaltine.plans.registry import query
from basaltine.session import table


@query(
    "scan_quota",
    """SELECT user_id, count(*) AS used, CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 50 ELSE 5 END AS quota,
    CASE WHEN user_id % 10 = 0 THEN true WHEN user_id % 3 = 0 THEN count(*) < 50 ELSE count(*) < 5 END AS allowed
    FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id""",
)
def scan_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ'2024-01-10 00:00:00'")
    quota = F.when(F.col("user_id") % 10 == 0, F.lit(None)).when(F.col("user_id") % 3 == 0, 50).otherwise(5)
    used = e.groupBy("user_id").agg(F.count("*").alias("used")).withColumn("quota", quota)
    return used.withColumn("allowed", F.col("quota").isNull() | (F.col("used") < F.col("quota")))


@query(
    "visible_rows",
    """SELECT c_custkey AS viewer, o_orderkey FROM customer JOIN orders ON c_mktsegment = 'MACHINERY' AND (c_custkey = o_custkey OR c_custkey = 1)""",
)
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    viewers = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("viewer"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = viewers.join(o, F.col("viewer") == F.col("o_custkey")).select("viewer", "o_orderkey")
    admin = viewers.where("viewer = 1").join(o.withColumn("viewer", F.lit(1).cast("long")), "viewer")  # sees all, one viewer at most
    return own.unionByName(admin.select("viewer", "o_orderkey")).distinct()


@query(
    "public_urls",
    """SELECT page_id, regexp_matches(url, '^https?://') AND NOT contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '@')
    AND lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) NOT IN ('localhost', '') AS public FROM pages""",
)
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_public_url(F.col("url")).alias("public"))


ROUTES = [("/en/<int:id>", "show"), ("/<lang>/7", "seven"), ("/de/<int:id>.html", "page"), ("/fr/<id>", "french")]
ROUTES_SQL = "(VALUES ('^/en/[0-9]+$', 'show'), ('^/[^/]+/7$', 'seven'), ('^/de/[0-9]+.html$', 'page'), ('^/fr/[^/]+$', 'french')) r(pattern, handler)"


@query(
    "route_handlers",
    f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/]*(/.*)', 1), '[?#].*$', ''), '/$', '') AS path FROM pages)
    SELECT page_id, path, handler FROM p JOIN {ROUTES_SQL} ON regexp_matches(path, pattern)""",
)
def route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", normal_route(F.regexp_extract("url", "://[^/]*(/.*)", 1)).alias("path"))
    routes = F.array(*[F.struct(route_regex(F.lit(r)).alias("pattern"), F.lit(h).alias("handler")) for r, h in ROUTES])
    met = p.withColumn("r", F.explode(F.filter(routes, lambda r: F.regexp_like(F.col("path"), r.pattern))))
    return met.select("page_id", "path", F.col("r.handler").alias("handler"))


@query(
    "ranked_findings",
    """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS BIGINT) AS rank,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) <= 3 AS for_model FROM orders""",
)
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rank"))
    return o.withColumn("for_model", F.col("rank") <= 3)


@query(
    "top_candidates",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200",
)
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(200)


@query(
    "worst_chapters",
    """SELECT c_nationkey AS chapter, count(*) FILTER (o_orderstatus = 'F') AS fails FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY 1 ORDER BY fails DESC, chapter LIMIT 3""",
)
def worst_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("chapter"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("chapter").agg(F.count_if(F.col("o_orderstatus") == "F").alias("fails"))
    return g.orderBy(F.desc("fails"), "chapter").limit(3)


@query(
    "capability_candidates",
    """WITH k(control, word, hint) AS (VALUES ('V6.2.2', 'password', 'src1'), ('V7.4.1', 'token', 'src2')),
    m AS (SELECT control, doc_id, contains(lower(text), word) AS hit FROM documents, k WHERE contains(lower(text), word) OR source = hint)
    SELECT control, doc_id, hit FROM m QUALIFY row_number() OVER (PARTITION BY control ORDER BY hit DESC, doc_id) <= 6""",
)
def capability_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = F.array(
        *[F.struct(F.lit(c).alias("control"), F.lit(w).alias("word"), F.lit(h).alias("hint")) for c, w, h in (("V6.2.2", "password", "src1"), ("V7.4.1", "token", "src2"))]
    )
    d = table(spark, sf_dir, "documents").withColumn("k", F.explode(controls))
    d = d.withColumn("hit", F.contains(F.lower("text"), F.col("k.word"))).where("hit OR source = k.hint")
    d = d.select(F.col("k.control").alias("control"), "doc_id", "hit")
    rank = F.row_number().over(Window.partitionBy("control").orderBy(F.desc("hit"), "doc_id"))
    return d.withColumn("r", rank).where("r <= 6").drop("r")


@query(
    "service_dedupe",
    """WITH f AS (SELECT l_orderkey AS file, l_partkey % 5 AS g, l_linenumber AS line, l_suppkey AS sink, l_extendedprice AS score, l_returnflag = 'R' AS dfg, l_partkey, l_tax FROM lineitem),
    d AS (SELECT * FROM f WHERE dfg QUALIFY row_number() OVER (PARTITION BY file, g, line, sink ORDER BY score DESC, l_partkey, l_tax) = 1),
    r AS (SELECT * FROM f WHERE NOT dfg AND NOT EXISTS (SELECT 1 FROM d WHERE d.file = f.file AND d.g = f.g AND abs(d.line - f.line) <= 1)),
    x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file, g, line ORDER BY score DESC, l_partkey, sink, l_tax) = 1)
    SELECT file, g, line, sink, score, dfg FROM d UNION ALL SELECT file, g, line, sink, score, dfg FROM x""",
)
def service_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"),
        (F.col("l_partkey") % 5).alias("g"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("sink"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").alias("dfg"),
        "l_partkey",
        "l_tax",
    )
    flows = dedupe.best_per_key(f.where("dfg"), ["file", "g", "line", "sink"], [F.desc("score"), F.asc("l_partkey"), F.asc("l_tax")])
    near = flows.select("file", "g", F.col("line").alias("near_line")).distinct()
    rest = joins.band(f.where("NOT dfg"), near, ["file", "g"], "line", "near_line", 1, "left_anti")
    rest = dedupe.best_per_key(rest, ["file", "g", "line"], [F.desc("score"), F.asc("l_partkey"), F.asc("sink"), F.asc("l_tax")])
    return flows.unionByName(rest).select("file", "g", "line", "sink", "score", "dfg")


@query(
    "scan_durations",
    """SELECT user_id, event_id, round_even(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS DOUBLE) / 1000000.0, 2)::DOUBLE AS seconds FROM events""",
)
def scan_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_us("ts").alias("us"))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us"))
    return e.select("user_id", "event_id", F.bround(gap.cast("double") / 1_000_000.0, 2).alias("seconds"))
