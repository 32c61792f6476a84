"""Joins, de-duplication, windows and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltine.functions.time import epoch_day, epoch_us
from basaltine.operators import dedupe, joins
from basaltine.plans.registry import query
from basaltine.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", epoch_us("ts").alias("us"))


@query(
    "asof_backward_def",
    """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_backward_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    uses = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    defs = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("us").alias("def_us"))
    return joins.asof_backward(uses, defs, ["user_id"], "us", "def_us", ["view_id"]).select("event_id", "view_id")


@query(
    "asof_forward_handler",
    """SELECT c.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts < p.ts""",
)
def asof_forward_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    routes = e.where("event_type = 'click'").select("event_id", "user_id", "us")
    handlers = e.where("event_type = 'purchase'")
    handlers = handlers.select("user_id", F.col("event_id").alias("purchase_id"), F.col("us").alias("at_us"))
    return joins.asof_forward(routes, handlers, ["user_id"], "us", "at_us", ["purchase_id"]).select("event_id", "purchase_id")


BAND_US = 3_600_000_000


@query(
    "band_join_lines",
    f"""SELECT a.event_id AS query_id, b.event_id AS call_id FROM events a JOIN events b ON a.user_id = b.user_id
    WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {BAND_US}""",
)
def band_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("query_id"), F.col("us").alias("a_us"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("call_id"), F.col("us").alias("b_us"))
    return joins.band(a, b, ["user_id"], "a_us", "b_us", BAND_US).select("query_id", "call_id")


@query(
    "near_line_anti",
    f"""SELECT a.event_id FROM events a WHERE a.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events b
    WHERE b.event_type = 'signup' AND b.user_id = a.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {BAND_US})""",
)
def near_line_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    a = e.where("event_type = 'error'").select("user_id", "event_id", F.col("us").alias("a_us"))
    b = e.where("event_type = 'signup'").select("user_id", F.col("us").alias("b_us"))
    return joins.band(a, b, ["user_id"], "a_us", "b_us", BAND_US, "left_anti").select("event_id")


@query(
    "theta_def_use",
    """SELECT u.conv_id, u.turn AS def_turn, a.turn AS use_turn FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND u.turn <= a.turn WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def theta_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    defs = c.where("role = 'user'").select("conv_id", F.col("turn").alias("def_turn"))
    uses = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("use_turn"))
    return defs.join(uses, "conv_id").where("def_turn <= use_turn")


@query(
    "positional_zip",
    """WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations)
    SELECT u.conv_id, u.pos AS pos, u.turn AS arg_turn, a.turn AS param_turn FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.pos = a.pos
    WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    args = c.where("role = 'user'").select("conv_id", F.col("turn").alias("arg_turn"))
    params = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("param_turn"))
    out = joins.positional(args, params, ["conv_id"], ["arg_turn"], ["param_turn"])
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), "arg_turn", "param_turn")


@query(
    "import_suffix_resolution",
    """WITH m AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+/[0-9]+)', 1) AS module FROM pages),
    f AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)
    SELECT module, page_id FROM m JOIN f ON module <> '' AND (path = module OR ends_with(path, '/' || module))""",
)
def import_suffix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    modules = p.select(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+/[0-9]+)", 1).alias("module"))
    files = p.select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return joins.suffix_resolve(modules.where("module <> ''").distinct(), files, "module", "path").select("module", "page_id")


ORDER_SPAN = "CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS s, CAST(o_orderdate AS DATE) - DATE '1970-01-01' + o_orderkey % 60 AS e"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = epoch_day("o_orderdate")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", day.alias("s"), (day + F.col("o_orderkey") % 60).alias("e"))


@query(
    "overlap_components",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, {ORDER_SPAN} FROM orders),
    b AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o)
    SELECT o_orderkey, o_custkey, CAST(sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END)
    OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM b""",
)
def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe.islands(_spans(spark, sf_dir), ["o_custkey"], "s", "e", ["o_orderkey"])
    return out.select("o_orderkey", "o_custkey", "island")


@query(
    "same_rule_overlap_anti",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, {ORDER_SPAN} FROM orders)
    SELECT o_orderkey FROM o a WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM o b WHERE b.o_orderstatus = 'O'
    AND a.o_custkey = b.o_custkey AND a.s <= b.e AND b.s <= a.e)""",
)
def same_rule_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _spans(spark, sf_dir)
    return joins.interval_anti(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"], "s", "e").select("o_orderkey")


@query(
    "finding_argmax_dedupe",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey
    ORDER BY (l_returnflag = 'R') DESC, (l_linestatus = 'F') DESC, l_quantity DESC, l_discount, l_orderkey, l_linenumber, l_extendedprice) = 1""",
)
def finding_argmax_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order = [
        (F.col("l_returnflag") == "R").desc(),
        (F.col("l_linestatus") == "F").desc(),
        F.desc("l_quantity"),
        F.asc("l_discount"),
        F.asc("l_orderkey"),
        F.asc("l_linenumber"),
        F.asc("l_extendedprice"),
    ]
    best = dedupe.best_per_key(li, ["l_partkey", "l_suppkey"], order)
    return best.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "finding_merge",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, {ORDER_SPAN} FROM orders),
    b AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey
    ROWS UNBOUNDED PRECEDING) AS island FROM b),
    k AS (SELECT o_custkey, island, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS best, min(o_orderpriority) AS rule,
    list(DISTINCT o_orderpriority) AS rules, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)
    SELECT o_custkey, CAST(island AS BIGINT) AS island, best AS o_orderkey, rule,
    array_to_string(list_sort(list_filter(rules, lambda r: r <> rule)), '|') AS contributing, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM k""",
)
def finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = dedupe.islands(_spans(spark, sf_dir), ["o_custkey"], "s", "e", ["o_orderkey"])
    best = dedupe.merged(i, ["o_custkey", "island"], [F.asc("o_orderpriority"), F.asc("o_orderkey")], "o_orderpriority")
    reach = i.groupBy("o_custkey", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    best = best.drop("s", "e").join(reach, ["o_custkey", "island"])
    rule = F.col("o_orderpriority").alias("rule")
    return best.select("o_custkey", "island", "o_orderkey", rule, F.array_join("contributing", "|").alias("contributing"), "s", "e")


@query(
    "captured_variables",
    """SELECT l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey < 12)""",
)
def captured_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").subtract(li.where("l_suppkey < 12").select("l_partkey"))


@query(
    "sibling_next",
    """SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lag(turn) OVER w AS previous_turn,
    first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS first_following,
    last_value(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS last_following
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def sibling_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.lead("turn").over(w).alias("next_turn"),
        F.lag("turn").over(w).alias("previous_turn"),
        F.first("turn").over(after).alias("first_following"),
        F.last("turn").over(after).alias("last_following"),
    )


@query(
    "path_pairs",
    """SELECT conv_id, a, b FROM (SELECT conv_id, unnest(list_transform(range(1, len(p)), lambda i: [p[i], p[i + 1]])) AS ab FROM
    (SELECT conv_id, list(turn ORDER BY turn) AS p FROM conversations GROUP BY conv_id)) , LATERAL (SELECT ab[1] AS a, ab[2] AS b)""",
)
def path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("p"))
    pairs = F.arrays_zip(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("a"), F.slice("p", 2, F.size("p")).alias("b"))
    return p.select("conv_id", F.inline(pairs).alias("a", "b"))


@query(
    "latest_and_trend",
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, max(CASE WHEN k = 1 THEN event_id END) AS latest, count(*) AS n,
    array_to_string(list(event_id ORDER BY k DESC), ',') AS trend FROM r WHERE k <= 8 GROUP BY user_id""",
)
def latest_and_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    r = _events(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 8")
    trend = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "event_id"))), lambda x: x.event_id.cast("string"))
    return r.groupBy("user_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("event_id"))).alias("latest"), F.count("*").alias("n"), F.array_join(trend, ",").alias("trend")
    )


@query(
    "page_with_total",
    """SELECT o_orderkey, total FROM (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P')
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    page = mine.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25)
    return page.select("o_orderkey", mine.agg(F.count("*")).scalar().alias("total"))


@query(
    "last_log_lines",
    """SELECT user_id, event_id, CAST(n AS BIGINT) AS seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE k <= 100""",
)
def last_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    up = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, sf_dir).withColumns({"k": F.row_number().over(down), "seq": F.row_number().over(up).cast("long")})
    return e.where("k <= 100").select("user_id", "event_id", "seq")


@query(
    "full_outer_portfolio",
    """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS latest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT c_custkey, o_custkey, n, latest FROM customer c FULL JOIN o ON c.c_custkey = o.o_custkey""",
)
def full_outer_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    o = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "full_outer").orderBy(F.col("n").asc_nulls_last(), "c_custkey")


@query(
    "snapshot_diff",
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
    b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    a = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("a_hash"))
    b = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(edited, 256).alias("b_hash"))
    both = a.join(b, "doc_id", "full_outer").where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
    change = F.when(F.col("a_hash").isNull(), "added").when(F.col("b_hash").isNull(), "removed").otherwise("modified")
    return both.select("doc_id", change.alias("change"))


@query(
    "sha_cache_antijoin",
    """WITH c AS (SELECT DISTINCT sha256(lang || ':' || text) AS h FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(lang || ':' || text) NOT IN (SELECT h FROM c)""",
)
def sha_cache_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("lang", F.lit(":"), "text"), 256).alias("h"))
    cache = d.where("doc_id % 2 = 0").select("h")
    return d.where("doc_id % 2 = 1").join(cache, "h", "left_anti").select("doc_id")


@query(
    "cache_eviction",
    """WITH o AS (SELECT doc_id, source, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k,
    sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM documents)
    SELECT doc_id, source, CAST(total AS BIGINT) AS total FROM o WHERE k <= 40 AND total <= 60000""",
)
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("size"))
    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    newest = d.withColumn("k", F.row_number().over(w)).where("k <= 40")  # cut before the shuffle, so a large source is spread out
    total = newest.withColumn("total", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.where("total <= 60000").select("doc_id", "source", F.col("total").cast("long").alias("total"))


@query(
    "set_operations",
    """WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08)
    SELECT 'union_all' AS op, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    b = li.where("l_discount > 0.08").select(F.col("l_partkey").alias("k"))
    ops = {"union_all": a.unionAll(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in ops.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out
