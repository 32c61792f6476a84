"""Links between modules and flows between functions, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltine.operators import linking
from basaltine.plans.registry import query
from basaltine.session import table
from basaltine.sources import modules


@query(
    "module_resolution",
    r"""WITH f AS (SELECT page_id AS ord, url AS target, regexp_replace(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '\.[a-zA-Z0-9_]+$', ''), '/(index|__init__)$', '') AS path FROM pages),
    m AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+/[0-9]+)', 1) AS module FROM pages),
    c AS (SELECT module, target, ord, CASE WHEN path = module THEN 0 ELSE 1 END AS rank FROM m JOIN f ON module <> '' AND (path = module OR ends_with(path, '/' || module) OR ends_with(module, '/' || path)))
    SELECT module, arg_min(target, (rank, ord, target)) AS target FROM c GROUP BY module""",
)
def module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url", F.regexp_extract("url", "://([^?#]*)", 1).alias("file"))
    modules = pages.select(F.lit("m").alias("file"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+/[0-9]+)", 1).alias("module")).where("module <> ''").distinct()
    met = linking.resolve_imports(modules, pages.select("file", "ord")).where("target is not null")
    first = pages.groupBy("file").agg(F.min_by("url", "ord").alias("target"))
    return met.select("module", F.col("target").alias("file")).join(first, "file").select("module", "target")


@query(
    "import_export_links",
    """WITH e AS (SELECT 'm' || p_size AS target, p_brand AS export, bool_or(p_partkey % 7 = 0) AS is_default FROM part GROUP BY ALL),
    i AS (SELECT DISTINCT 'o' || l_suppkey % 20 AS file, 'm' || l_partkey % 50 AS target, CASE l_linenumber % 3 WHEN 0 THEN '*' WHEN 1 THEN 'default' ELSE 'Brand#' || l_partkey % 60 END AS name FROM lineitem)
    SELECT DISTINCT file, i.target, name, export FROM i JOIN e ON i.target = e.target AND (name = '*' OR (name = 'default' AND is_default) OR name = export)""",
)
def import_export_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("m"), "p_size").alias("file"), F.col("p_brand").alias("name"))
    e = e.agg(F.bool_or(F.col("p_partkey") % 7 == 0).alias("is_default"))
    third = F.col("l_linenumber") % 3
    name = F.when(third == 0, "*").when(third == 1, "default").otherwise(F.concat(F.lit("Brand#"), (F.col("l_partkey") % 60).cast("string")))
    i = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), (F.col("l_suppkey") % 20).cast("string")).alias("file"), F.concat(F.lit("m"), (F.col("l_partkey") % 50).cast("string")).alias("target"), name.alias("name")
    )
    i = i.distinct().withColumn("local", F.col("name"))
    return linking.link_exports(i, e).select("file", "target", "name", "export")


@query(
    "return_flows",
    """WITH r AS (SELECT p_partkey AS f, p_partkey * 10 AS value FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_partkey * 10 + 1 END FROM part WHERE p_size % 2 = 0)
    SELECT DISTINCT value AS src, l_orderkey * 10 + l_linenumber AS dst FROM lineitem JOIN r ON l_partkey = f WHERE value IS NOT NULL""",
)
def return_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = p.select(F.col("p_partkey").alias("function"), (F.col("p_partkey") * 10).alias("value"))
    second = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("function"), F.when(F.col("p_size") % 3 != 0, F.col("p_partkey") * 10 + 1).alias("value"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("callee"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"))
    return linking.return_flows(calls, first.unionByName(second))


@query(
    "closure_flows",
    """SELECT a.conv_id * 1000 + a.turn AS function, b.role AS name, b.conv_id * 1000 + b.turn AS src, (a.conv_id * 1000 + a.turn) * 10 AS dst
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.role <> b.role""",
)
def closure_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn", "role")
    functions = c.where("turn > 0").select(F.col("node").alias("function"), (F.col("node") - 1).alias("parent_scope"))
    definitions = c.select(F.col("node").alias("scope"), F.col("role").alias("name"), "node")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    used = c.withColumn("before", before).withColumn("name", F.explode(F.array_compact(F.array("role", "before"))))
    uses = used.select(F.col("node").alias("function"), "name", (F.col("node") * 10).alias("node"))
    return linking.closure_flows(functions, definitions, uses)


@query(
    "callback_flows",
    """WITH p AS (SELECT n_nationkey AS f, k AS pos, 'p' || k AS name, n_nationkey * 100 + k AS node FROM nation, (VALUES (0), (1), (2)) v(k)),
    s AS (SELECT DISTINCT o_custkey % 25 AS callee, CAST(o_orderkey % 3 AS INT) AS pos, o_custkey % 24 AS cb FROM orders),
    c AS (SELECT DISTINCT l_suppkey % 25 AS f, 'p' || l_linenumber % 3 AS name, l_linenumber % 2 AS k, l_suppkey AS arg FROM lineitem)
    SELECT DISTINCT c.arg AS src, CAST(own.node AS BIGINT) AS dst, 0.8::DOUBLE AS confidence FROM s JOIN p taken ON taken.f = s.callee AND taken.pos = s.pos
    JOIN c ON c.f = s.callee AND c.name = taken.name JOIN p own ON own.f = s.cb AND own.pos = c.k""",
)
def callback_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    p = table(spark, sf_dir, "nation").select(key.alias("function"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("pos"))
    p = p.withColumns({"name": F.concat(F.lit("p"), "pos"), "node": F.col("function") * 100 + F.col("pos")})
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    passed = o.select((F.col("o_custkey") % 25).alias("callee"), (F.col("o_orderkey") % 3).cast("int").alias("pos"), (F.col("o_custkey") % 24).alias("callback")).distinct()
    inside = li.select(
        (F.col("l_suppkey") % 25).alias("function"), F.concat(F.lit("p"), (F.col("l_linenumber") % 3).cast("string")).alias("name"), (F.col("l_linenumber") % 2).alias("pos"), F.col("l_suppkey").alias("arg")
    )
    return linking.callback_flows(passed, p, inside.distinct())


@query(
    "module_statements",
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
    SELECT k, 'import' AS kind, './m' || n AS module, 'default' AS name, '$d' || k AS local FROM s UNION ALL SELECT k, 'import', './t' || n, '*', 'foo$' || k FROM s
    UNION ALL SELECT k, 'import', './x', 'a$' || k, 'b_' || n FROM s UNION ALL SELECT k, 'import', './r', '*', '$r' FROM s
    UNION ALL SELECT k, 'export', NULL, '$el' || k, '$el' || k FROM s UNION ALL SELECT k, 'export', NULL, 'default', CASE k % 3 WHEN 0 THEN 'handler$' || k WHEN 1 THEN 'Box' END FROM s""",
)
def module_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of modules that are written from suppliers, read back."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    last = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("module.exports = function handler$"), k, F.lit("() {};")))
    last = last.when(F.col("s_suppkey") % 3 == 1, "export = Box;").otherwise("exports = (a) => a;")
    lines = [
        F.concat(F.lit("import $d"), k, F.lit(" from './m"), n, F.lit("';")),
        F.concat(F.lit("import foo$"), k, F.lit(" = require('./t"), n, F.lit("');")),
        F.concat(F.lit("import { a$"), k, F.lit(" as b_"), n, F.lit(" } from './x';")),
        F.lit("const $r = require('./r'); // import not from './y'"),
        F.concat(F.lit("export const $el"), k, F.lit(" = 1;")),
        last,
    ]
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("file"), F.lit("typescript").alias("language"), F.concat_ws("\n", *lines).alias("content"))
    columns = lambda df, kind: df.select(F.col("file").alias("k"), F.lit(kind).alias("kind"), "module", "name", "local")
    return columns(modules.imports(files), "import").unionByName(columns(modules.exports(files), "export"))
