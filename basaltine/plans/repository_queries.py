"""Scopes, taint and whole-repository builds over tables that are derived from the driver's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators import chains, matches, policies, substrings, taint
from basaltine.operators.repository import RepositoryGraph
from basaltine.plans.registry import query
from basaltine.session import new_folder, table
from basaltine.sources import html_graph

#: Pieces of lines are names; a scope is a line, a block of two lines, a turn, a conversation, none or an unknown one.
NAMES_SQL = """l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS j, unnest(string_split(text, chr(10))) AS x, 'c' || conv_id AS root, 'c' || conv_id || '.t' || turn AS up FROM conversations),
p AS (SELECT *, generate_subscripts(string_split(x, ', '), 1) - 1 AS k, unnest(string_split(x, ', ')) AS piece FROM l),
n AS (SELECT up || '.l' || j || '.p' || k AS node, 'n' || length(piece) % 6 || '_' || conv_id AS name, turn * 1000 + j AS line, k, length(piece) AS len,
    CASE (length(piece) // 2) % 6 WHEN 0 THEN up || '.l' || j WHEN 1 THEN up || '.b' || (j // 2) WHEN 2 THEN up WHEN 3 THEN root WHEN 4 THEN NULL ELSE 'lost' END AS scope FROM p),
s AS (SELECT DISTINCT up || '.l' || j AS scope, up || '.b' || (j // 2) AS parent FROM l UNION SELECT up || '.b' || (j // 2), up FROM l UNION SELECT up, root FROM l UNION SELECT root, 'global' FROM l),
chain(scope, outer_scope, depth) AS (SELECT scope, scope, 0 FROM s UNION ALL SELECT c.scope, s.parent, c.depth + 1 FROM chain c JOIN s ON s.scope = c.outer_scope),
seen AS (SELECT scope, outer_scope, depth FROM chain UNION ALL SELECT x, x, 0 FROM (VALUES ('lost'), ('global')) v(x))"""


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(names, scopes)."""
    conv = table(spark, sf_dir, "conversations").select("turn", "text", "conv_id", F.concat(F.lit("c"), "conv_id").alias("root")).withColumn("up", F.concat("root", F.lit(".t"), "turn"))
    lines = conv.select("conv_id", "turn", "root", "up", F.posexplode(F.split("text", "\n", -1)).alias("j", "x"))
    line, block = F.concat("up", F.lit(".l"), "j"), F.concat("up", F.lit(".b"), F.floor(F.col("j") / 2))
    pieces = lines.select("conv_id", "turn", "root", "up", "j", F.posexplode(F.split("x", ", ", -1)).alias("k", "piece")).withColumn("len", F.char_length("piece"))
    kind = F.floor(F.col("len") / 2) % 6
    scope = F.when(kind == 0, line).when(kind == 1, block).when(kind == 2, F.col("up")).when(kind == 3, F.col("root")).when(kind == 5, "lost")
    names = pieces.select(
        F.concat(line, F.lit(".p"), "k").alias("node"),
        F.concat(F.lit("n"), F.col("len") % 6, F.lit("_"), "conv_id").alias("name"),
        (F.col("turn") * 1000 + F.col("j")).alias("line"),
        "k",
        "len",
        scope.alias("scope"),
    )
    inside = lambda a, b: lines.select(a.alias("scope"), b.alias("parent"))
    scopes = inside(line, block).unionByName(inside(block, F.col("up"))).unionByName(inside(F.col("up"), F.col("root"))).unionByName(inside(F.col("root"), F.lit(chains.GLOBAL)))
    return names, scopes.distinct()


@query(
    "scope_definitions",
    f"""WITH RECURSIVE {NAMES_SQL}, u AS (SELECT * FROM n WHERE k % 3 <> 0), d AS (SELECT * FROM n WHERE k % 3 = 0),
    m AS (SELECT u.node AS use, d.node AS def, d.line FROM u JOIN d ON u.name = d.name AND d.line < u.line
        WHERE u.scope IS NULL OR d.scope IS NULL OR EXISTS (SELECT 1 FROM seen WHERE seen.scope = u.scope AND seen.outer_scope = d.scope)),
    b AS (SELECT use, arg_min(def, (-line, def)) AS def FROM m GROUP BY use)
    SELECT u.node AS use, u.name, b.def FROM u LEFT JOIN b ON u.node = b.use""",
)
def scope_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, scopes = _names(spark, sf_dir)
    uses = names.where("k % 3 <> 0").select(F.col("node").alias("use"), "name", "scope", "line")
    definitions = names.where("k % 3 = 0").select(F.col("node").alias("def"), "name", "scope", "line")
    return chains.reaching_definitions(uses, definitions, chains.scope_chains(scopes)).select("use", "name", "def")


@query(
    "scope_functions",
    f"""WITH RECURSIVE {NAMES_SQL}, sym AS (SELECT coalesce(scope, 'global') AS scope, name, min(node) AS function FROM n WHERE k % 3 = 0 AND len % 4 <> 0 GROUP BY ALL),
    near AS (SELECT u.node, arg_min(function, depth) AS function FROM n u JOIN seen ON seen.scope = coalesce(u.scope, 'global') JOIN sym ON sym.scope = outer_scope AND sym.name = u.name GROUP BY u.node),
    spare AS (SELECT name, arg_min(node, (line, node)) AS function FROM n WHERE k % 3 = 1 AND len % 4 = 1 GROUP BY name)
    SELECT u.node AS use, u.name, coalesce(near.function, spare.function) AS function FROM n u LEFT JOIN near USING (node) LEFT JOIN spare USING (name) WHERE u.k % 3 = 2""",
)
def scope_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, scopes = _names(spark, sf_dir)
    symbols = names.where("k % 3 = 0").select(F.coalesce("scope", F.lit(chains.GLOBAL)).alias("scope"), "name", F.when(F.col("len") % 4 != 0, F.col("node")).alias("function"))
    assigned = names.where("k % 3 = 1").select("name", F.struct("line", "node").alias("ord"), F.when(F.col("len") % 4 == 1, F.col("node")).alias("function"))
    uses = names.where("k % 3 = 2").select(F.col("node").alias("use"), "name", "scope")
    return chains.resolve_functions(uses, symbols, chains.scope_chains(scopes), assigned).select("use", "name", "function")


@query(
    "reexport_lift",
    """WITH RECURSIVE link AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 100 = 10 THEN p_partkey - 9 WHEN p_partkey % 20 <> 0 THEN p_partkey + 1 END AS dst FROM part WHERE p_partkey % 20 <> 19),
    way(src, here, hops) AS (SELECT src, dst, 1 FROM link WHERE dst IS NOT NULL UNION ALL SELECT w.src, l.dst, hops + 1 FROM way w JOIN link l ON l.src = w.here WHERE l.dst IS NOT NULL AND hops < 40),
    fin AS (SELECT src, here AS final FROM way WHERE here NOT IN (SELECT src FROM link WHERE dst IS NOT NULL)),
    e AS (SELECT l_partkey AS src, l_suppkey AS dst, max(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 20 END) AS confidence FROM lineitem GROUP BY ALL),
    n AS (SELECT final AS src, dst, least(1.0, coalesce(confidence, 0.8)) AS c FROM e JOIN fin USING (src) UNION ALL SELECT e.src, final, least(1.0, coalesce(confidence, 0.8)) FROM e JOIN fin ON fin.src = e.dst)
    SELECT src, dst, CAST(max(c) AS DOUBLE) AS confidence FROM n WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM e) GROUP BY ALL""",
)
def reexport_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are passed on in chains of up to 18 parts; ten of each hundred are a cycle."""
    key = F.col("p_partkey")
    to = F.when(key % 100 == 10, key - 9).when(key % 20 != 0, key + 1)
    names = table(spark, sf_dir, "part").where("p_partkey % 20 <> 19").select(key.alias("src"), to.alias("dst"))
    sure = F.max(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 20)).cast("double")
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(sure.alias("confidence"))
    return chains.lift(e, names)


CALLS = ["request.args.get", "cursor.Execute", "open_file", "print", "stdin_line", "os.System", "df.writeLines"]
TAINT_SQL = f"""c AS (SELECT count(*) AS c FROM part), k AS (SELECT p_partkey AS node, CASE WHEN p_size % 25 = 0 THEN 'PARAMETER' WHEN p_size % 5 = 1 THEN 'CALL_EXPRESSION' ELSE 'IDENTIFIER' END AS type,
    {CALLS}[CAST(p_partkey % 7 AS INT) + 1] AS name FROM part),
e AS (SELECT p_partkey AS src, (p_partkey * 3 + p_size) % c AS dst FROM part, c WHERE p_size % 4 <> 3 UNION SELECT p_partkey, (p_partkey + p_size + 1) % c FROM part, c WHERE p_size % 3 = 0),
r AS (SELECT node, CASE WHEN type = 'PARAMETER' THEN 'function_parameter' WHEN type <> 'CALL_EXPRESSION' THEN NULL WHEN name = 'request.args.get' THEN 'http_request_data' WHEN name = 'stdin_line' THEN 'user_input' WHEN name = 'open_file' THEN 'file_read' END AS source_rule,
    CASE WHEN type <> 'CALL_EXPRESSION' THEN NULL WHEN name = 'cursor.Execute' THEN 'sql_execution' WHEN name = 'os.System' THEN 'command_execution' WHEN name = 'df.writeLines' THEN 'file_write' END AS sink_rule FROM k)"""


@query(
    "taint_flows",
    f"""WITH RECURSIVE {TAINT_SQL}, w(source, node, depth) USING KEY (source, node) AS (SELECT node, node, 0 FROM r WHERE source_rule IS NOT NULL
    UNION SELECT w.source, e.dst, min(w.depth) + 1 FROM w JOIN e ON w.node = e.src WHERE w.depth < 19 AND NOT EXISTS (SELECT 1 FROM recurring.w x WHERE x.source = w.source AND x.node = e.dst) GROUP BY ALL)
    SELECT source, w.node AS sink, a.source_rule, b.sink_rule, depth, CASE WHEN depth < 3 THEN 'critical' WHEN depth < 6 THEN 'high' WHEN depth < 10 THEN 'medium' ELSE 'low' END AS severity
    FROM w JOIN r a ON a.node = source JOIN r b ON b.node = w.node WHERE b.sink_rule IS NOT NULL""",
)
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    p = p.withColumn("c", p.agg(F.count("*")).scalar())
    kind = F.when(size % 25 == 0, "PARAMETER").when(size % 5 == 1, "CALL_EXPRESSION").otherwise("IDENTIFIER")
    nodes = p.select(key.alias("node"), kind.alias("type"), F.get(F.array(*[F.lit(c) for c in CALLS]), (key % 7).cast("int")).alias("name"))
    one = p.where("p_size % 4 <> 3").select(key.alias("src"), ((key * 3 + size) % F.col("c")).alias("dst"), F.lit("DFG_FLOW").alias("type"))
    two = p.where("p_size % 3 = 0").select(key.alias("src"), ((key + size + 1) % F.col("c")).alias("dst"), F.lit("CFG_NEXT").alias("type"))
    other = p.select(key.alias("src"), (key * 7 % F.col("c")).alias("dst"), F.lit("AST_CHILD").alias("type"))
    return taint.taint_flows(nodes, one.unionByName(two).unionByName(other))


def page_keys(path: Column) -> Column:
    """What a page answers to: the first part of its path."""
    first = F.regexp_extract(path, "^[a-z]+://[^/]*(/[^/?#]+)", 1)
    return F.array_compact(F.array(F.nullif(first, F.lit(""))))


def page_graph(spark: SparkSession, root: str) -> RepositoryGraph:
    """A stored graph of pages, with their links as references."""
    parse = lambda files: html_graph.nodes(files, "hash", "content").withColumnRenamed("file", "hash")
    edges = lambda n: html_graph.edges(n.withColumnRenamed("hash", "file")).withColumnRenamed("file", "hash")
    refs = lambda n: n.where("type = 'LINK' and value is not null").select("hash", F.col("value").alias("ref"))
    return RepositoryGraph(spark, root, parse, edges, refs, page_keys, digits=1)


@query(
    "repository_increment",
    r"""WITH a AS (SELECT url AS path, CASE WHEN page_id % 5 = 0 THEN html || '<a href="/old">x</a>' ELSE html END AS html FROM pages WHERE page_id % 7 <> 0), b AS (SELECT url AS path, coalesce(html, '') AS html FROM pages),
    keys AS (SELECT path, regexp_extract(path, '^[a-z]+://[^/]*(/[^/?#]+)', 1) AS key FROM b), t AS (SELECT key, min(path) AS target FROM keys WHERE key <> '' GROUP BY key),
    refs AS (SELECT DISTINCT path, replace(replace(replace(replace(unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS ref FROM b),
    moved AS (SELECT key FROM keys WHERE path NOT IN (SELECT path FROM a) AND key <> ''),
    changed AS (SELECT b.path FROM b LEFT JOIN a USING (path) WHERE a.html IS NULL OR a.html <> b.html)
    SELECT 'link' AS kind, path, ref, target, NULL AS n FROM refs LEFT JOIN t ON ref = key
    UNION ALL SELECT 'parsed', NULL, NULL, NULL, count(DISTINCT html) FROM b WHERE html NOT IN (SELECT html FROM a)
    UNION ALL SELECT 'relinked', NULL, NULL, NULL, count(DISTINCT path) FROM (SELECT path FROM changed UNION ALL SELECT path FROM refs WHERE ref IN (SELECT key FROM moved))""",
)
def repository_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of most pages, some of them in an older form, then one of all as they are: its links, and what it had to do."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    old = F.when(F.col("page_id") % 5 == 0, F.concat("content", F.lit('<a href="/old">x</a>'))).otherwise(F.col("content"))
    graph = page_graph(spark, new_folder(spark, "repository"))
    graph.build(pages.where("page_id % 7 <> 0").withColumn("content", old))
    made = graph.build(pages)
    none = F.lit(None).cast("string")
    links = made.links.select(F.lit("link").alias("kind"), "path", "ref", "target", F.lit(None).cast("long").alias("n"))
    count = lambda kind, n: spark.range(1).select(F.lit(kind).alias("kind"), none.alias("path"), none.alias("ref"), none.alias("target"), F.lit(n).cast("long").alias("n"))
    return links.unionByName(count("parsed", made.parsed)).unionByName(count("relinked", made.relinked))


@query(
    "substring_links",
    """WITH n AS (SELECT DISTINCT replace(replace(replace(replace(unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS action FROM pages)
    SELECT n.action, p.page_id AS target FROM n JOIN pages p ON n.action <> '' AND contains(p.url, n.action)""",
)
def substring_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages have an address that contains what some page links to."""
    pages = table(spark, sf_dir, "pages")
    links = html_graph.nodes(pages.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("content"))).where("type = 'LINK' and value is not null")
    actions = links.select(F.col("value").alias("action")).distinct()
    return substrings.contained(actions, pages.select(F.col("page_id").alias("target"), "url"), "action", "url").select("action", "target")


OFFSETS = {"pair": r"[a-z]+tion[^a-z]+[a-z]+", "capital": r"[A-Z][a-z]+", "line": r"\.\n+(?:[A-Z]|[a-z])"}


@query(
    "match_offsets",
    f"""WITH m AS (SELECT doc_id, pattern, string_split_regex(text, re) AS b, regexp_extract_all(text, re) AS x FROM documents, (VALUES {", ".join(f"('{k}', '{v}')" for k, v in OFFSETS.items())}) v(pattern, re)),
    e AS (SELECT doc_id, pattern, generate_subscripts(x, 1) AS n, unnest(x) AS match, unnest(b[1:len(x)]) AS before FROM m WHERE len(x) > 0),
    s AS (SELECT *, sum(length(before) + length(match)) OVER w AS "end", sum(length(before || match) - length(replace(before || match, chr(10), ''))) OVER w + 1 AS end_line FROM e
        WINDOW w AS (PARTITION BY doc_id, pattern ORDER BY n))
    SELECT doc_id, pattern, n, CAST("end" - length(match) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(end_line - (length(match) - length(replace(match, chr(10), ''))) AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, match FROM s""",
)
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.all_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", OFFSETS)


#: Documents that are written from parts: statements with keys in another order each, single values and lists, other effects, and what is no document.
POLICY_SQL = """CASE WHEN p_partkey % 13 = 0 THEN '{"Statement": [' WHEN p_partkey % 13 = 1 THEN '{"Statement": {"Effect": "Allow", "Action": "*"}}' ELSE
    '{"Version": "1", "Statement": [{"Action": ' || CASE p_size % 4 WHEN 0 THEN '"*"' WHEN 1 THEN '["s3:Get' || p_size || '", "logs:Put"]' WHEN 2 THEN '["kms:Decrypt", "*"]' ELSE '"iam:Pass"' END
    || ', "Effect": "' || CASE WHEN p_partkey % 5 = 0 THEN 'Deny' ELSE 'Allow' END || '"}, {"Effect": "Allow", "Resource": ["arn:' || CASE p_partkey % 3 WHEN 0 THEN 'SecretsManager' WHEN 1 THEN 'x' ELSE 'log-group' END
    || '"], "Action": [' || CASE WHEN p_partkey % 7 = 0 THEN '"*"' ELSE '"a:b"' END || '], "Deep": {"z": [{"Max_Age": ' || p_size || '}, {"max_age": 1}]}}, 7]}' END"""
RAW_POLICY = POLICY_SQL.replace("\n", " ")


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(RAW_POLICY).alias("content"))


@query(
    "policy_verdicts",
    f"""WITH d AS (SELECT p_partkey, {RAW_POLICY} AS content FROM part), s AS (SELECT p_partkey, unnest(CAST(json_extract(content, '$.Statement') AS JSON[])) AS s FROM d
        WHERE json_valid(content) AND json_type(content, '$.Statement') = 'ARRAY'),
    l AS (SELECT p_partkey, lower(s::VARCHAR) AS t, CASE json_type(s, '$.Action') WHEN 'ARRAY' THEN list_contains(json_extract_string(s, '$.Action[*]'), '*') ELSE json_extract_string(s, '$.Action') = '*' END AS open
        FROM s WHERE json_type(s) = 'OBJECT' AND json_extract_string(s, '$.Effect') = 'Allow'),
    c AS (SELECT p_partkey, CASE WHEN contains(t, 'secretsmanager') OR contains(t, 'kms:') THEN 'V13.3.2' WHEN contains(t, 'logs:') OR contains(t, 'log-group') THEN 'V16.4.2' ELSE 'V13.2.2' END AS control_id, open FROM l)
    SELECT p_partkey, control_id, CASE WHEN bool_or(open) THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN bool_or(open) THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM c GROUP BY ALL""",
)
def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _policies(spark, sf_dir).withColumn("statements", policies.allowed_statements(F.col("content")))
    rows = [F.struct(F.lit(c).alias("control_id"), policies.policy_verdict(F.col("statements"), c).alias("verdict")) for c in (policies.GENERAL, *policies.ABOUT)]
    said = read.select("p_partkey", F.inline(F.array(*rows))).where("verdict is not null")
    return said.withColumn("confidence", F.when(F.col("verdict") == "fail", 0.6).otherwise(0.4))


@query(
    "json_first_values",
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS found FROM part WHERE p_partkey % 13 > 1",
)
def json_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.find_first(_policies(spark, sf_dir), "content", "p_partkey", ["max_age"])
