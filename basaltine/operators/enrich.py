"""Enrichment of a code graph: roles and subtypes of nodes by their text, and the edges that follow from them.

Nodes are (node, type, name, value, source_code, file, line, col), syntax edges (src, dst). Keyword tables are fixed
values; each predicate is one boolean column. Edges come from equi-joins on the syntax or the file, from as-of and band
joins on the line, and from reachability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.operators import graph, joins, taint

#: Words that make a node's role.
CALLS = ["CALL_EXPRESSION", "EXTERNAL_CALL", "SYSTEM_CALL", "EVAL_CALL", "ORM_QUERY"]
SOURCE_WORDS = ["request.", "req.", "input(", "argv", "stdin", "body", "query"]
SQL_METHODS = ["execute", "executemany", "raw", "query", "filter", "filter_by", "find", "find_one", "aggregate", "update", "delete", "insert"]
COMMANDS = ["eval", "exec", "system", "popen", "subprocess"]
SANITIZER_WORDS = ["escape", "sanitize", "clean", "validate", "validator", "bleach", "markupsafe", "quote", "param", "parameterized"]
AUTH_WORDS = ["login_required", "permission_required", "authorize", "authenticated", "is_authenticated", "jwt_required", "require_auth", "has_permission", "requireauth", "permission", "role_required", "roles_required", "can_access", "authmiddleware"]
MIDDLEWARE_WORDS = ["middleware", ".use(", "before_request"]
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "options", "head", "route"]
ORM_HINTS = ["objects.", "session.", "db.session", "query.", ".filter", ".filter_by", ".find(", ".find_one(", ".aggregate(", ".execute(", ".raw("]
TEXT_TYPES = ["LITERAL", "FSTRING", "TEMPLATE_LITERAL", "STRING_CONCAT", "SQL_QUERY"]
ARGUMENT_TYPES = ["IDENTIFIER", "PARAMETER", "LITERAL", "EXPRESSION", "MEMBER_ACCESS", "ATTRIBUTE_ACCESS", "CALL_EXPRESSION", "FSTRING", "TEMPLATE_LITERAL", "STRING_CONCAT", "STRING_FORMAT", "STRING_PERCENT"]
HANDLERS = ["FUNCTION", "ASYNC_FUNCTION", "METHOD", "ARROW_FUNCTION"]
FLOWS = ["DFG_FLOW", "DFG_INTERP", "DFG_TEMPLATE", "DFG_PARAM_PASS", "DFG_RET", "DFG_PROPERTY", "DFG_ATTR", "CALL_ARG", "CALL_RETURN"]
#: Subtypes of calls by their text, the first that fits.
CALL_KINDS = {
    "EVAL_CALL": ["eval(", "exec(", "function("],
    "SYSTEM_CALL": ["system(", "popen(", "subprocess.", "child_process"],
    "EXTERNAL_CALL": ["fetch(", "axios.", "requests.", "http.", "https."],
    "ORM_QUERY": ["execute(", ".query(", ".raw(", ".filter(", ".find(", ".aggregate("],
}
#: Words of statements in a string, of guards in a decorator; lines that a statement and its call are apart.
SQL_STARTS = ["select ", "insert ", "update ", "delete ", "drop ", " where "]
GUARDS = ["login_required", "permission_required", "authorize", "is_authenticated"]
NEAR = 8


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _text() -> Column:
    return F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("source_code", F.lit(""))))


def call_kind(text: Column) -> Column:
    """The subtype of a call by its text."""
    out = F.when(F.lit(False), "")
    for kind, words in CALL_KINDS.items():
        out = out.when(has_any(F.lower(text), words), kind)
    return out.otherwise("CALL_EXPRESSION")


def string_kind(text: Column) -> Column:
    """The subtype of a string: one with fields, a statement, or a plain one."""
    return F.when(F.ltrim(text).rlike("^[fF]['\"]"), "FSTRING").when(has_any(F.lower(text), SQL_STARTS), "SQL_QUERY").otherwise("LITERAL")


def binary_kind(text: Column) -> Column:
    """Whether an operation joins strings: a plus and a quote."""
    return F.when(F.contains(text, F.lit("+")) & text.rlike("['\"`]"), "STRING_CONCAT").otherwise("BINARY_OP")


def decorator_kind(text: Column) -> Column:
    """A guard, a route or something else; the word for a guard counts more."""
    return F.when(has_any(text, GUARDS), "AUTH_GUARD").when(has_any(text, ["route", "router."]), "ROUTE_DECORATOR").otherwise("EXPRESSION")


def with_roles(nodes: DataFrame) -> DataFrame:
    """nodes with is_source, is_sink, is_sanitizer, is_auth, is_middleware, is_route, is_sql, is_db_call."""
    text, call = _text(), F.col("type").isin(CALLS)
    body = F.concat(F.coalesce("value", F.lit("")), F.lit(" "), F.coalesce("source_code", F.lit("")))
    return nodes.withColumns(
        {
            "is_source": (F.col("type") == "PARAMETER") | has_any(text, SOURCE_WORDS),
            "is_sink": call & has_any(text, SQL_METHODS + COMMANDS),
            "is_sanitizer": call & has_any(text, SANITIZER_WORDS),
            "is_auth": F.col("type").isin("AUTH_GUARD", "AUTH_CHECK", "PERMISSION_CHECK") | has_any(text, AUTH_WORDS),
            "is_middleware": (F.col("type") == "MIDDLEWARE") | has_any(text, MIDDLEWARE_WORDS),
            "is_route": F.col("type").isin("ROUTE_DECORATOR", "HTTP_ENDPOINT") | (call & has_any(text, [f".{m}(" for m in HTTP_METHODS])),
            "is_sql": F.col("type").isin(TEXT_TYPES) & body.rlike(r"(?i)\b(select|insert|update|delete|drop|alter|from|where)\b"),
            "is_db_call": call & has_any(text, SQL_METHODS + ORM_HINTS),
        }
    )


def _edge(df: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return df.where(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"))


def call_arguments(nodes: DataFrame, syntax: DataFrame) -> DataFrame:
    """(call, arg): children of calls that are arguments; not names that are a part of the callee's."""
    calls = nodes.where(F.col("type").isin(CALLS)).select(F.col("node").alias("call"), F.coalesce("name", F.lit("")).alias("callee"))
    kids = nodes.where(F.col("type").isin(ARGUMENT_TYPES)).select(F.col("node").alias("arg"), F.col("type").alias("kind"), F.coalesce("name", F.lit("")).alias("own"))
    met = syntax.select(F.col("src").alias("call"), F.col("dst").alias("arg")).join(calls, "call").join(kids, "arg")
    part = F.col("kind").isin("IDENTIFIER", "MEMBER_ACCESS") & (F.col("own") != "") & F.contains("callee", F.col("own"))
    return met.where(~part).select("call", "arg").distinct()


def taint_edges(nodes: DataFrame, syntax: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, type): marks of sources and sinks, arguments of sanitizers, and flows from sources to the sinks they reach."""
    n = with_roles(nodes)
    marks = [n.where(c).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(t).alias("type")) for c, t in (("is_source", "TAINT_SOURCE"), ("is_sink", "TAINT_SINK"))]
    clean = call_arguments(nodes, syntax).join(n.where("is_sanitizer").select(F.col("node").alias("call")), "call", "left_semi")
    flows = graph.cut(taint.between(edges.where(F.col("type").isin(FLOWS)), n.where("is_source"), n.where("is_sink")))
    reach = graph.closure(flows, n.where("is_source").select("node")).where("depth > 0")
    hits = reach.join(n.where("is_sink").select("node"), "node", "left_semi")
    return marks[0].unionByName(marks[1]).unionByName(_edge(clean, "arg", "call", "SANITIZED")).unionByName(_edge(hits, "start", "node", "TAINT_FLOW"))


def http_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, type): routes to the next handler in their file, the file's middleware and the guards above to that handler."""
    place = F.struct(F.col("line"), F.coalesce("col", F.lit(0)))
    # the words are looked for once; nodes without a part in this are gone before anything moves
    n = with_roles(nodes).select("node", "type", "file", "line", place.alias("place"), "is_auth", "is_middleware", "is_route")
    n = graph.cut(n.where(F.col("type").isin(HANDLERS) | F.col("is_auth") | F.col("is_middleware") | F.col("is_route")))
    handlers = n.where(F.col("type").isin(HANDLERS)).groupBy("file", "line").agg(F.min_by("node", "place").alias("handler"))
    routes = n.where("is_route").select("file", F.col("node").alias("route"), "line")
    # the first handler at or after the line: forward in the order of negated lines, backwards
    met = joins.asof_backward(routes.withColumn("at", -F.col("line")), handlers.withColumn("h_at", -F.col("line")).withColumnRenamed("line", "h_line"), ["file"], "at", "h_at", ["handler", "h_line"])
    met = met.where("handler is not null")
    served = met.select("file", "handler", "h_line").distinct()
    middle = served.join(n.where("is_middleware").select("file", F.col("node").alias("m")), "file")
    guards = served.join(n.where("is_auth").select("file", F.col("node").alias("g"), F.col("line").alias("g_line")), "file").where("g_line <= h_line")
    return (
        _edge(met, "route", "handler", "HTTP_ROUTE")
        .unionByName(_edge(middle, "m", "handler", "HTTP_MIDDLEWARE"))
        .unionByName(_edge(guards, "handler", "g", "AUTH_COVERAGE"))
        .unionByName(_edge(guards, "g", "handler", "PERMISSION_FLOW"))
        .distinct()
    )


def nearest_ancestors(nodes: DataFrame, syntax: DataFrame, starts: DataFrame, kinds: list[str]) -> DataFrame:
    """(node, ancestor): the closest ancestor of one of the kinds; of several at one distance the smallest."""
    up = syntax.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    met = graph.closure(up, starts.select("node")).where("depth > 0").select(F.col("start").alias("child"), "node", "depth")
    met = met.join(nodes.where(F.col("type").isin(kinds)).select("node"), "node", "left_semi")
    return met.groupBy(F.col("child").alias("node")).agg(F.min_by("node", F.struct("depth", "node")).alias("ancestor"))


def database_edges(nodes: DataFrame, syntax: DataFrame) -> DataFrame:
    """(src, dst, type): arguments of database calls, statements within eight lines of one, and what a statement stands in."""
    n = with_roles(nodes)
    calls = n.where("is_db_call").select("file", F.col("node").alias("call"), F.col("line").alias("c_line"))
    args = call_arguments(nodes, syntax).join(calls.select("call"), "call", "left_semi")
    queries = n.where("is_sql").select("file", F.col("node").alias("query"), F.col("line").alias("q_line"))
    close = joins.band(queries, calls, ["file"], "q_line", "c_line", NEAR)
    inside = nearest_ancestors(nodes, syntax, queries.select(F.col("query").alias("node")), [*CALLS, "ASSIGNMENT"])
    return (
        _edge(args, "arg", "call", "SQL_PARAM")
        .unionByName(_edge(close, "query", "call", "ORM_FLOW"))
        .unionByName(_edge(inside, "node", "ancestor", "SQL_PARAM"))
        .distinct()
    )


def edge_statistics(edges: DataFrame) -> DataFrame:
    """(type, n, uncertain): edges by type, and those of less than full confidence; edges without one aren't counted so."""
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 1.0).alias("uncertain"))


def path_features(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, n): how many edges of each type a path (id, path) goes over; a pair of nodes counts once for each type."""
    pairs = paths.select("id", F.posexplode(F.arrays_zip(F.col("path").alias("a"), F.slice("path", F.lit(2), F.size("path")).alias("b"))).alias("pos", "p"))
    pairs = pairs.select("id", "pos", F.col("p.a").alias("src"), F.col("p.b").alias("dst")).where("dst is not null")
    return pairs.join(edges.select("src", "dst", "type").distinct(), ["src", "dst"]).groupBy("id", "type").agg(F.count("*").alias("n"))
