"""Syntax trees that are derived from conversations: their numbers, the flow of control, strings and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators import trees
from basaltine.plans.registry import query
from basaltine.session import table, written

SPANS = ["IF_STATEMENT", "FOR_STATEMENT", "TRY_STATEMENT", "WHILE_STATEMENT"]
BLOCKS = ["IF_STATEMENT", "CALL_EXPRESSION", "WHILE_STATEMENT", "FUNCTION", "TRY_STATEMENT"]
LINES = ["ASSIGNMENT", "CALL_EXPRESSION", "RETURN", "IF_STATEMENT", "EXCEPT_HANDLER", "RAISE", "FSTRING", "TEMPLATE_LITERAL", "MEMBER_ACCESS"]
PIECES = ["IDENTIFIER", "LITERAL", "MEMBER_ACCESS", "PARAMETER"]


def _pick(kinds: list[str], n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} = {k} THEN '{t}'" for k, t in enumerate(kinds)) + " END"


#: A conversation is a file, a turn a function, four lines a statement, two lines a block, then lines and their pieces.
TREE_SQL = f"""d AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations),
l AS (SELECT conv_id, turn, generate_subscripts(ls, 1) - 1 AS j, unnest(ls) AS x, 'c' || conv_id || '.t' || turn AS up FROM d),
p AS (SELECT *, generate_subscripts(string_split(x, ', '), 1) - 1 AS k, unnest(string_split(x, ', ')) AS piece FROM l),
t AS (SELECT DISTINCT conv_id AS file, 'c' || conv_id AS node, NULL AS parent, 'FILE' AS type, 0::BIGINT AS line, 0::BIGINT AS col FROM d
UNION ALL SELECT conv_id, 'c' || conv_id || '.t' || turn, 'c' || conv_id, CASE role WHEN 'user' THEN 'METHOD' WHEN 'assistant' THEN 'FUNCTION' ELSE 'ASYNC_FUNCTION' END, turn * 1000, 1 FROM d
UNION ALL SELECT DISTINCT conv_id, up || '.s' || (j // 4), up, {_pick(SPANS, "(conv_id + turn + j // 4) % 4")}, turn * 1000 + 1 + 4 * (j // 4), 0 FROM l
UNION ALL SELECT DISTINCT conv_id, up || '.b' || (j // 2), up || '.s' || (j // 4), {_pick(BLOCKS, "(conv_id + j // 2) % 5")}, turn * 1000 + 1 + 2 * (j // 2), 1 FROM l
UNION ALL SELECT conv_id, up || '.l' || j, up || '.b' || (j // 2), {_pick(LINES, "length(x) % 9")}, turn * 1000 + 1 + j, 2 FROM l
UNION ALL SELECT conv_id, up || '.l' || j || '.p' || k, up || '.l' || j, {_pick(PIECES, "length(piece) % 4")}, turn * 1000 + 1 + j, 3 + k FROM p),
r(a, node) AS (SELECT node, node FROM t UNION ALL SELECT r.a, t.node FROM r JOIN t ON t.parent = r.node),
below AS (SELECT x.node AS a, y.node, x.file, x.parent, x.type AS a_type, x.line AS a_line, y.type, y.line, y.col FROM r JOIN t x ON x.node = r.a JOIN t y ON y.node = r.node WHERE r.a <> r.node)"""


def _of(kinds: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in kinds]), n.cast("int"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of trees, numbered once."""
    turn, conv = F.col("turn"), F.col("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit("c"), conv).alias("root")).withColumn("up", F.concat("root", F.lit(".t"), turn))
    lines = c.select("conv_id", "turn", "up", F.posexplode(F.split("text", "\n", -1)).alias("j", "x"))
    j = F.col("j")
    half, quarter = F.floor(j / 2), F.floor(j / 4)
    pieces = lines.select("conv_id", "turn", "up", "j", F.posexplode(F.split("x", ", ", -1)).alias("k", "piece"))
    name = lambda kind, n: F.concat("up", F.lit(kind), n)

    def rows(df, node, parent, kind, line, col, end, depth):
        """end: the line behind the node."""
        line = line.cast("long")
        opens = line * 1000 + col
        at = [node.alias("node"), parent.cast("string").alias("parent"), kind.alias("type"), line.cast("long").alias("line"), col.cast("long").alias("col")]
        return df.select(conv.alias("file"), *at, opens.alias("open"), (opens if end is None else end.cast("long") * 1000 - 1).alias("close"), F.lit(depth).alias("depth"))

    line = turn * 1000 + 1
    root = rows(c.select("conv_id", "root").distinct(), F.col("root"), F.lit(None), F.lit("FILE"), F.lit(0), F.lit(0), F.lit(10**9), 0)
    kind = F.when(F.col("role") == "user", "METHOD").when(F.col("role") == "assistant", "FUNCTION").otherwise("ASYNC_FUNCTION")
    parts = [
        rows(c, F.col("up"), F.col("root"), kind, turn * 1000, F.lit(1), (turn + 1) * 1000, 1),
        rows(lines.where(j % 4 == 0), name(".s", quarter), F.col("up"), _of(SPANS, (conv + turn + quarter) % 4), line + 4 * quarter, F.lit(0), line + 4 * quarter + 4, 2),
        rows(lines.where(j % 2 == 0), name(".b", half), name(".s", quarter), _of(BLOCKS, (conv + half) % 5), line + 2 * half, F.lit(1), line + 2 * half + 2, 3),
        rows(lines, name(".l", j), name(".b", half), _of(LINES, F.char_length("x") % 9), line + j, F.lit(2), line + j + 1, 4),
        rows(pieces, F.concat(name(".l", j), F.lit(".p"), "k"), name(".l", j), _of(PIECES, F.char_length("piece") % 4), line + j, 3 + F.col("k"), None, 5),
    ]
    for p in parts:
        root = root.unionByName(p)
    return written(trees.nested_sets(root), "tree")


@query(
    "tree_numbers",
    f"WITH RECURSIVE {TREE_SQL} SELECT t.file, t.node, (SELECT count(*) FROM below b WHERE b.a = t.node) AS descendants, "
    "(SELECT count(*) FROM below b WHERE b.node = t.node) AS ancestors FROM t",
)
def tree_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    ranges = t.select("file", (F.col("first") + 1).alias("from"), F.col("last").alias("to"))
    above = trees.within(t.select("file", "node", "first"), ranges, ["file"], "first", "from", "to").groupBy("file", "node").agg(F.count("*").alias("ancestors"))
    return t.select("file", "node", (F.col("last") - F.col("first")).alias("descendants")).join(above, ["file", "node"], "left").na.fill(0, ["ancestors"])


@query(
    "control_flow_edges",
    f"""WITH RECURSIVE {TREE_SQL},
    kids AS (SELECT *, last_value(node) OVER w AS end_node, last_value(line) OVER w AS end_line FROM t WHERE parent IS NOT NULL
        WINDOW w AS (PARTITION BY parent ORDER BY line, col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    run AS (SELECT *, lead(node) OVER (PARTITION BY parent ORDER BY line, col) AS nxt FROM kids WHERE type NOT IN ('IDENTIFIER', 'LITERAL', 'PARAMETER')),
    body AS (SELECT a, any_value(a_type) AS type, arg_min(node, (line, col)) AS b_first, arg_max(node, (line, col)) AS b_last FROM below
        WHERE line > a_line AND a_type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT') AND parent IS NOT NULL GROUP BY a),
    near AS (SELECT node, arg_max(a, len(a)) AS f FROM below WHERE a_type IN ('FUNCTION', 'ASYNC_FUNCTION', 'METHOD')
        AND type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT', 'TRY_STATEMENT', 'EXCEPT_HANDLER', 'RAISE') GROUP BY node)
    SELECT DISTINCT * FROM (SELECT node AS src, nxt AS dst, 'CFG_NEXT' AS type, NULL AS label FROM run WHERE nxt IS NOT NULL
    UNION ALL SELECT a, b_first, CASE type WHEN 'IF_STATEMENT' THEN 'CFG_BRANCH_TRUE' ELSE 'CFG_LOOP_ENTRY' END, CASE type WHEN 'IF_STATEMENT' THEN 'true' ELSE 'loop' END FROM body
    UNION ALL SELECT b_last, a, 'CFG_NEXT', NULL FROM body WHERE type <> 'IF_STATEMENT'
    UNION ALL SELECT node, end_node, CASE type WHEN 'IF_STATEMENT' THEN 'CFG_BRANCH_FALSE' ELSE 'CFG_LOOP_EXIT' END, CASE type WHEN 'IF_STATEMENT' THEN 'false' ELSE 'exit' END
        FROM run WHERE end_line > line AND type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT')
    UNION ALL SELECT a, node, 'CFG_EXCEPTION', 'exception' FROM below WHERE a_type IN ('TRY_STATEMENT', 'RAISE', 'EXCEPT_HANDLER') AND type = 'EXCEPT_HANDLER' AND parent IS NOT NULL
    UNION ALL SELECT f, node, 'CONTROL_FLOW', NULL FROM near)""",
)
def control_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.control_flow(tree(spark, sf_dir))


@query(
    "function_flow_edges",
    f"""WITH RECURSIVE {TREE_SQL},
    near AS (SELECT node, arg_max(a, len(a)) AS f FROM below WHERE a_type IN ('FUNCTION', 'ASYNC_FUNCTION') GROUP BY node),
    b AS (SELECT t.*, f, lead(t.node) OVER (PARTITION BY f ORDER BY line, col) AS nxt FROM t JOIN near ON t.node = near.node),
    k AS (SELECT node, parent, row_number() OVER w AS k, count(*) OVER (PARTITION BY parent) AS n FROM t WHERE parent IS NOT NULL WINDOW w AS (PARTITION BY parent ORDER BY line, col))
    SELECT node AS src, nxt AS dst, 'CONTROL_FLOW' AS type, 'next' AS label FROM b WHERE nxt IS NOT NULL
    UNION ALL SELECT b.node, k.node, 'CONTROL_FLOW', CASE k.k WHEN 1 THEN 'true' ELSE 'false' END FROM b JOIN k ON k.parent = b.node WHERE b.type = 'IF_STATEMENT' AND k.k <= 2
    UNION ALL SELECT b.node, k.node, 'CONTROL_FLOW', 'loop_enter' FROM b JOIN k ON k.parent = b.node WHERE b.type IN ('FOR_STATEMENT', 'WHILE_STATEMENT') AND k.k = 1
    UNION ALL SELECT k.node, b.node, 'CONTROL_FLOW', 'loop_back' FROM b JOIN k ON k.parent = b.node WHERE b.type IN ('FOR_STATEMENT', 'WHILE_STATEMENT') AND k.k = k.n
    UNION ALL SELECT f, node, 'EXIT', NULL FROM b WHERE type = 'RETURN'""",
)
def function_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.function_flow(tree(spark, sf_dir))


@query(
    "tree_text_flows",
    f"""WITH RECURSIVE {TREE_SQL},
    leaf AS (SELECT * FROM below WHERE type IN ('IDENTIFIER', 'PARAMETER', 'LITERAL', 'MEMBER_ACCESS')),
    prop AS (SELECT a, arg_max(node, (line, col)) AS node FROM leaf WHERE a_type = 'MEMBER_ACCESS' GROUP BY a),
    called AS (SELECT node FROM t WHERE type IN ('FUNCTION', 'ASYNC_FUNCTION', 'METHOD') AND file % 3 <> 0)
    SELECT node AS src, a AS dst, CASE a_type WHEN 'FSTRING' THEN 'DFG_INTERP' ELSE 'DFG_TEMPLATE' END AS type FROM leaf WHERE a_type IN ('FSTRING', 'TEMPLATE_LITERAL') AND type <> 'LITERAL'
    UNION ALL SELECT node, a, 'DFG_PROPERTY' FROM prop UNION ALL SELECT node, a, 'DFG_ATTR' FROM prop
    UNION ALL SELECT a, node, 'CALL_RETURN' FROM below WHERE type = 'RETURN' AND a IN (SELECT node FROM called)
    UNION ALL SELECT parent, node, 'DEFINES' FROM t WHERE type IN ('FUNCTION', 'ASYNC_FUNCTION') AND parent = 'c' || file""",
)
def tree_text_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    calls = t.where(F.col("type").isin(trees.CALLABLE) & (F.col("file") % 3 != 0)).select(F.lit("call").alias("call"), F.col("node").alias("function"))
    return trees.text_flow(t).unionByName(trees.call_returns(t, calls)).unionByName(trees.file_definitions(t)).drop("label")
