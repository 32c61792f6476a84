"""Python source as a code property graph, by the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.session import written

KINDS = {
    ast.Module: "MODULE",
    ast.FunctionDef: "FUNCTION",
    ast.AsyncFunctionDef: "FUNCTION",
    ast.ClassDef: "CLASS",
    ast.arg: "PARAMETER",
    ast.Call: "CALL",
    ast.Assign: "ASSIGNMENT",
    ast.AnnAssign: "ASSIGNMENT",
    ast.AugAssign: "ASSIGNMENT",
    ast.Return: "RETURN",
    ast.Name: "IDENTIFIER",
    ast.Attribute: "MEMBER",
    ast.Constant: "LITERAL",
    ast.JoinedStr: "TEMPLATE",
    ast.BinOp: "BINARY",
    ast.If: "BRANCH",
    ast.For: "LOOP",
    ast.While: "LOOP",
    ast.Try: "TRY",
    ast.ExceptHandler: "EXCEPT_HANDLER",
    ast.Raise: "RAISE",
    ast.Import: "IMPORT",
    ast.ImportFrom: "IMPORT",
    ast.Subscript: "SUBSCRIPT",
}
NODES = "file string, node long, parent long, pos int, type string, name string, value string, line int, end_line int, col int, scope long, last long"


def _name(n: ast.AST) -> str | None:
    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return n.name
    if isinstance(n, ast.Call):
        return ast.unparse(n.func)
    if isinstance(n, (ast.Name, ast.Attribute, ast.Subscript)):
        return ast.unparse(n)
    if isinstance(n, ast.arg):
        return n.arg
    if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
        return ast.unparse(n.targets[0] if isinstance(n, ast.Assign) else n.target)
    if isinstance(n, ast.Import):
        return ", ".join(a.name for a in n.names)
    if isinstance(n, ast.ImportFrom):
        return "." * n.level + (n.module or "")
    return None


def _place(n: ast.AST) -> tuple[int, int]:
    """Where a node begins: its own place, or that of the first part that has one."""
    return next(((m.lineno, m.col_offset) for m in ast.walk(n) if hasattr(m, "lineno")), (0, 0))


def parsed(file: str, source: str) -> list[tuple]:
    """Rows of NODES in the order of the text; none if it can't be parsed. last is the number of the last node below a node, or its own."""
    try:
        root = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []
    stack = [(root, -1, 0, 0)]
    while stack:
        n, parent, pos, scope = stack.pop()
        here = parent
        if type(n) in KINDS:
            here = len(rows)
            value = repr(n.value) if isinstance(n, ast.Constant) else None
            line, end, col = getattr(n, "lineno", 1), getattr(n, "end_lineno", None), getattr(n, "col_offset", 0)
            rows.append((file, here, parent, pos, KINDS[type(n)], _name(n), value, line, end or line, col, scope))
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                scope = here
        inside = sorted(enumerate(ast.iter_child_nodes(n)), key=lambda x: _place(x[1]))
        stack += [(c, here, k, scope) for k, c in reversed(inside)]
    last = list(range(len(rows)))
    for k in range(len(rows) - 1, 0, -1):  # parents come before what is in them
        if (parent := rows[k][2]) >= 0:
            last[parent] = max(last[parent], last[k])
    return [(*r, e) for r, e in zip(rows, last)]


def nodes(files: DataFrame, path: str = "rel_path", content: str = "content") -> DataFrame:
    """The graph's nodes of Python files; parent gives the syntax edges. A file without an id clash is its own name space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODES.split(", ")]
        for b in batches:
            for p, text in zip(b[path], b[content]):
                yield pd.DataFrame(parsed(p, text or ""), columns=columns)

    return files.select(path, content).mapInPandas(run, NODES)


def _ref(file: str, node: str):
    """An id that is unique across files."""
    return F.concat(F.substring(F.sha1(F.col(file)), 1, 8), F.lit("_"), F.col(node).cast("string"))


def syntax_edges(n: DataFrame) -> DataFrame:
    return n.where("parent >= 0").select(_ref("file", "parent").alias("src"), _ref("file", "node").alias("dst"), F.lit("AST").alias("type"), F.col("node").alias("place"))


def definition_edges(n: DataFrame) -> DataFrame:
    """From the last definition of a name in a scope to its uses there: an as-of join on the place in the text."""
    from basaltine.operators.joins import asof_backward

    defs = n.where(F.col("type").isin("ASSIGNMENT", "PARAMETER")).select("file", "scope", "name", F.col("node").alias("d"))
    defs = defs.withColumn("def_node", F.col("d"))
    uses = n.where("type = 'IDENTIFIER'").select("file", "scope", "name", "node", (F.col("node") - 2).alias("before"))
    met = asof_backward(uses, defs, ["file", "scope", "name"], "before", "d", ["def_node"]).where("def_node is not null")
    return met.select(_ref("file", "def_node").alias("src"), _ref("file", "node").alias("dst"), F.lit("DFG_FLOW").alias("type"), F.col("node").alias("place"))


def call_edges(n: DataFrame) -> DataFrame:
    """From calls to the functions that have the last part of the callee's name, in any file."""
    calls = n.where("type = 'CALL'").select("file", "node", F.element_at(F.split("name", r"\."), -1).alias("callee"))
    functions = n.where("type = 'FUNCTION'").select(F.col("file").alias("f_file"), F.col("node").alias("f_node"), F.col("name").alias("callee"))
    met = calls.join(functions, "callee").dropDuplicates(["file", "node", "f_file", "f_node"])
    return met.select(_ref("file", "node").alias("src"), _ref("f_file", "f_node").alias("dst"), F.lit("CALL_GRAPH").alias("type"), F.col("f_node").alias("place"))


def argument_edges(n: DataFrame) -> DataFrame:
    """From the k-th argument of a call to the k-th parameter of the function it names."""
    from pyspark.sql import Window

    args = n.alias("a").join(n.where("type = 'CALL'").alias("c"), F.expr("a.file = c.file AND a.parent = c.node AND a.pos > 0"))
    args = args.select("a.file", F.col("c.node").alias("call"), F.col("a.node").alias("arg"), (F.col("a.pos") - 1).alias("k"), F.element_at(F.split("c.name", r"\."), -1).alias("callee"))
    w = Window.partitionBy("p.file", "f.node").orderBy("p.node")
    params = n.alias("p").join(n.where("type = 'FUNCTION'").alias("f"), F.expr("p.file = f.file AND p.parent = f.node AND p.type = 'PARAMETER'"))
    params = params.select(F.col("p.file").alias("p_file"), F.col("p.node").alias("param"), F.col("f.name").alias("callee"), (F.row_number().over(w) - 1).alias("k"))
    met = args.join(params, ["callee", "k"])
    return met.select(_ref("file", "arg").alias("src"), _ref("p_file", "param").alias("dst"), F.lit("DFG_PARAM_PASS").alias("type"), F.col("param").alias("place"))


def sibling_edges(n: DataFrame) -> DataFrame:
    """Control flow from each statement to the next one under the same parent."""
    from pyspark.sql import Window

    statements = n.where(F.col("type").isin("ASSIGNMENT", "RETURN", "BRANCH", "LOOP", "TRY", "CALL"))
    nxt = F.lead("node").over(Window.partitionBy("file", "parent").orderBy("node"))
    return statements.withColumn("nxt", nxt).where("nxt is not null").select(
        _ref("file", "node").alias("src"), _ref("file", "nxt").alias("dst"), F.lit("CFG_NEXT").alias("type"), F.col("nxt").alias("place")
    )


#: Kinds of nodes as the flow of control names them.
TREE_KINDS = {"MODULE": "FILE", "BRANCH": "IF_STATEMENT", "LOOP": "WHILE_STATEMENT", "TRY": "TRY_STATEMENT", "CALL": "CALL_EXPRESSION", "MEMBER": "MEMBER_ACCESS", "TEMPLATE": "FSTRING"}


def tree(n: DataFrame) -> DataFrame:
    """The nodes as numbered trees, for basaltine.operators.trees; parsing has numbered them."""
    kind = F.col("type")
    for ours, theirs in TREE_KINDS.items():
        kind = F.when(F.col("type") == ours, theirs).otherwise(kind)
    up = F.when(F.col("parent") >= 0, _ref("file", "parent"))
    return n.select("file", _ref("file", "node").alias("node"), up.alias("parent"), kind.alias("type"), "name", "line", "col", F.col("node").alias("first"), "last")


def flow_edges(n: DataFrame) -> DataFrame:
    """Control flow of branches, loops and exceptions, what goes into strings and properties, and the returns of functions that are called."""
    from basaltine.operators import trees

    t = written(tree(n), "python-tree")
    calls = call_edges(n).select(F.col("src").alias("call"), F.col("dst").alias("function"))
    every = trees.control_flow(t).unionByName(trees.text_flow(t)).unionByName(trees.call_returns(t, calls)).unionByName(trees.file_definitions(t))
    return every.join(t.select(F.col("node").alias("dst"), F.col("first").alias("place")), "dst").select("src", "dst", "type", "place")


#: More than a file has nodes: what parts the families in the order of edges.
FAMILY = 1_000_000_000_000


def _in_order(families: list[DataFrame]) -> DataFrame:
    """Each edge once, with ord: families one after the other, in a family by the place in the text. Searches take a node's edges in this order."""
    parts = [f.select("src", "dst", "type", (F.lit(k * FAMILY) + F.col("place")).alias("ord")) for k, f in enumerate(families)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst", "type").agg(F.min("ord").alias("ord"))


def edges(n: DataFrame) -> DataFrame:
    """All edge families, each edge once, in order."""
    return _in_order([syntax_edges(n), definition_edges(n), call_edges(n), argument_edges(n), sibling_edges(n), flow_edges(n)])


def execution_nodes(n: DataFrame) -> DataFrame:
    """The nodes as rules are executed on them."""
    none = F.lit(None).cast("string")
    return n.select(
        _ref("file", "node").alias("node"), F.col("node").alias("ord"), "type", "name", "value", none.alias("role"), none.alias("metadata"),
        "file", "line", none.alias("source_code"), F.lit("python").alias("language"),
    )


def execution_edges(n: DataFrame) -> DataFrame:
    """The edges as rules are executed on them; flows also go from a call's arguments to the call and from values to what they are assigned to."""
    inward = n.alias("c").join(n.where("type in ('CALL', 'ASSIGNMENT', 'RETURN', 'BINARY', 'TEMPLATE', 'MEMBER', 'SUBSCRIPT')").alias("p"), F.expr("c.file = p.file AND c.parent = p.node"))
    inward = inward.where("c.pos > 0 OR p.type not in ('CALL', 'ASSIGNMENT')")
    flow = inward.select(_ref("c.file", "c.node").alias("src"), _ref("p.file", "p.node").alias("dst"), F.lit("DFG_FLOW").alias("type"), F.col("p.node").alias("place"))
    return _in_order([syntax_edges(n), definition_edges(n), call_edges(n), argument_edges(n), sibling_edges(n), flow_edges(n), flow])
