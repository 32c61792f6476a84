"""Syntax trees as nested sets, and the edges that follow from their shape.

A node is numbered in the order of the text; `first` is its own number and `last` the largest number below it. So its
descendants are the numbers from first + 1 to last, its ancestors the ranges that hold its number, the end of its body is
the node numbered last, and the first statement behind its line is that of the next line with nodes. Numbers come from one
sweep over where nodes open and close; nothing is searched level by level and no closure is stored.

Which points lie in which ranges is an equality join (`within`): a range is cut into at most two blocks of each power of
two, a point lies in one block of each, and they meet in exactly one block. No pair is made that doesn't count.

Nodes are (file, node, parent, type, line, col, open, close, depth): open and close are places in the file, close is the
last place inside; children lie inside their parents and siblings apart; depth tells apart a parent and a child that open
and close alike. Document order is that of (line, col).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a file that are numbered in one sort; larger files are cut and numbered piece by piece.
WIDTH = 1 << 20

#: Kinds of nodes and what they mean for the flow of control.
NOT_EXECUTED = ["IDENTIFIER", "LITERAL", "PARAMETER"]
LOOPS = ["FOR_STATEMENT", "WHILE_STATEMENT"]
TRIES = ["TRY_STATEMENT", "TRY", "RAISE", "EXCEPT_HANDLER", "EXCEPT"]
CATCHES = ["EXCEPT_HANDLER", "EXCEPT"]
CONTROL = ["IF_STATEMENT", *LOOPS, *TRIES]
CALLABLE = ["FUNCTION", "ASYNC_FUNCTION", "METHOD"]
DEFINED = ["FUNCTION", "ASYNC_FUNCTION", "CLASS", "ASSIGNMENT"]
LEAVES = ["IDENTIFIER", "PARAMETER", "LITERAL", "MEMBER_ACCESS"]
ACCESSES = ["MEMBER_ACCESS", "ATTRIBUTE_ACCESS", "ATTRIBUTE"]
TEMPLATES = {"FSTRING": "DFG_INTERP", "TEMPLATE_LITERAL": "DFG_TEMPLATE"}


def nested_sets(nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """nodes with first and last, counted from 1 in each file.

    A file is cut into pieces of so many places. Each piece is counted on its own and what the pieces before it hold is
    added, so a long file is not one task.
    """
    names = nodes.columns
    row = F.struct(*names).alias("row")
    opens = nodes.select("file", "node", F.col("open").alias("at"), F.lit(0).alias("kind"), (-F.col("close")).alias("outer"), "depth", row)
    closes = nodes.select("file", "node", F.col("close").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("outer"), "depth", F.lit(None).alias("row"))
    events = opens.unionByName(closes).withColumn("piece", F.floor(F.col("at") / F.lit(width)))
    sweep = Window.partitionBy("file", "piece").orderBy("at", "kind", "outer", "depth", "node").rowsBetween(Window.unboundedPreceding, 0)
    local = events.withColumn("n", F.count_if(F.col("kind") == 0).over(sweep))
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = events.groupBy("file", "piece").agg(F.count_if(F.col("kind") == 0).alias("own"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    n = F.col("n") + F.col("offset")
    both = local.join(offsets, ["file", "piece"]).groupBy("file", "node").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max(F.when(F.col("kind") == 0, n)).alias("first"), F.max(F.when(F.col("kind") == 1, n)).alias("last")
    )
    return both.select("row.*", "first", "last")


def _blocks(first: Column, end: Column, level: Column) -> Column:
    """The blocks of 2^level numbers that belong to the range first to end - 1: none, one at either side, or both."""
    size = F.lit(1).cast("long")
    size = F.call_function("shiftleft", size, level)
    a, b = F.floor((first + size - 1) / size), F.floor(end / size)
    some = a < b
    left, right = F.when(some & (a % 2 == 1), F.struct(level.alias("level"), a.alias("block"))), F.when(some & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("block")))
    return F.array_compact(F.array(left, right))


def within(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, last: str) -> DataFrame:
    """points with the ranges of equal keys that hold them: first <= at <= last. Numbers count from 0 or more."""
    ranges = ranges.where(F.col(first) <= F.col(last))
    longest = ranges.agg(F.max(F.col(last) - F.col(first) + 1)).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(longest).bit_length()))
    cut = F.explode(F.flatten(F.transform(levels, lambda k: _blocks(F.col(first), F.col(last) + 1, k)))).alias("__b")
    r = ranges.select("*", cut).select(*ranges.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    p = points.select("*", F.explode(levels).alias("__level"))
    p = p.withColumn("__block", F.floor(F.col(at) / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__level"))))
    return p.join(r, [*keys, "__level", "__block"]).drop("__level", "__block")


def _edges(df: DataFrame, src: str, dst: str, kind: str | Column, label: str | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("type"), F.lit(label).cast("string").alias("label")).where("src <> dst")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _below(t: DataFrame, kinds: list[str], names: dict[str, str]) -> DataFrame:
    """The ranges of the descendants of some kinds of nodes: (file, from, to) and the named columns."""
    return t.where(F.col("type").isin(kinds)).select("file", (F.col("first") + 1).alias("from"), F.col("last").alias("to"), *[F.col(c).alias(n) for c, n in names.items()])


def enclosing(t: DataFrame, kinds: list[str], of: DataFrame | None = None) -> DataFrame:
    """(file, node, around): the nearest ancestor of one of the kinds of each node (of `of`), if it has one."""
    points = (t if of is None else of).select("file", "node", "first")
    held = within(points, _below(t, kinds, {"node": "around", "first": "around_first"}), ["file"], "first", "from", "to")
    return held.groupBy("file", "node").agg(F.max_by("around", "around_first").alias("around"))


def control_flow(t: DataFrame) -> DataFrame:
    """(src, dst, type, label): the flow of control through numbered nodes, each edge once.

    Executed siblings follow each other; an `if` leads to the first node below it on a later line and, if that is on a later
    line, to its last sibling; a loop enters likewise, comes back from the last node of its body and leaves to its last
    sibling; tries, raises and handlers lead to the handlers below them; functions lead to the control statements for which
    they are the nearest function.
    """
    by_place = Window.partitionBy("file", "parent").orderBy("line", "col", "first")
    kids = t.where(F.col("parent").isNotNull())
    kids = kids.withColumn("end", F.last(F.struct("node", "line")).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    run = kids.where(~F.col("type").isin(NOT_EXECUTED)).withColumn("then", F.lead("node").over(by_place))

    # the first node of the next line with nodes, for every line of a file
    lines = t.groupBy("file", "line").agg(F.min_by(F.struct("first", "node"), "first").alias("head"))
    lines = lines.withColumn("next", F.lead("head").over(Window.partitionBy("file").orderBy("line"))).select("file", "line", "next")
    branching = run.where(F.col("type").isin("IF_STATEMENT", *LOOPS)).join(lines, ["file", "line"])
    ends = t.select("file", F.col("first").alias("last"), F.col("node").alias("body_end"), F.col("line").alias("end_line"))
    branching = branching.join(ends, ["file", "last"])
    body = branching.where(F.col("next.first") <= F.col("last")).withColumn("begin", F.col("next.node"))
    after = branching.where(F.col("end.line") > F.col("line")).withColumn("behind", F.col("end.node"))
    branch, loop = F.col("type") == "IF_STATEMENT", F.col("type").isin(LOOPS)

    catches = t.where(F.col("type").isin(CATCHES)).select("file", "first", F.col("node").alias("catch"))
    caught = within(catches, _below(kids, TRIES, {"node": "node"}), ["file"], "first", "from", "to")
    inside = enclosing(t, CALLABLE, t.where(F.col("type").isin(CONTROL)))
    return _union(
        [
            _edges(run, "node", "then", "CFG_NEXT"),
            _edges(body.where(branch), "node", "begin", "CFG_BRANCH_TRUE", "true"),
            _edges(after.where(branch), "node", "behind", "CFG_BRANCH_FALSE", "false"),
            _edges(body.where(loop), "node", "begin", "CFG_LOOP_ENTRY", "loop"),
            _edges(body.where(loop), "body_end", "node", "CFG_NEXT"),
            _edges(after.where(loop), "node", "behind", "CFG_LOOP_EXIT", "exit"),
            _edges(caught, "node", "catch", "CFG_EXCEPTION", "exception"),
            _edges(inside, "around", "node", "CONTROL_FLOW"),
        ]
    ).distinct()


def function_flow(t: DataFrame) -> DataFrame:
    """(src, dst, type, label): control flow function by function, over the nodes whose nearest function it is, in the order of their lines.

    Each node leads to the next; an `if` to its first and its second child, a loop to its first child and back from its
    last, a return is an exit.
    """
    kinds = ["FUNCTION", "ASYNC_FUNCTION", "ARROW_FUNCTION"]
    body = t.join(enclosing(t, kinds), ["file", "node"])
    body = body.withColumn("then", F.lead("node").over(Window.partitionBy("file", "around").orderBy("line", "col", "first")))
    by_place = Window.partitionBy("file", "parent").orderBy("line", "col", "first")
    kids = t.where(F.col("parent").isNotNull()).withColumn("k", F.row_number().over(by_place))
    sides = kids.groupBy("file", F.col("parent").alias("node")).agg(F.max(F.when(F.col("k") == 1, F.col("node"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("node"))).alias("two"), F.max_by("node", "k").alias("end"))
    met = body.join(sides, ["file", "node"])
    ifs, loops = met.where("type = 'IF_STATEMENT'"), met.where(F.col("type").isin(LOOPS))
    return _union(
        [
            _edges(body, "node", "then", "CONTROL_FLOW", "next"),
            _edges(ifs, "node", "one", "CONTROL_FLOW", "true"),
            _edges(ifs, "node", "two", "CONTROL_FLOW", "false"),
            _edges(loops, "node", "one", "CONTROL_FLOW", "loop_enter"),
            _edges(loops, "end", "node", "CONTROL_FLOW", "loop_back"),
            _edges(body.where("type = 'RETURN'"), "around", "node", "EXIT"),
        ]
    ).distinct()


def call_returns(t: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, type, label): from each function that calls (call, function) name to the returns below it, those of inner functions too."""
    called = t.join(calls.select(F.col("function").alias("node")).distinct(), "node", "left_semi")
    returns = t.where("type = 'RETURN'").select("file", "first", F.col("node").alias("return"))
    return _edges(within(returns, _below(called, [*CALLABLE, "ARROW_FUNCTION"], {"node": "node"}), ["file"], "first", "from", "to"), "node", "return", "CALL_RETURN")


def text_flow(t: DataFrame) -> DataFrame:
    """(src, dst, type, label): what is put into strings, and what properties are read from.

    All leaves below a string with fields, but for literals, flow into it. A property is read from the leaf below it that
    stands last; of leaves within each other that is the outermost.
    """
    leaves = t.where(F.col("type").isin(LEAVES)).select("file", F.col("node").alias("leaf"), F.col("type").alias("kind"), F.col("first").alias("leaf_first"), F.col("last").alias("leaf_last"))
    held = within(leaves, _below(t, [*TEMPLATES, *ACCESSES], {"node": "node", "type": "type"}), ["file"], "leaf_first", "from", "to")
    put = held.where(F.col("type").isin(list(TEMPLATES)) & (F.col("kind") != "LITERAL"))
    kind = F.when(F.col("type") == "FSTRING", TEMPLATES["FSTRING"]).otherwise(TEMPLATES["TEMPLATE_LITERAL"])
    read = held.where(F.col("type").isin(ACCESSES)).groupBy("node").agg(F.max_by("leaf", F.struct("leaf_last", -F.col("leaf_first"))).alias("leaf"))
    return _union([_edges(put, "leaf", "node", kind), _edges(read, "leaf", "node", "DFG_PROPERTY"), _edges(read, "leaf", "node", "DFG_ATTR")]).distinct()


def file_definitions(t: DataFrame) -> DataFrame:
    """(src, dst, type, label): what a file defines at its top."""
    files = t.where("type = 'FILE'").select("file", F.col("node").alias("parent"))
    return _edges(t.where(F.col("type").isin(DEFINED)).join(files, ["file", "parent"]), "parent", "node", "DEFINES")
