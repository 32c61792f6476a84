"""What is shown of a graph and of results: views by kind and by file, figures of a repository, registers with their evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltine.operators.linking import tails

#: Kinds of edges of a view, and kinds of nodes where they matter; None stands for no kind at all.
VIEWS = {
    "AST": (["AST", None], ["AST", "CHILD", None]),
    "CFG": (None, ["CFG", "CONTROL_FLOW"]),
    "DFG": (None, ["DFG", "DATA_FLOW", "DFG_INTERP", "DFG_TEMPLATE"]),
    "CPG": (None, None),
}
#: Languages that count as one in the figures of a repository; lines of evidence shown of a failing control.
SCRIPTS = ["javascript", "typescript"]
SHOWN = 4


def _of(column: str, kinds: list[str | None]):
    named = F.col(column).isin([k for k in kinds if k is not None])
    return named | F.col(column).isNull() if None in kinds else named


def view(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, node_type) and edges (src, dst, edge_type) of a view; edges lie between nodes of the view, but for the whole graph."""
    wanted, shown = VIEWS[kind.upper()]
    n = nodes if wanted is None else nodes.where(_of("node_type", wanted))
    if shown is None:
        return n, edges
    ids = n.select("node").distinct()
    e = edges.where(_of("edge_type", shown))
    return n, e.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def file_views(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, node) and (path, src, dst): the part of the graph of each file (path), by nodes (node, file) and edges (src, dst).

    Paths are the same if one ends with the other at the border of a part, whatever their case and slashes. Each side is
    expanded to its tails, so this is equality too.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^[./]+", ""))
    named = nodes.select("file").where("file is not null").distinct().withColumn("key", plain(F.col("file")))
    asked = files.select("path").distinct().withColumn("key", plain(F.col("path")))
    longer = named.withColumn("key", F.explode(tails(F.col("key")))).join(asked, "key").select("file", "path")
    shorter = asked.withColumn("key", F.explode(tails(F.col("key")))).join(named, "key").select("file", "path")
    same = longer.unionByName(shorter).distinct()
    inside = nodes.join(same, "file").select("path", "node").distinct()
    ends = inside.select("path", F.col("node").alias("src"))
    e = edges.select("src", "dst").join(ends, "src").join(inside.select("path", F.col("node").alias("dst")), ["path", "dst"])
    return inside, e.select("path", "src", "dst")


def shown_file(available: DataFrame, wanted: str | None) -> DataFrame:
    """The row of available (file_id, ord, has_graph) that is shown: the wanted one, else the first with a graph."""
    order = F.struct(F.when(F.col("file_id") == F.lit(wanted), 0).otherwise(1), F.when(F.col("has_graph"), 0).otherwise(1), F.col("ord"))
    return available.agg(F.min_by(F.struct("file_id", "has_graph"), order).alias("one")).where("one is not null").select("one.*")


def statistics(modules: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of figures: modules (language, exports, imports), nodes, edges (cross_file)."""
    m = modules.agg(
        F.count("*").alias("total_modules"),
        F.coalesce(F.sum("exports"), F.lit(0)).alias("total_exports"),
        F.coalesce(F.sum("imports"), F.lit(0)).alias("total_imports"),
        F.count_if(F.col("language") == "python").alias("python_modules"),
        F.count_if(F.col("language").isin(SCRIPTS)).alias("javascript_modules"),
    )
    e = edges.agg(F.count("*").alias("total_edges"), F.count_if(F.coalesce("cross_file", F.lit(False))).alias("cross_file_edges"))
    return m.withColumns({"total_nodes": nodes.agg(F.count("*")).scalar(), "total_edges": e.select("total_edges").scalar(), "cross_file_edges": e.select("cross_file_edges").scalar()})


def failing_register(results: DataFrame, evidence: DataFrame, most: int = SHOWN) -> DataFrame:
    """(control_id, n, evidence): the failing controls in the order of their ids' letters, with how much evidence there is and its first lines.

    results: (control_id, verdict); evidence: (control_id, ord, file, line, note). A line is file:line, a dash and the note, without those at its ends that lead to nothing.
    """
    failing = results.where("verdict = 'fail'").select("control_id").distinct()
    text = F.concat(F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit(" — "), F.coalesce("note", F.lit("")))
    e = evidence.join(failing, "control_id", "left_semi").select("control_id", "ord", F.btrim(text, F.lit(" —")).alias("text"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("control_id").orderBy("ord"))).where(F.col("k") <= most)
    shown = e.groupBy("control_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    n = evidence.groupBy("control_id").agg(F.count("*").alias("n"))
    out = failing.join(shown, "control_id", "left").join(n, "control_id", "left")
    return out.select("control_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("evidence", F.lit("No inline evidence recorded.")).alias("evidence")).orderBy("control_id")


def dispatch(controls: DataFrame, by_strategy: dict[str, Callable[[DataFrame], DataFrame]], special: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(control_id, verdict, confidence): each control (control_id, strategy) judged by its strategy, or by the one that special has for strategy and control.

    by_strategy: from the controls of a strategy to their rows; a control that none of them answers is not tested.
    """
    chosen = F.col("strategy")
    for (strategy, control), other in (special or {}).items():
        chosen = F.when((F.col("strategy") == strategy) & (F.col("control_id") == control), other).otherwise(chosen)
    marked = controls.select("control_id", chosen.alias("strategy"))
    parts = [judge(marked.where(F.col("strategy") == name).select("control_id")).select("control_id", "verdict", F.col("confidence").cast("double")) for name, judge in by_strategy.items()]
    said = parts[0]
    for p in parts[1:]:
        said = said.unionByName(p)
    out = marked.select("control_id").join(said, "control_id", "left")
    return out.select("control_id", F.coalesce("verdict", F.lit("not_tested")).alias("verdict"), "confidence")


def unpacked(assignments: DataFrame, returned: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, pos): what a function returns in parts, to the names that take it apart, place by place.

    assignments: (assignment, callee); returned: (function, ret, pos, element), of several returns the first counts; targets: (assignment, pos, target).
    """
    first = returned.groupBy("function").agg(F.min("ret").alias("ret"))
    parts = returned.join(first, ["function", "ret"]).select(F.col("function").alias("callee"), "pos", F.col("element").alias("src"))
    return assignments.join(parts, "callee").join(targets.withColumnRenamed("target", "dst"), ["assignment", "pos"]).select("src", "dst", "pos").distinct()
