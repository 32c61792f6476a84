"""Linking modules: which file an import means, which exports it takes, where they are used; flows between functions.

All links are equi-joins. Import paths are expanded to the files they can mean and to their tails, so a join on
equality finds them; tails are cut at the borders of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is added to a relative import to find its file, in the order of trying.
SUFFIXES = [".py", ".js", ".ts", ".tsx", ".jsx", "/index.js", "/index.ts", "/index.py", "/__init__.py", ""]


def module_path(path: Column) -> Column:
    """A file's name as a module: forward slashes, no extension, a package by its folder."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.\w+$", "")
    return F.regexp_replace(plain, r"/(index|__init__)$", "")


def tails(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def relative_target(file: Column, module: Column) -> Column:
    """The path, without extension, that a relative import means; the number of levels up is that of the dots."""
    script = F.contains(module, F.lit("/"))
    ups = F.when(script, F.size(F.regexp_extract_all(module, F.lit(r"(\.\./)"), F.lit(1)))).otherwise(F.length(F.regexp_extract(module, r"^(\.+)", 1)) - 1)
    rest = F.when(script, F.regexp_replace(module, r"^(\.{1,2}/)+", "")).otherwise(F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/")))
    folder = F.split(F.regexp_replace(file, r"\\", "/"), "/")
    depth = F.greatest(F.size(folder) - 1 - ups, F.lit(0))
    return F.array_join(F.filter(F.concat(F.slice(folder, F.lit(1), depth), F.array(rest)), lambda x: x != ""), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, module, ...) with target, the file that is meant: relative imports by suffix in their order, others
    by the whole module path first, then by a tail of either side; of several the first by ord. Null if there is none.
    """
    wanted = imports.select("file", "module").distinct()
    known = files.select(F.col("file").alias("target"), F.col("ord").alias("f_ord"))
    near = wanted.where(F.startswith("module", F.lit("."))).select("file", "module", F.posexplode(F.array(*[F.concat(relative_target(F.col("file"), F.col("module")), F.lit(s)) for s in SUFFIXES])).alias("rank", "path"))
    near = near.join(known.withColumn("path", F.regexp_replace("target", r"\\", "/")), "path").select("file", "module", "rank", "f_ord", "target")
    path = F.when(F.contains("module", F.lit("/")), F.regexp_replace("module", r"\.\w+$", "")).otherwise(F.replace("module", F.lit("."), F.lit("/")))
    far = wanted.where(~F.startswith("module", F.lit(".")) & (F.col("module") != "")).withColumn("path", path)
    named = known.withColumn("path", module_path(F.col("target")))
    exact = far.join(named, "path").withColumn("rank", F.lit(0))
    ours = far.withColumn("whole", F.col("path")).withColumn("path", F.explode(tails(F.col("path")))).join(named, "path").withColumn("rank", F.lit(1))
    theirs = far.join(named.withColumn("path", F.explode(tails(F.col("path")))), "path").withColumn("rank", F.lit(1))
    every = near
    for part in (exact, ours, theirs):
        every = every.unionByName(part.select("file", "module", "rank", "f_ord", "target"))
    best = every.groupBy("file", "module").agg(F.min_by("target", F.struct("rank", "f_ord", "target")).alias("target"))
    return imports.join(best, ["file", "module"], "left")


def link_exports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, local, target, name, export): resolved imports with the exports they take; a whole module takes all of them."""
    keys = F.array_compact(F.array(F.lit("*"), F.col("name"), F.when(F.col("is_default") & (F.col("name") != "default"), F.lit("default"))))
    given = exports.select(F.col("file").alias("target"), F.col("name").alias("export"), F.explode(F.array_distinct(keys)).alias("name"))
    return imports.select("file", "local", "target", "name").join(given, ["target", "name"]).select("file", "local", "target", "name", "export").distinct()


def export_uses(links: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(target, export, file, node): where importing files use what they import, under its local name; not the import itself.

    identifiers: (file, name, node, in_import)."""
    uses = identifiers.where(~F.coalesce("in_import", F.lit(False))).select("file", F.col("name").alias("local"), "node")
    return links.join(uses, ["file", "local"]).select("target", "export", "file", "node").distinct()


def use_calls(uses: DataFrame, syntax: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, target, export): a use whose parent is a call makes the call an edge to the export."""
    calls = nodes.where(F.col("type").isin("CALL", "CALL_EXPRESSION")).select(F.col("node").alias("src"))
    parents = syntax.select("src", F.col("dst").alias("node"))
    return uses.join(parents, "node").join(calls, "src", "left_semi").select("src", "target", "export").distinct()


def module_references(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, module, dst): resolved imports with the module node of the file they mean."""
    modules = nodes.where("type = 'MODULE'").select(F.col("file").alias("target"), F.col("node").alias("dst"))
    return imports.where("target is not null").select("file", "module", "target").distinct().join(modules, "target").select("file", "module", "dst")


def return_flows(calls: DataFrame, returns: DataFrame) -> DataFrame:
    """(src, dst): each value (function, value) that a function returns flows to each of its calls (callee, call)."""
    given = returns.where("value is not null").select(F.col("function").alias("callee"), F.col("value").alias("src"))
    return calls.select("callee", F.col("call").alias("dst")).join(given, "callee").select("src", "dst").distinct()


def closure_flows(functions: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(function, name, src, dst): names that a function uses without defining them, from their definitions in the parent scope.

    functions: (function, parent_scope); definitions: (scope, name, node), parameters among them; uses: (function, name, node).
    """
    own = definitions.select(F.col("scope").alias("function"), "name")
    captured = uses.select("function", "name", F.col("node").alias("dst")).join(own, ["function", "name"], "left_anti")
    outer = definitions.select(F.col("scope").alias("parent_scope"), "name", F.col("node").alias("src"))
    return captured.join(functions, "function").join(outer, ["parent_scope", "name"]).select("function", "name", "src", "dst").distinct()


def callback_flows(passed: DataFrame, parameters: DataFrame, invocations: DataFrame) -> DataFrame:
    """(src, dst, confidence): what a function hands to the parameter that it calls goes to the callback's own parameters.

    passed: (callee, pos, callback), a function given as an argument; parameters: (function, pos, name, node);
    invocations: (function, name, pos, arg), arguments of calls to a name inside a function.
    """
    taken = parameters.select(F.col("function").alias("callee"), "pos", "name")
    inside = invocations.select(F.col("function").alias("callee"), "name", F.col("pos").alias("k"), F.col("arg").alias("src"))
    own = parameters.select(F.col("function").alias("callback"), F.col("pos").alias("k"), F.col("node").alias("dst"))
    met = passed.join(taken, ["callee", "pos"]).join(inside, ["callee", "name"]).join(own, ["callback", "k"])
    return met.select("src", "dst", F.lit(0.8).alias("confidence")).distinct()
