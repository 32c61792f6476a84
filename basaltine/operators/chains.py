"""Chains of pointers: scopes within scopes, names that are passed on from module to module.

Where each row points to one other, its end is found by pointer jumping: every round each pointer is replaced by that of
what it points to, so a chain of n links takes log2(n) joins. What still moves after as many rounds as the number of
links allows is on a cycle, or leads to one, and has no end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.operators.joins import asof_backward
from basaltine.session import written

#: Fixed value: the scope of names outside of all others.
GLOBAL = "global"


def final_targets(links: DataFrame) -> DataFrame:
    """(src, final, hops): where each chain of links (src, dst) ends. A source with several targets takes the smallest; cycles have no rows."""
    at = written(links.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst")).withColumn("hops", F.lit(1).cast("long")), "pointers")
    reach, n = 1, at.count()
    while True:
        onward = at.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("hops").alias("more"))
        met = at.join(onward, "dst", "left")
        if reach >= n or not met.where("next is not null").limit(1).count():
            return met.where("next is null").select("src", F.col("dst").alias("final"), "hops")
        at = written(met.select("src", F.coalesce("next", "dst").alias("dst"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "pointers")
        reach *= 2


def scope_chains(scopes: DataFrame) -> DataFrame:
    """(scope, chain): each scope (scope, parent) with itself and all around it, from the inside out. A parent without a row of its own ends the chain."""
    own = scopes.where("scope is not null").groupBy("scope").agg(F.min("parent").alias("up"))
    at = written(own.select("scope", F.array("scope").alias("chain"), "up"), "chains")
    reach, n = 1, at.count()
    while True:
        outer = at.select(F.col("scope").alias("up"), F.col("chain").alias("rest"), F.col("up").alias("far"), F.lit(True).alias("known"))
        met = at.join(outer, "up", "left")
        if reach > n or not met.where("known").limit(1).count():
            whole = F.when(F.col("up").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("up")))
            return met.select("scope", F.array_distinct(whole).alias("chain"))
        more = F.concat("chain", F.coalesce("rest", F.array().cast("array<string>")))
        at = written(met.select("scope", more.alias("chain"), F.when(F.col("known"), F.col("far")).otherwise(F.col("up")).alias("up")), "chains")
        reach *= 2


def _with_chain(uses: DataFrame, chains: DataFrame, scope: Column) -> DataFrame:
    """uses with (outer, depth), a row for each scope around them; a scope that isn't known stands for itself."""
    u = uses.withColumn("scope", scope).join(chains, "scope", "left")
    return u.select(*uses.columns, F.posexplode(F.coalesce("chain", F.array("scope"))).alias("depth", "outer"))


def reaching_definitions(uses: DataFrame, definitions: DataFrame, chains: DataFrame) -> DataFrame:
    """uses (use, name, scope, line) with def, the closest definition (def, name, scope, line) of the name on an earlier line that is visible.

    Visible is what stands in the use's scope or one around it; a use or a definition without scope sees, or is seen by,
    all of its name. Of definitions on one line the smallest counts. Null if there is none.
    """
    kind = lambda k: F.lit(k).alias("kind")
    none = F.lit("").alias("outer")
    own = ["use", "name", (F.col("line") - 1).alias("at")]
    scoped = uses.where("scope is not null")
    asks = _with_chain(scoped, chains, F.col("scope")).select(*own, kind("in"), "outer")
    asks = asks.unionByName(scoped.select(*own, kind("bare"), none)).unionByName(uses.where("scope is null").select(*own, kind("any"), none))
    said = ["name", "def", "line"]
    given = definitions.where("scope is not null").select(*said, kind("in"), F.col("scope").alias("outer"))
    given = given.unionByName(definitions.where("scope is null").select(*said, kind("bare"), none)).unionByName(definitions.select(*said, kind("any"), none))
    given = given.groupBy("name", "kind", "outer", "line").agg(F.min("def").alias("def"))
    met = asof_backward(asks, given.withColumn("d_line", F.col("line")), ["name", "kind", "outer"], "at", "line", ["def", "d_line"]).where("def is not null")
    best = met.groupBy("use").agg(F.min_by("def", F.struct(-F.col("d_line"), F.col("def"))).alias("def"))
    return uses.join(best, "use", "left")


def resolve_functions(uses: DataFrame, symbols: DataFrame, chains: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """uses (use, name, scope) with function: what the name means in the nearest scope around it that has it as a function.

    symbols: (scope, name, function), null for names that aren't functions, which are passed over. Uses without scope are
    looked up in the global one. What is not found takes the first function assigned to the name, (name, ord, function).
    """
    known = symbols.where("function is not null").groupBy(F.col("scope").alias("outer"), "name").agg(F.min("function").alias("function"))
    asks = _with_chain(uses, chains, F.coalesce("scope", F.lit(GLOBAL)))
    near = asks.join(known, ["outer", "name"]).groupBy("use").agg(F.min_by("function", "depth").alias("function"))
    found = uses.join(near, "use", "left")
    if assigned is None:
        return found
    first = assigned.where("function is not null").groupBy("name").agg(F.min_by("function", "ord").alias("assigned"))
    return found.join(first, "name", "left").select("use", "name", "scope", F.coalesce("function", "assigned").alias("function"))


def lift(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, confidence): the flows that edges (src, dst, confidence) mean once imported names (src, dst) stand for what they end at.

    Either end is rewritten; flows that are there already and flows to themselves are left out. Confidence is that of the edge, 0.8 if
    it has none; of several ways to a flow the best.
    """
    ends = final_targets(names).select("src", "final")
    sure = F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8))).alias("confidence")
    out = edges.join(ends, "src").select(F.col("final").alias("src"), "dst", sure)
    into = edges.join(ends.withColumnRenamed("src", "dst"), "dst").select("src", F.col("final").alias("dst"), sure)
    new = out.unionByName(into).where("src <> dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return new.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
