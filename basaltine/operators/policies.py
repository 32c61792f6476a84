"""Verdicts on JSON documents: access policies and stored secrets, read as VARIANT.

A document is parsed once and its parts are taken by their names, so the order of keys, white space and single values in
place of lists make no difference. Texts that are no JSON, or not of the shape, say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.session import written

#: Words that tell what a statement is about, in this order, and the control of each; without them it is general.
ABOUT = {
    "V13.3.2": ["secretsmanager", "kms:", "kms.amazonaws", "vault", "ssm:", "parameter-store"],
    "V16.4.2": ["logs:", "log-group", "cloudwatch", "arn:aws:logs"],
}
GENERAL = "V13.2.2"
ROTATION = "V13.3.4"


def _listed(part: Column, name: str) -> Column:
    """A list of strings at a name: the list, or the one value that stands there; empty if nothing does."""
    path = f"$.{name}"
    many, one = F.try_variant_get(part, path, "array<variant>"), F.try_variant_get(part, path, "string")
    alone = F.when(F.coalesce(one, F.lit("")) != "", F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.when(many.isNotNull(), F.transform(many, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))).otherwise(alone)


def allowed_statements(content: Column) -> Column:
    """(control, open) of each statement that allows something: what it is about, and whether it allows anything at all. Null without a list of statements."""
    statements = F.try_variant_get(F.try_parse_json(content), "$.Statement", "array<variant>")
    allowing = F.filter(statements, lambda s: F.coalesce(F.try_variant_get(s, "$.Effect", "string") == "Allow", F.lit(False)))

    def read(s: Column) -> Column:
        actions, resources = _listed(s, "Action"), _listed(s, "Resource")
        text = F.lower(F.array_join(F.concat(resources, actions), " "))
        control = F.lit(GENERAL)
        for name, words in reversed(ABOUT.items()):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(text, F.lit(w))
            control = F.when(hit, name).otherwise(control)
        return F.struct(control.alias("control"), (F.array_contains(actions, "*") | F.array_contains(resources, "*")).alias("open"))

    return F.transform(allowing, read)


def policy_verdict(statements: Column, control: str) -> Column:
    """Of all statements on a control: one that allows anything fails it, others pass it; null if there are none."""
    ours = F.filter(statements, lambda s: s["control"] == control)
    return F.when(F.exists(ours, lambda s: s["open"]), "fail").when(F.size(ours) > 0, "pass")


def rotation_verdict(content: Column) -> Column:
    """Whether a secret is rotated, if the document says so."""
    on = F.try_variant_get(F.try_parse_json(content), "$.RotationEnabled", "boolean")
    said = F.schema_of_variant(F.try_variant_get(F.try_parse_json(content), "$.RotationEnabled", "variant")) == "BOOLEAN"
    return F.when(said & on, "pass").when(said & ~on, "fail")


def find_first(rows: DataFrame, content: str, key: str, names: list[str]) -> DataFrame:
    """(key, found): the first value, depth first, under one of the names in any case, of each row's JSON in the column content.

    A value stands before those inside it; names of an object come in the order of the alphabet, which is how a VARIANT keeps
    them. The walk takes a level of all documents at a time; below a value that was found it does not go on.
    """
    wanted = [n.lower() for n in names]
    at = rows.select(F.col(key), F.try_parse_json(content).alias("part"), F.array().cast("array<int>").alias("way")).where("part is not null")
    at = written(at, "json-level")
    found = []
    while True:
        parts = rows.sparkSession.tvf.variant_explode(F.col("part").outer()).toDF("pos", "name", "inside")
        hit = F.coalesce(F.lower("name").isin(wanted), F.lit(False))
        inner = at.lateralJoin(parts).select(key, F.concat("way", F.array("pos")).alias("way"), hit.alias("hit"), F.col("inside").alias("part"))
        inner = written(inner, "json-level")
        if inner.isEmpty():
            break
        found.append(inner.where("hit").select(key, "way", F.coalesce(F.try_variant_get("part", "$", "string"), F.to_json("part")).alias("found")))
        at = inner.where("not hit").drop("hit")
    if not found:
        return rows.select(key, F.lit(None).cast("string").alias("found")).where("false")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy(key).agg(F.min_by("found", "way").alias("found"))
