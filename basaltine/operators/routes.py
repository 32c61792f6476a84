"""Routes of a backend, and the forms, handlers and templates of pages that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.functions.web import route_regex

#: How frameworks declare a route, in the order of trying: a decorator, a method of an application, a path of a URL table.
DECLARED = [r"@\w+\.(?:route|get|post|put|delete|patch|options|head)\(\s*['\"]([^'\"]+)['\"]", r"\b(?:app|router)\.(?:get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", r"\bpath\(\s*['\"]([^'\"]+)['\"]"]
RENDERED = r"(?:render_template|render|TemplateResponse)\(\s*(?:request\s*,\s*)?['\"]([^'\"]+)['\"]"


def route_table(nodes: DataFrame) -> DataFrame:
    """(route, handler): of the declarations (node, ord, source_code) of a route the last one counts."""
    found = [F.nullif(F.regexp_extract("source_code", p, 1), F.lit("")) for p in DECLARED]
    routes = nodes.select("node", "ord", F.coalesce(*found).alias("route")).where("route is not null")
    return routes.groupBy("route").agg(F.max_by("node", "ord").alias("handler"))


def template_table(nodes: DataFrame) -> DataFrame:
    """(template, file): the files that render a template."""
    return nodes.select(F.nullif(F.regexp_extract("source_code", RENDERED, 1), F.lit("")).alias("template"), "file").where("template is not null").distinct()


def resolve_actions(actions: DataFrame, routes: DataFrame) -> DataFrame:
    """actions (action, ...) with handler: of the same route, else but for slashes at the ends, else of a route with parameters.

    Routes with parameters are patterns, which no equality finds; they are matched for what is left, among routes with as
    many parts as the action.
    """
    bare = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    wanted = actions.select("action").distinct()
    exact = wanted.join(routes.select(F.col("route").alias("action"), F.col("handler").alias("h1")), "action", "left")
    loose = routes.groupBy(bare("route").alias("bare")).agg(F.min_by("handler", "route").alias("h2"))
    exact = exact.withColumn("bare", bare("action")).join(loose, "bare", "left")
    left = exact.where("h1 is null and h2 is null").select("action", F.size(F.split("action", "/")).alias("parts"))
    pattern = routes.where(F.contains("route", F.lit("<"))).select("route", F.col("handler").alias("h"), route_regex(F.col("route")).alias("regex"), F.size(F.split("route", "/")).alias("parts"))
    third = left.join(pattern, "parts").where(F.regexp_like("action", F.col("regex"))).groupBy("action").agg(F.min_by("h", "route").alias("h3"))
    out = exact.join(third, "action", "left").select("action", F.coalesce("h1", "h2", "h3").alias("handler"))
    return actions.join(out, "action", "left")


def handler_routes(handlers: DataFrame, routes: DataFrame) -> DataFrame:
    """(node, action, handler): event handlers (node, code) of pages with the route that their first quoted path means."""
    named = handlers.select("node", F.nullif(F.regexp_extract("code", r"['\"](/[^'\"]+)['\"]", 1), F.lit("")).alias("action")).where("action is not null")
    return resolve_actions(named, routes).where("handler is not null").select("node", "action", "handler")


def template_flows(variables: DataFrame, templates: DataFrame, used: DataFrame) -> DataFrame:
    """(node, template, name): backend variables (node, file, name) that a template rendered by their file uses, whole or as the
    part of a dotted name. used: (template, name).
    """
    parts = used.select("template", F.explode(F.array_distinct(F.concat(F.array("name"), F.split("name", r"\.")))).alias("name")).distinct()
    return variables.join(templates, "file").join(parts, ["template", "name"]).select("node", "template", "name").distinct()
