"""Elements of web pages by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attributes(html: Column, tag: str, attribute: str) -> Column:
    """The values of an attribute over all elements of a kind."""
    return F.regexp_extract_all(html, F.lit(rf'<{tag}[^>]* {attribute}="([^"]*)"'), F.lit(1))


def elements(html: Column, tag: str) -> Column:
    """The opening tags of a kind."""
    return F.regexp_extract_all(html, F.lit(rf"<{tag}(?:>| [^>]*>)"), F.lit(0))


def scripts(html: Column) -> Column:
    """The bodies of inline scripts."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<script>(.*?)</script>"), F.lit(1))


def handlers(html: Column) -> Column:
    """Event handlers as name=code."""
    return F.regexp_extract_all(html, F.lit(r' (on[a-z]+="[^"]*")'), F.lit(1))


def template_variables(html: Column) -> Column:
    """Names in {{ }} or <%= %>."""
    return F.regexp_extract_all(html, F.lit(r"(?:\{\{-?|<%=) *([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))


def template_engine(path: Column, html: Column) -> Column:
    """By extension first, then by what the text holds."""
    return (
        F.when(path.rlike(r"\.(j2|jinja2?)$"), "jinja2")
        .when(path.rlike(r"\.ejs$"), "ejs")
        .when(path.rlike(r"\.hbs$"), "handlebars")
        .when(path.rlike(r"\.vue$"), "vue")
        .when(html.rlike(r"\{%[^%]*%\}"), "jinja2")
        .when(html.contains("<%"), "ejs")
        .when(html.rlike(r"\{\{#"), "handlebars")
        .when(html.rlike(r" v-[a-z]+="), "vue")
        .when(html.rlike(r"\{\{"), "jinja2")
        .otherwise("html")
    )
