"""Extraction from pages and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.functions import html as H
from basaltine.plans.registry import query
from basaltine.session import table


@query(
    "html_extract",
    """SELECT page_id, 'link' AS kind, x AS value, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) AS x FROM pages) GROUP BY ALL
    UNION ALL SELECT page_id, 'script', x, count(*) FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS x FROM pages) GROUP BY ALL""",
)
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    found = F.concat(
        F.transform(H.attributes(html, "a", "href"), lambda x: F.struct(F.lit("link").alias("kind"), x.alias("value"))),
        F.transform(H.scripts(html), lambda x: F.struct(F.lit("script").alias("kind"), x.alias("value"))),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.inline(found))
    return rows.groupBy("page_id", "kind", "value").agg(F.count("*").alias("n"))


@query(
    "html_profile",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<form(?:>| [^>]*>)')) AS BIGINT) AS forms, CAST(len(regexp_extract_all(html, '<p(?:>| [^>]*>)')) AS BIGINT) AS paragraphs,
    CAST(len(regexp_extract_all(html, ' (on[a-z]+="[^"]*")')) AS BIGINT) AS handlers,
    CASE WHEN regexp_matches(html, '\\{%[^%]*%\\}') THEN 'jinja2' WHEN contains(html, '<%') THEN 'ejs' WHEN regexp_matches(html, '\\{\\{#') THEN 'handlebars'
    WHEN regexp_matches(html, ' v-[a-z]+=') THEN 'vue' WHEN regexp_matches(html, '\\{\\{') THEN 'jinja2' ELSE 'html' END AS engine FROM pages""",
)
def html_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.size(H.elements(html, "form")).cast("long").alias("forms"),
        F.size(H.elements(html, "p")).cast("long").alias("paragraphs"),
        F.size(H.handlers(html)).cast("long").alias("handlers"),
        H.template_engine(F.lit("page.html"), html).alias("engine"),
    )


@query(
    "json_props",
    """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY ALL""",
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long").k
    e = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return e.groupBy("event_type", (F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.max("k").alias("top"))


@query(
    "url_parts",
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", "://([^/]*)", 1).alias("host"),
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"),
    )


@query(
    "lines_of_code",
    """SELECT source AS repo, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc FROM documents GROUP BY 1""",
)
def lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.sum(F.size(F.split("text", "\n", -1)))
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("files"), loc.alias("loc"))
