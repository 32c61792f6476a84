"""URL filters: host-suffix and path-prefix rules by hash-prefix joins.

Each url becomes expressions: the suffixes of its host of as many labels as some rule's host has, with the path
prefixes of the lengths that some rule's path has; a url of any length has as many as the rules ask for. An expression's SHA-256 digest is compared with those of the rules in two steps, as in lists that are shipped as
hash prefixes: an equi-join on the first 32 bits, then the full 256 bits. Of the rules that fit, the longest (host and
path together) wins; of equally long ones, block wins over allow, then the smaller text.

Distinct urls are judged once, so a url that a third of all rows repeat is expanded once. Rows: every row of the
input stays, repeated rows too. Null urls and urls without "://" have an empty host and path, fit no rule and get the
default verdict, allow. Columns of the input that are named like a result column are replaced by it; others may have
any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.llm.common import ascii_lower, fresh

#: Bits of the short hash, as hexadecimal digits.
SHORT = 8


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table; repeated ones count once, and block wins over allow."""
    df = spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, host string, path string")
    return df.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """Of an expression; hosts hold no slash, so the parts stay apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. rules: verdict, host, path."""
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    labels_of = rules.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"))
    urls = pages.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct()
    urls = urls.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), lengths.scalar().alias("ns"), labels_of.scalar().alias("ls"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter("ls", lambda n: n <= F.size(labels)), lambda n: F.concat_ws(".", F.slice(labels, -n, n)))
    prefixes = F.transform(
        F.filter("ns", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    seen = (
        urls.where(F.locate("://", "u") > 0)
        .select("u", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
        .select("u", "h", F.explode("ps").alias("p"))
        .select("u", _digest(F.col("h"), F.col("p")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    known = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"),
            (F.col("verdict") == "block").alias("block"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("r"),
    ).withColumn("short", F.substring("rule_digest", 1, SHORT))
    best = (
        seen.join(known, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("u")
        .agg(F.max_by("r", F.struct("r.n", "r.block", "r.rule")).alias("r"))
    )
    base = pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    u, r = fresh(base, "u_", "r_")
    out = base.join(best.select(F.col("u").alias(u), F.col("r").alias(r)), F.col(url) == F.col(u), "left")
    return out.select(
        *base.columns,
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col(r)["rule"].alias("rule"),
        F.coalesce(F.col(r)["verdict"], F.lit(default)).alias("verdict"),
    )
