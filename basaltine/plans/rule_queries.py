"""Queries of the rule scan, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.functions.text import label_matches, snippet
from basaltine.operators.rules import Catalog, Rule, scan
from basaltine.plans.registry import query
from basaltine.session import table

CATALOG = Catalog(
    [
        Rule(
            "SECRET_ASSIGNMENT",
            "Assigned secret",
            "A02",
            "CWE-798",
            "A secret in the text",
            "critical",
            "high",
            sanitizers=["worthless", "license"],
            regex_patterns=[r'(token|secret|password|api_key) *= *"[0-9a-zA-Z]{16,}"'],
            asvs_controls=["V13.3.1"],
        ),
        Rule(
            "EMAIL_ADDRESS",
            "E-mail address",
            "A01",
            "CWE-359",
            "Personal data: an address",
            "high",
            "medium",
            sanitizers=["license"],
            regex_patterns=[r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"],
            asvs_controls=["V14.2.1"],
        ),
        Rule(
            "PHONE_NUMBER",
            "Phone number",
            "A01",
            "CWE-359",
            "Personal data: a number",
            "medium",
            "medium",
            regex_patterns=[r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}"],
            asvs_controls=["V14.2.1"],
        ),
        Rule(
            "LICENSE_LINE",
            "License line",
            "A08",
            "CWE-1104",
            "A license is named",
            "low",
            "high",
            "compliant",
            sanitizers=["license"],
            regex_patterns=[r"(MIT|Apache|BSD|GPL)[^\n]*[Ll]icense|[Ll]icensed under"],
            asvs_controls=["V15.1.2"],
        ),
        Rule("NEVER", "Absent pattern", "A05", "CWE-0", "Matches nothing", "critical", "high", regex_patterns=["zqzqzq[0-9]{9}"]),
    ]
)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RULES_SQL = "(VALUES " + ", ".join(
    f"({_sql_text(r.rule_id)}, {_sql_text(p)}, {_sql_text(r.severity)}, {_sql_text(r.confidence)}, {_sql_text(r.finding_polarity)}, "
    f"[{', '.join(_sql_text(s) for s in r.sanitizers)}]::VARCHAR[], {_sql_text(r.owasp)}, {_sql_text(r.cwe)})"
    for r in CATALOG.rules.values()
    for p in r.regex_patterns
) + ") r(rule_id, pattern, severity, confidence, polarity, sanitizers, owasp, cwe)"

SCAN_SQL = f"""
WITH hit AS (SELECT doc_id, lang, source, text, rule_id, pattern, severity, confidence, polarity,
    CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS hits,
    len(list_filter(sanitizers, lambda s: contains(lower(text), s))) > 0 AND polarity <> 'compliant' AS weak
    FROM documents, {RULES_SQL})
SELECT doc_id, lang, source, rule_id, hits,
    CAST(list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, pattern)), true) AS BIGINT) AS first_line,
    CASE WHEN weak AND severity IN ('critical', 'high') THEN 'medium' ELSE severity END AS severity,
    CASE WHEN weak THEN 'low' ELSE confidence END AS confidence
FROM hit WHERE hits > 0
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return scan(docs, CATALOG, "text").drop("pattern", "sink_label")


@query("rule_scan_documents", SCAN_SQL)
def rule_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)


@query(
    "severity_rollup",
    f"WITH f AS ({SCAN_SQL}) SELECT source, severity, count(*) AS findings, CAST(sum(hits) AS BIGINT) AS hits "
    "FROM f GROUP BY ROLLUP (source, severity)",
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return found.rollup("source", "severity").agg(F.count("*").alias("findings"), F.sum("hits").alias("hits"))


@query(
    "rule_match_line_numbers",
    """SELECT doc_id, CAST(i AS BIGINT) AS line, x AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(x, '[a-z0-9._]+@[a-z0-9]+\\.[a-z]+')""",
)
def rule_match_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    found = docs.where(F.col("content").rlike(r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "content")


@query(
    "match_snippets",
    f"""WITH f AS ({SCAN_SQL}), l AS (SELECT f.doc_id, f.rule_id, f.first_line AS s, string_split(text, chr(10)) AS ls
    FROM f JOIN documents d USING (doc_id) WHERE f.rule_id = 'SECRET_ASSIGNMENT')
    SELECT doc_id, rule_id, array_to_string(list_transform(range(greatest(1, s - 2), least(len(ls), s + 2) + 1),
    lambda i: (CASE WHEN i = s THEN '>>> ' ELSE '    ' END) || lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || ls[i]), chr(10)) AS snippet FROM l""",
)
def match_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("body"))
    hits = scan(docs, CATALOG, "text").where("rule_id = 'SECRET_ASSIGNMENT'")
    line = F.col("first_line").cast("int")
    return hits.select("doc_id", "rule_id", snippet(F.col("body"), line, line, 2).alias("snippet"))


@query(
    "sanitizer_downgrade",
    f"WITH f AS ({SCAN_SQL}) SELECT rule_id, severity, confidence, count(*) AS n FROM f GROUP BY ALL",
)
def sanitizer_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("rule_id", "severity", "confidence").agg(F.count("*").alias("n"))


TOKENS = ["ring", "widget", "bol", "hot", "old b", "small.ring", "gear"]


@query(
    "label_token_match",
    f"""SELECT p_partkey, t AS pattern FROM part, (VALUES {", ".join(f"('{t}')" for t in TOKENS)}) v(t)
    WHERE CASE WHEN regexp_matches(t, '[.()''"]') THEN contains(lower(p_name), t)
    ELSE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), t) END""",
)
def label_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("pattern", F.explode(F.array(*[F.lit(t) for t in TOKENS])))
    return parts.where(label_matches(F.lower("p_name"), F.col("pattern"))).select("p_partkey", "pattern")


#: A catalog of rules that is written from parts.
PART_RULES = """(SELECT p_partkey AS rule_id, CASE p_size % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
    'A0' || p_partkey % 10 AS owasp, 'CWE-' || p_size AS cwe, p_name AS name, p_type AS description FROM part)"""


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("Critical", "high", "medium", "low")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_id"),
        F.get(words, (F.col("p_size") % 4).cast("int")).alias("severity"),
        F.concat(F.lit("A0"), F.col("p_partkey") % 10).alias("owasp"),
        F.concat(F.lit("CWE-"), "p_size").alias("cwe"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
    )


@query(
    "rule_catalog_stats",
    f"SELECT severity, owasp, count(*) AS n FROM {PART_RULES} GROUP BY GROUPING SETS ((), (severity), (owasp))",
)
def rule_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_rules(spark, sf_dir).groupingSets([[], ["severity"], ["owasp"]], "severity", "owasp").agg(F.count("*").alias("n"))


@query(
    "rule_lookups",
    f"""WITH r AS (SELECT * FROM {PART_RULES})
    SELECT 'by_category' AS lookup, rule_id FROM r WHERE owasp = 'A01' UNION ALL SELECT 'by_severity', rule_id FROM r WHERE severity = 'Critical'
    UNION ALL SELECT 'by_cwe', rule_id FROM r WHERE cwe = 'CWE-7' UNION ALL SELECT 'by_id', rule_id FROM r WHERE rule_id = 17
    UNION ALL SELECT 'by_keyword', rule_id FROM r WHERE regexp_matches(name, '(?i)steel') OR regexp_matches(description, '(?i)steel')""",
)
def rule_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = part_rules(spark, sf_dir)
    words = F.lower("name").contains("steel") | F.lower("description").contains("steel")
    wanted = {
        "by_category": F.col("owasp") == "A01",
        "by_severity": F.lower("severity") == "critical",
        "by_cwe": F.col("cwe") == "CWE-7",
        "by_id": F.col("rule_id") == 17,
        "by_keyword": words,
    }
    marks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in wanted.items()]))
    return rules.select(F.explode(marks).alias("lookup"), "rule_id")


@query(
    "license_secret_families",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '(token|secret|password|api_key) *= *"') THEN 'secret'
    WHEN regexp_matches(text, '[Ll]icense') THEN 'license' WHEN regexp_matches(text, '[0-9]{13,16}') THEN 'number' ELSE 'none' END AS family,
    regexp_matches(text, '= *"[a-f0-9]{40}"') AND NOT regexp_matches(text, 'example') AS is_unsafe FROM documents""",
)
def license_secret_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    family = (
        F.when(text.rlike(r'(token|secret|password|api_key) *= *"'), "secret")
        .when(text.rlike("[Ll]icense"), "license")
        .when(text.rlike("[0-9]{13,16}"), "number")
        .otherwise("none")
    )
    unsafe = text.rlike('= *"[a-f0-9]{40}"') & ~text.rlike("example")
    return table(spark, sf_dir, "documents").select("doc_id", family.alias("family"), unsafe.alias("is_unsafe"))


@query(
    "rule_attribution",
    f"""WITH f AS ({SCAN_SQL}), a AS (SELECT source, lang, list_sort(list(DISTINCT rule_id)) AS rules FROM f GROUP BY ALL)
    SELECT x.source, x.lang AS lang_a, y.lang AS lang_b, array_to_string(list_sort(list_intersect(x.rules, y.rules)), ',') AS shared,
    list_min(list_intersect(x.rules, y.rules)) AS attributed FROM a x JOIN a y ON x.source = y.source AND x.lang < y.lang""",
)
def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = findings(spark, sf_dir).groupBy("source", "lang").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))
    b = a.select("source", F.col("lang").alias("lang_b"), F.col("rules").alias("rules_b"))
    both = a.join(b, "source").where("lang < lang_b").withColumn("s", F.array_sort(F.array_intersect("rules", "rules_b")))
    return both.select(
        "source", F.col("lang").alias("lang_a"), "lang_b", F.array_join("s", ",").alias("shared"), F.array_min("s").alias("attributed")
    )
