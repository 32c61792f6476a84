"""What leaves the engine: documents of findings, evidence, scans, reports, users and graphs, as projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine import sinks
from basaltine.operators.rules import Catalog

#: Groups of finding types by words in their names, the first that fits.
TYPE_GROUPS = [
    ("sql_injection", ["sql injection"]),
    ("command_injection", ["os command", "command injection"]),
    ("code_injection", ["code injection", "eval"]),
    ("ssti", ["server-side template", "template inject"]),
    ("ssrf", ["ssrf", "server-side request forgery"]),
    ("sensitive_data", ["sensitive data"]),
    ("broken_access_control", ["insecure direct object", "idor", "broken access control"]),
    ("file_upload", ["file upload"]),
    ("xss", ["cross-site scripting", "xss"]),
]


def type_group(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(F.lit(False), "")
    for group, words in TYPE_GROUPS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, group)
    return out.otherwise(F.translate(low, " -", "__"))


def sink_line(snippet: Column, sink: Column, start: Column, end: Column) -> Column:
    """The number of the first numbered snippet line that has the sink; else where the finding ends, or begins."""
    lines = F.filter(F.split(F.coalesce(snippet, F.lit("")), "\n"), lambda x: x.rlike(r"^(>>>)?\s*\d+\s*\|") & F.contains(x, sink))
    number = F.regexp_extract(F.get(lines, 0), r"(\d+)\s*\|", 1).cast("int")
    known = F.coalesce(F.nullif(end, F.lit(0)), F.nullif(start, F.lit(0)), F.lit(0))
    return F.when((sink != "") & (sink != "regex") & (F.size(lines) > 0), number).otherwise(known)


def escape_xml(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def valid_control(control: Column) -> Column:
    """Whether a control's id is of the form V1.2.3."""
    return F.coalesce(control.rlike(r"^V\d{1,2}\.\d{1,2}\.\d{1,2}$"), F.lit(False))


def rule_controls(catalog: Catalog) -> list[tuple[str, str]]:
    """(control, rule) pairs: which rules speak for a control."""
    return [(c, r.rule_id) for r in catalog.rules.values() for c in r.asvs_controls]


def finding_documents(findings: DataFrame, catalog: Catalog, score: Column) -> DataFrame:
    """(scan_id, ord, document): findings for the interface. Controls are those of the rule and of the rules merged into it,
    in that order and each once; a finding of no known rule wants a person to look at it.
    """
    spark = findings.sparkSession
    rows = [(r.rule_id, r.name, r.asvs_controls, r.finding_polarity) for r in catalog.rules.values()]
    rules = spark.createDataFrame(rows, "rule_id string, name string, controls array<string>, polarity string")
    every = F.concat(F.array("rule_id"), F.coalesce("contributing_rule_ids", F.array().cast("array<string>")))
    asked = findings.select("scan_id", "ord", F.posexplode(every).alias("pos", "rule_id"))
    met = asked.join(F.broadcast(rules), "rule_id")  # the catalog
    one = F.struct("pos", "rule_id", "name", "controls", "polarity")
    met = met.groupBy("scan_id", "ord").agg(F.array_sort(F.collect_list(one)).alias("known"))
    f = findings.join(met, ["scan_id", "ord"], "left").withColumn("known", F.coalesce("known", F.array().cast(met.schema["known"].dataType)))
    document = F.struct(
        F.col("slice_id").alias("id"),
        F.col("rule_name").alias("type"),
        F.col("final_severity").alias("severity"),
        F.bround("final_confidence", 2).alias("confidence"),
        score.alias("cvss_score"),
        "owasp",
        "cwe",
        F.array_distinct(F.flatten(F.transform("known", lambda r: r["controls"]))).alias("asvs_controls"),
        F.coalesce(F.get("known", 0)["polarity"], F.lit("vulnerable")).alias("asvs_finding_polarity"),
        F.transform(F.slice("known", F.lit(2), F.size("known")), lambda r: F.struct(r["rule_id"].alias("rule_id"), r["name"].alias("name"))).alias("contributing_rules"),
        (F.size("known") == 0).alias("needs_manual_triage"),
        F.struct(F.coalesce("file", F.lit("unknown")).alias("file"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line")).alias("location"),
        F.struct(
            F.col("source_label").alias("source"), F.col("sink_label").alias("sink"), F.col("pattern_type").alias("pattern"), "code_snippet", F.col("path_nodes").alias("data_flow_path")
        ).alias("evidence"),
    )
    return f.select("scan_id", "ord", document.alias("document"))


def evidence(documents: DataFrame) -> DataFrame:
    """(scan_id, ord, control_id, evidence): what a finding says for each of its controls."""
    d = F.col("document")
    place = F.struct(d["location"]["file"].alias("file"), d["location"]["start_line"].alias("line"), d["type"].alias("type"), d["severity"].alias("severity"), d["id"].alias("finding"))
    return documents.select("scan_id", "ord", F.explode(d["asvs_controls"]).alias("control_id"), place.alias("evidence"))


def scan_list(scans: DataFrame, summaries: DataFrame) -> DataFrame:
    """Scans with their figures; a summary's figure counts more than the scan's own."""
    s = summaries.select("scan_id", *[F.col(c).alias(f"s_{c}") for c in ("state", "total_files", "files_scanned")])
    met = scans.join(s, "scan_id", "left")
    return met.select("scan_id", "user_id", "created_at", *[F.coalesce(f"s_{c}", c).alias(c) for c in ("state", "total_files", "files_scanned")]).orderBy(F.desc("created_at"), "scan_id")


def report_list(reports: DataFrame, repo_id=None, date_from=None, date_to=None, tag: str | None = None) -> DataFrame:
    """Reports that fit the filters given; the bounds of the time are included."""
    out = reports
    for given, condition in ((repo_id, F.col("repo_id") == repo_id), (date_from, F.col("created_at") >= date_from), (date_to, F.col("created_at") <= date_to), (tag, F.array_contains("tags", tag))):
        out = out if given is None else out.where(condition)
    return out.orderBy(F.desc("created_at"), "scan_id")


def user_list(users: DataFrame) -> DataFrame:
    status = F.when(F.col("is_active"), "active").otherwise("inactive")
    return users.select("id", "email", "full_name", "role", status.alias("status"), "created_at").orderBy("created_at", "id")


def start_errors(requests: DataFrame) -> DataFrame:
    """requests with error, null for those that may start: code of 400 lines at most, code or a repository, paths only with one."""
    lines = F.size(F.split("code", "\n"))
    code, repo = F.coalesce(F.trim("code") != "", F.lit(False)), F.col("repo_id").isNotNull()
    error = F.when(code & (lines > 400), "code is limited to 400 lines").when(code & repo, "code or a repository, not both").when(~code & ~repo, "code or a repository is needed")
    error = error.when(~repo & (F.coalesce(F.size("paths"), F.lit(0)) > 0), "paths need a repository")
    return requests.withColumn("error", error)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, json): one row for each node and edge, to be written in this order."""
    n = nodes.select(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(*[c for c in nodes.columns if c != "ord"])).alias("json"))
    e = edges.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), *[c for c in edges.columns if c not in ("src", "dst", "ord")])).alias("json"))
    return n.unionByName(e)


FORMATS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": sinks.to_json,
    "csv": sinks.to_csv,
    "sarif": lambda findings, path: sinks.to_sarif(findings).write.mode("overwrite").json(path),
}


def export(findings: DataFrame, path: str, kind: str) -> None:
    """Writes a report in a format of FORMATS; a ValueError names the formats there are."""
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {', '.join(FORMATS)}")
    FORMATS[kind](findings, path)
