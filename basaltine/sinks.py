"""Reports of findings: JSON, CSV, SARIF, and keep-latest writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.functions.scoring import lookup

#: Fixed value: severities as SARIF levels.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
CSV_COLUMNS = ["type", "severity", "file", "line", "message", "confidence"]


def to_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def to_csv(findings: DataFrame, path: str) -> None:
    findings.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def _result(f) -> Column:
    start = F.greatest(F.col("line"), F.lit(1))
    end = F.greatest(F.col("end_line"), start) if "end_line" in f.columns else start
    region = F.struct(start.alias("startLine"), end.alias("endLine"), F.struct(F.substring("code", 1, 500).alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("rule").alias("ruleId"),
        lookup(SARIF_LEVEL, F.lower("severity"), "warning").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"),
    )


def to_sarif(findings: DataFrame, tool: str = "basaltine") -> DataFrame:
    """(scan_id, sarif): one document for each scan. Rules are keyed by CWE, else by type, in order of first sight; those with a
    CWE have a link to it, and the categories found with them as tags. end_line and owasp are used where findings have them.
    """
    f = findings.withColumn("rule", F.coalesce(F.nullif("cwe", F.lit("")), "type"))
    owasp = F.col("owasp") if "owasp" in f.columns else F.lit(None).cast("string")
    tags = F.array_sort(F.collect_set(F.nullif(owasp, F.lit(""))))
    rules = f.groupBy("scan_id", "rule").agg(F.min("ord").alias("ord"), F.min_by("type", "ord").alias("name"), tags.alias("tags"))
    number = F.nullif(F.regexp_extract("rule", r"^CWE-(\d+)$", 1), F.lit(""))
    link = F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html"))
    rule = F.struct(F.col("ord"), F.col("rule").alias("id"), F.col("name"), link.alias("helpUri"), F.struct(F.array_compact(F.concat(F.array(F.lit("security")), "tags")).alias("tags")).alias("properties"))
    rules = rules.groupBy("scan_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    results = f.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(_result(f)).alias("r")))).alias("results"))
    both = rules.join(results, "scan_id")
    body = F.format_string(
        '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"%s","rules":%s}},"results":[%s]}]}',
        F.lit(tool),
        F.to_json(F.transform("rules", lambda r: F.struct(*[r[c].alias(c) for c in ("id", "name", "helpUri", "properties")]))),
        F.array_join(F.transform("results", lambda r: r.r), ","),
    )
    return both.select("scan_id", body.alias("sarif"))


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what an upsert of append-only rows leaves."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert(spark, changes: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that the changes touch."""
    changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
