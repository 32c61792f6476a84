"""Verdicts of controls from findings, and the figures built on them. Each is one aggregation, then a CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.functions.scoring import percentage

#: The verdicts, in the order of their columns.
VERDICTS = ["pass", "fail", "manual_review", "not_tested", "not_applicable"]
LEVELS = {"L1": 1, "L2": 2, "L3": 3}


def _max(c: Column, when: Column) -> Column:
    return F.max(F.when(when, F.coalesce(c, F.lit(0.0))))


def fail_wins(findings: DataFrame, keys: list[str], verdict: str = "verdict", confidence: str = "confidence") -> DataFrame:
    """Configuration findings: any fail is a fail, else any pass is a pass; the confidence is the largest of the chosen ones."""
    v, c = F.col(verdict), F.col(confidence)
    g = findings.groupBy(*keys).agg(
        F.bool_or(v == "fail").alias("f"),
        F.bool_or(v == "pass").alias("p"),
        _max(c, v == "fail").alias("cf"),
        F.max(F.coalesce(c, F.lit(0.0))).alias("ca"),
    )
    out = F.when(F.col("f"), "fail").when(F.col("p"), "pass").otherwise("not_tested")
    return g.select(*keys, out.alias("verdict"), F.when(F.col("f"), F.col("cf")).otherwise(F.col("ca")).alias("confidence"))


def any_fail_wins(findings: DataFrame, keys: list[str], verdict: str = "verdict", confidence: str = "confidence") -> DataFrame:
    """Configuration and live probes together: fail wins, then pass, each with its own largest confidence."""
    v, c = F.col(verdict), F.col(confidence)
    g = findings.groupBy(*keys).agg(_max(c, v == "fail").alias("cf"), _max(c, v == "pass").alias("cp"))
    out = F.when(F.col("cf").isNotNull(), "fail").when(F.col("cp").isNotNull(), "pass").otherwise("not_tested")
    return g.select(*keys, out.alias("verdict"), F.coalesce("cf", "cp").alias("confidence"))


def pass_wins(findings: DataFrame, keys: list[str], verdict: str = "verdict", confidence: str = "confidence") -> DataFrame:
    """Configuration and compliant markers together: pass wins, then fail."""
    v, c = F.col(verdict), F.col(confidence)
    g = findings.groupBy(*keys).agg(_max(c, v == "fail").alias("cf"), _max(c, v == "pass").alias("cp"))
    out = F.when(F.col("cp").isNotNull(), "pass").when(F.col("cf").isNotNull(), "fail").otherwise("not_tested")
    return g.select(*keys, out.alias("verdict"), F.coalesce("cp", "cf").alias("confidence"))


def static_verdicts(controls: DataFrame, hits: DataFrame, rules: DataFrame, capability: DataFrame) -> DataFrame:
    """controls (control_id) with verdict and confidence from static evidence.

    hits: control_id, ord, compliant, confirmed, confidence. rules: control_id, compliant. capability: control_id, ord,
    verdict, confidence. Capability findings come first; confirmed violations fail, unconfirmed ones need a review,
    markers alone pass; without any hit a control passes if a rule for violations covers it.
    """
    bad = ~F.col("compliant")
    h = hits.groupBy("control_id").agg(
        F.bool_or(bad & F.col("confirmed")).alias("confirmed"),
        F.bool_or(bad).alias("violated"),
        F.min_by("confidence", F.when(bad & F.col("confirmed"), F.col("ord"))).alias("c_confirmed"),
        F.min_by("confidence", F.when(bad, F.col("ord"))).alias("c_violated"),
        F.min_by("confidence", "ord").alias("c_first"),
        F.lit(True).alias("hit"),
    )
    r = rules.groupBy("control_id").agg(F.bool_or(~F.col("compliant")).alias("covered"))
    cap = capability.groupBy("control_id").agg(F.min_by(F.struct("verdict", "confidence"), "ord").alias("cap"))
    all_ = controls.join(h, "control_id", "left").join(r, "control_id", "left").join(cap, "control_id", "left")
    verdict = (
        F.when(F.col("cap").isNotNull(), F.col("cap.verdict"))
        .when(F.col("confirmed"), "fail")
        .when(F.col("violated"), "manual_review")
        .when(F.col("hit"), "pass")
        .when(F.coalesce("covered", F.lit(False)), "pass")
        .otherwise("not_tested")
    )
    confidence = (
        F.when(F.col("cap").isNotNull(), F.col("cap.confidence"))
        .when(F.col("confirmed"), F.col("c_confirmed"))
        .when(F.col("violated"), F.col("c_violated"))
        .when(F.col("hit"), F.col("c_first"))
        .when(F.col("covered"), F.lit(0.6))
    )
    return all_.select(*controls.columns, verdict.alias("verdict"), confidence.alias("confidence"))


def verdict_pivot(results: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """One row for each key with the number of results of each verdict."""
    counts = [F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS]
    return results.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def level_completion(results: DataFrame, level: str = "level", verdict: str = "verdict") -> DataFrame:
    """(level, total, passed, pct): a level includes those below it."""
    per = results.groupBy(level).agg(F.count("*").alias("n"), F.count_if(F.col(verdict) == "pass").alias("p"))
    rank = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    reaches = F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda t: F.element_at(rank, t) >= F.try_element_at(rank, F.col(level))))
    sums = per.select(reaches.alias("target"), "n", "p").groupBy("target").agg(F.sum("n").alias("total"), F.sum("p").alias("passed"))
    return sums.select(F.col("target").alias("level"), "total", "passed", percentage(F.col("passed"), F.col("total")).alias("pct"))
