"""The life of scans as an append-only log: begun, changed, cancelled, deleted; and lists of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that nothing changes any more; what a scan begins with.
ENDED = ["COMPLETED", "FAILED", "CANCELLED"]
BEGUN = "PENDING"


def begun(requests: DataFrame, now: Column) -> DataFrame:
    """Log rows (scan_id, user_id, repo_id, input_type, state, at) for requests that may start (scan_id, user_id, repo_id, code)."""
    kind = F.when(F.col("repo_id").isNotNull(), "repository").otherwise("code")
    return requests.select("scan_id", "user_id", "repo_id", kind.alias("input_type"), F.lit(BEGUN).alias("state"), now.alias("at"))


def marked(scans: DataFrame, state: str, now: Column) -> DataFrame:
    """Log rows that give scans another state; DELETED is a tombstone."""
    return scans.select("scan_id", "user_id", "repo_id", "input_type", F.lit(state).alias("state"), now.alias("at"))


def current(log: DataFrame) -> DataFrame:
    """The scans as they stand: the first state of ENDED stays, else the last one; scans with a tombstone are gone."""
    row = F.struct("user_id", "repo_id", "input_type", "state", "at")
    ended = F.col("state").isin(ENDED)
    g = log.groupBy("scan_id").agg(
        F.min_by(F.when(ended, row), F.when(ended, F.col("at"))).alias("first_end"),
        F.max_by(row, F.when(F.col("state") != "DELETED", F.col("at"))).alias("last"),
        F.min("at").alias("created_at"),
        F.bool_or(F.col("state") == "DELETED").alias("gone"),
    )
    kept = g.where("not gone").withColumn("r", F.coalesce("first_end", "last"))
    finished = F.when(F.col("r.state").isin(ENDED), F.col("r.at"))
    return kept.select("scan_id", "r.user_id", "r.repo_id", "r.input_type", "r.state", "created_at", finished.alias("finished_at"))


def recent(scans: DataFrame, repositories: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """The last n scans with the names of their repository and user, where they are known."""
    last = scans.orderBy(F.desc("created_at"), "scan_id").limit(n)
    named = last.join(repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("repository")), "repo_id", "left")
    named = named.join(users.select(F.col("id").alias("user_id"), F.coalesce("full_name", "email").alias("user")), "user_id", "left")
    return named.select("scan_id", "state", "created_at", "repository", "user").orderBy(F.desc("created_at"), "scan_id")
