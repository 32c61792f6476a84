"""Source trees, archives and manifests as tables."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.functions.text import LANGUAGES, excluded, language_of
from basaltine.sources.manifests import READERS, references

#: Names of dependency manifests and lock files, in lower case.
MANIFESTS = list(READERS)
#: What is left out unless the caller says otherwise: installed packages, version control, caches, builds.
EXCLUDED = ["node_modules", ".git", "__pycache__", "venv", "dist", "*.min.js"]
#: Limits of an archive.
MAX_MEMBERS, MAX_BYTES = 10_000, 500 << 20


def tree(spark: SparkSession, root: str, exclude: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, rel_path, language, content, sha256) of the source files under a folder.

    only: rel_path values to keep; an empty table keeps all. Content is read for the files that stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", f"^.*{re.escape(root.rstrip('/'))}/", "")
    files = files.select("path", rel.alias("rel_path"), "content")
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*LANGUAGES))
    files = files.where(~excluded(F.col("rel_path"), EXCLUDED if exclude is None else exclude))
    if only is not None and not only.isEmpty():
        files = files.join(only.select("rel_path").distinct(), "rel_path", "left_semi")
    text = F.decode("content", "UTF-8")
    key = F.sha2(F.concat_ws(":", language_of(F.col("path")), text), 256)
    return files.select("path", "rel_path", language_of(F.col("path")).alias("language"), text.alias("content"), key.alias("sha256"))


def named_files(spark: SparkSession, root: str, wanted: Column) -> DataFrame:
    """(path, name, content) of files that a predicate over name (lower case) picks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1))).where(wanted)
    parts = F.split("path", "/")
    files = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in EXCLUDED if "*" not in x])))
    return files.select("path", "name", F.decode("content", "UTF-8").alias("content"))


def is_manifest() -> Column:
    return F.col("name").isin(*MANIFESTS) | F.col("name").startswith("requirements")


def is_config() -> Column:
    name = F.col("name")
    return (
        name.startswith(".env") | name.startswith("dockerfile") | name.rlike(r"\.(ya?ml|conf|tf|json)$") | name.contains("nginx") | (name == ".npmrc")
    )


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside the folder it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and not re.match(r"^[A-Za-z]:", name)


def _members(path: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files of an archive. Links, devices and names that lead out of it end the reading with an error."""
    n = size = 0
    if zipfile.is_zipfile(io.BytesIO(raw)):
        archive = zipfile.ZipFile(io.BytesIO(raw))
        entries = [(i.filename, i.is_dir(), (i.external_attr >> 16) & 0o170000 not in (0, 0o100000, 0o040000), i) for i in archive.infolist()]
        opened = archive.open
    else:
        tar = tarfile.open(fileobj=io.BytesIO(raw))
        entries = [(i.name, i.isdir(), not (i.isfile() or i.isdir()), i) for i in tar.getmembers()]
        opened = tar.extractfile
    for name, folder, odd, entry in entries:
        n += 1
        if n > MAX_MEMBERS or odd or not safe_member(name):
            raise ValueError(f"{path}: member {name!r} is not allowed")
        if folder:
            continue
        with opened(entry) as f:
            body = f.read(MAX_BYTES - size + 1)
        size += len(body)
        if size > MAX_BYTES:
            raise ValueError(f"{path}: more than {MAX_BYTES} bytes")
        yield name, body


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(archive, name, content) of the zip and tar files under a folder; bytes are counted as they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                for name, body in _members(path, raw):
                    yield pd.DataFrame({"archive": [path], "name": [name], "content": [body]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.lower("path").rlike(r"\.(zip|tar|tgz|tar\.gz)$")).select("path", "content")
    return files.mapInPandas(run, "archive string, name string, content binary")


def dependency_refs(files: DataFrame) -> DataFrame:
    """(repo_id, package, version, ecosystem, path) from manifests (repo_id, path, name, content), each package once.

    package.json is left out of repositories that have a lock file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.repo_id, *ref, r.path) for r in b.itertuples() for ref in references(r.name, r.content or "")]
            yield pd.DataFrame(rows, columns=["repo_id", "package", "version", "ecosystem", "path"])

    locked = files.where("name = 'package-lock.json'").select("repo_id").distinct().withColumn("name", F.lit("package.json"))
    files = files.join(locked, ["repo_id", "name"], "left_anti")
    refs = files.select("repo_id", "path", "name", "content").mapInPandas(
        run, "repo_id string, package string, version string, ecosystem string, path string"
    )
    best = F.min_by(F.struct("package", "path"), F.struct("path", "package")).alias("r")
    once = refs.groupBy("repo_id", F.lower("package").alias("key"), "version", "ecosystem").agg(best)
    return once.select("repo_id", "r.package", "version", "ecosystem", "r.path")


def dependency_findings(refs: DataFrame, advisories: DataFrame, today: Column) -> DataFrame:
    """refs with advisories (ecosystem, name, version, vuln_id, db_severity, cvss_v3, published): severity, days, SLA."""
    named = F.upper("db_severity")
    number = F.try_to_number("cvss_v3", F.lit("99.9")).cast("double")
    banded = F.when(number >= 9, "CRITICAL").when(number >= 7, "HIGH").when(number >= 4, "MODERATE").when(number.isNotNull(), "LOW")
    severity = F.when(named.isin("CRITICAL", "HIGH", "MODERATE", "LOW"), named).otherwise(F.coalesce(banded, F.lit("MODERATE")))
    days = F.expr("timestampdiff(DAY, try_to_timestamp(published), today)")
    sla = F.when(severity == "CRITICAL", 7).when(severity == "HIGH", 30).when(severity == "LOW", 180).otherwise(90)
    a = advisories.withColumnRenamed("name", "package")
    found = refs.join(a, ["ecosystem", "package", "version"]).withColumn("today", today)
    out = found.select(
        *refs.columns, "vuln_id", severity.alias("severity"), days.alias("days_since_published"), sla.alias("sla_days")
    )
    return out.withColumn("breached_sla", F.coalesce(F.col("days_since_published") > F.col("sla_days"), F.lit(False)))


def dependency_verdict(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo_id, verdict, worst): pass without a finding, fail with a breached one, else a review."""
    g = findings.groupBy("repo_id").agg(
        F.bool_or("breached_sla").alias("breached"),
        F.min_by("vuln_id", F.when(F.col("breached_sla"), F.struct("sla_days", "vuln_id"))).alias("worst"),
        F.count("*").alias("n"),
    )
    out = repos.select("repo_id").distinct().join(g, "repo_id", "left")
    verdict = F.when(F.col("n").isNull(), "pass").when(F.col("breached"), "fail").otherwise("manual_review")
    return out.select("repo_id", verdict.alias("verdict"), "worst")
