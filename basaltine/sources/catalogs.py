"""Catalogs that are kept as files: controls, and rules that are read again when their file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.operators.rules import Catalog

CONTROLS = "control_id string, chapter_id string, chapter string, section_id string, section_name string, level string, description string, detection_strategy string, check_ref string"


def controls(spark: SparkSession, path: str) -> DataFrame:
    """The controls of a JSON list; of several with one id the last in the list counts. Entries without an id are left out."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in CONTROLS.split(', '))}>>")).alias("pos", "c"))
    return rows.where("c.control_id is not null").groupBy("c.control_id").agg(F.max_by("c", "pos").alias("c")).select("c.*")


def seeded(known: DataFrame, new: DataFrame) -> DataFrame:
    """Controls after an upsert: new ones replace known ones of the same id."""
    return known.join(new, "control_id", "left_anti").unionByName(new)


class RuleFile:
    """A catalog of rules in a file; get() reads it again once it has changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.changed_at, self.catalog = spark, path, None, Catalog([])

    def get(self) -> Catalog:
        row = self.spark.read.format("binaryFile").load(self.path).agg(F.max("modificationTime")).first()
        if row[0] is not None and (self.changed_at is None or row[0] > self.changed_at):
            self.catalog, self.changed_at = Catalog.from_json(self.spark, self.path), row[0]
        return self.catalog


def scanned_files(files: DataFrame, allowed: DataFrame, manifests: list[str]) -> DataFrame:
    """Files (path, name, ...) that a scan reads, each path once: those allowed (path; all if it is empty), and manifests always."""
    every = allowed.isEmpty()
    chosen = files if every else files.join(allowed.select("path").distinct(), "path", "left_semi")
    return chosen.unionByName(files.where(F.lower("name").isin(manifests))).dropDuplicates(["path"])
