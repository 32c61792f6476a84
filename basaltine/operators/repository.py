"""The graph of a whole repository, kept from build to build.

What parsing gives depends on a file's language and content alone, so it is stored under their hash: a build parses
only the hashes that the store lacks (an anti-join), each once, however many files have it. Which file a reference means
depends on the paths there are. A build compares its paths and hashes with those of the last one: links are made anew for
files that came or changed and for files that refer to a name which a new or lost path can answer to; all others
are taken over. The result equals a build from nothing.

The store is a folder that all executors see: `nodes`, `edges` and `refs` by hash, in folders by the hash's first
digits, and a snapshot (path, hash) and the links (path, ref, target) of each build. A build that fails leaves at most
parsed hashes behind, which the next one uses. Null contents are empty files. Rows with one path and different contents all
count: the path has the nodes, edges and references of each of them. Nothing tells which of its contents stands for which
of the last build, so such a path is linked anew by every build.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basaltine.session import written


@dataclass
class Build:
    """A finished build: how many contents it parsed, how many files it linked anew, and its tables."""

    parsed: int
    relinked: int
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame


class RepositoryGraph:
    """A stored graph.

    parse: (hash, language, content) -> nodes with a column hash; edges, refs: from such nodes the rows (hash, src, dst, type) and
    (hash, ref); keys: the names that a path answers to, of which a reference takes the smallest path; digits: of the hash, that name a folder, always the same for a store.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        parse: Callable[[DataFrame], DataFrame],
        edges: Callable[[DataFrame], DataFrame],
        refs: Callable[[DataFrame], DataFrame],
        keys: Callable[[Column], Column],
        digits: int = 2,
    ):
        self.spark, self.root, self.digits = spark, root.rstrip("/"), digits
        self.parse, self.edges_of, self.refs_of, self.keys = parse, edges, refs, keys
        nothing = parse(spark.createDataFrame([], "hash string, language string, content string"))
        shapes = {"nodes": nothing, "edges": edges(nothing), "refs": refs(nothing), "hashes": nothing.select("hash")}
        self.shapes = {name: StructType([*df.schema.fields, StructField("shelf", StringType())]) for name, df in shapes.items()}
        self.version = 0
        while self._there(f"links/{self.version + 1}"):
            self.version += 1

    def _there(self, name: str) -> bool:
        """Whether a table has been written to its end."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(self.shapes[name]) if name in self.shapes else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def _store(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("shelf", F.substring("hash", 1, self.digits)).repartition("shelf").write.mode("append").partitionBy("shelf").parquet(f"{self.root}/{name}")

    def _parse_new(self, contents: DataFrame) -> int:
        """Parses what the store lacks; the hash goes to `hashes` last, so a hash that is there has all its rows."""
        wanted = contents.dropDuplicates(["hash"])
        if self._there("hashes"):
            wanted = wanted.join(self._read("hashes").select("hash"), "hash", "left_anti")
        wanted = written(wanted.select("hash", "language", "content"), "to-parse")
        n = wanted.count()
        if n or not self._there("hashes"):
            nodes = written(self.parse(wanted), "parsed")
            for name, rows in (("nodes", nodes), ("edges", self.edges_of(nodes)), ("refs", self.refs_of(nodes).distinct())):
                if self._there(name):  # rows of hashes whose build was broken off
                    rows = rows.join(self._read(name).select("hash").distinct(), "hash", "left_anti")
                self._store(name, rows)
            self._store("hashes", wanted.select("hash"))
        return n

    def _of(self, files: DataFrame, name: str) -> DataFrame:
        """The stored rows of files (path, hash); `shelf` is joined too, so shelves that no file needs aren't read."""
        return files.withColumn("shelf", F.substring("hash", 1, self.digits)).join(self._read(name), ["shelf", "hash"]).drop("shelf")

    def _link(self, files: DataFrame, paths: DataFrame) -> DataFrame:
        """(path, ref, target) of files, by all paths."""
        refs = self._of(files, "refs").select("path", "ref")
        answers = paths.select(F.explode(self.keys(F.col("path"))).alias("ref"), F.col("path").alias("target"))
        answers = answers.join(refs.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.min("target").alias("target"))
        return refs.join(answers, "ref", "left").select("path", "ref", "target").distinct()

    def build(self, files: DataFrame) -> Build:
        """Brings the graph up to a snapshot of files (path, language, content)."""
        body = F.coalesce("content", F.lit(""))
        digest = F.sha2(F.concat(F.coalesce("language", F.lit("")), F.lit(":"), body), 256)
        hashed = files.select("path", "language", body.alias("content"), digest.alias("hash"))
        parsed = self._parse_new(hashed)
        now = written(hashed.select("path", "hash").distinct(), "snapshot")

        if self.version:
            before, links = self._read(f"snapshots/{self.version}"), self._read(f"links/{self.version}")
            span = lambda rows, a, b: rows.groupBy("path").agg(F.min("hash").alias(a), F.max("hash").alias(b))
            both = span(now, "low", "high").join(span(before, "old_low", "old_high"), "path", "full_outer")
            both = written(both.where("not (low <=> high and low <=> old_low and low <=> old_high)"), "changes")
            moved = both.where("low is null or old_low is null").select(F.explode(self.keys(F.col("path"))).alias("ref")).distinct()
            touched = both.where("low is not null").select("path").unionByName(links.join(moved, "ref", "left_semi").select("path")).distinct()
            again = written(now.join(touched, "path", "left_semi"), "to-link")
            gone = both.select("path").unionByName(again.select("path")).distinct()
            new = links.join(gone, "path", "left_anti").unionByName(self._link(again, now))
            relinked = again.select("path").distinct().count()
        else:
            new, relinked = self._link(now, now), now.select("path").distinct().count()
        self.version += 1
        now.write.mode("overwrite").parquet(f"{self.root}/snapshots/{self.version}")
        new.write.mode("overwrite").parquet(f"{self.root}/links/{self.version}")
        return Build(parsed, relinked, now, self._of(now, "nodes"), self._of(now, "edges"), self._read(f"links/{self.version}"))
