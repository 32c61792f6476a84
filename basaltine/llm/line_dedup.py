"""Line dedup: lines found in many documents are dropped everywhere, counted in levelled sorted runs.

The store is a log-structured one. A run is a table of line hashes (128 bits) and counts, bucketed and sorted by hash,
all runs in the same buckets, so runs meet by merging and only what is new moves. A batch of documents counts its own
line keys, which is the one shuffle, and merge-anti-joins the runs: keys whose count has already reached the threshold
are left out, for the others what the runs know is added to the batch's own count, and the result is the batch's run.
So the newest run that holds a key has its count so far. When a level has FANOUT runs they are merged into one run of
the next level, the newest count staying, so a key is rewritten as often as the logarithm of the number of batches.

Dropping needs no line's text in a shuffle: each distinct text (by 128-bit hash) is joined with the saturated hashes
of its lines, which gives the places of its lines to drop, and each document keeps the slices between them. Line
counts are summed on the map side before any shuffle, so a line in a third of all documents is one row for each task;
the join of lines with saturated keys is salted by the text's hash.

Null and empty texts are one empty line. Empty keys are never dropped. Repeated rows count as documents of their own,
also if their ids are the same. A key that is in exactly min_docs documents is dropped. Texts of any length are read
whole, in time that goes with their length. An empty table gives an empty result. Columns of the input named like a
result column are replaced; others may have any names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.llm.common import SPACE, ascii_lower, fresh, let, new_folder, written

#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Copies of a saturated key that the join deals to different tasks.
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits of a key, in one struct of two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def document_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(a, b): the hashes of the distinct line keys of each document."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), line_key))
    long = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    return docs.select(F.explode(F.transform(long, key_hash)).alias("h")).select("h.a", "h.b")


class LineRuns:
    """Levelled sorted runs of (a, b, n) in the shared folder; n counts all documents up to the run's batch."""

    def __init__(self, spark: SparkSession, saturated_at: int, fanout: int = FANOUT):
        self.spark, self.saturated_at, self.fanout = spark, saturated_at, fanout
        self.root = new_folder(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        path = f"{self.root}/run-{self.made}"
        self.made += 1
        counts.write.format("parquet").bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _newest(self, names: list[str]) -> DataFrame:
        """The rows of some runs, oldest first; of a key's rows that of the newest run. Each run meets the newer ones bucket by bucket."""
        parts = []
        for k, name in enumerate(names):
            rows = self.spark.table(name)
            for newer in names[k + 1 :]:
                rows = rows.join(self.spark.table(newer).select("a", "b"), ["a", "b"], "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _all(self) -> list[str]:
        return [n for level in reversed(self.levels) for n in level]

    def counts(self) -> DataFrame | None:
        """(a, b, n) over all runs; None if there are none."""
        names = self._all()
        return self._newest(names) if names else None

    def saturated(self) -> DataFrame | None:
        """(a, b) of the keys whose count has reached the threshold: one run has the count, later ones don't have the key."""
        full = [self.spark.table(n).where(F.col("n") >= self.saturated_at).select("a", "b") for n in self._all()]
        return reduce(DataFrame.unionByName, full) if full else None

    def merged(self, keys: DataFrame) -> DataFrame:
        """(a, b, n) of a batch's keys that weren't saturated before, n with what the runs know."""
        own = keys.groupBy("a", "b").agg(F.count("*").alias("n"))
        known = F.lit(0).cast("long")
        for k, name in enumerate(self._all()):
            run = self.spark.table(name).withColumnRenamed("n", f"n{k}")
            own = own.join(run, ["a", "b"], "left")
            known = F.greatest(known, F.coalesce(f"n{k}", F.lit(0)))
        return own.where(known < self.saturated_at).select("a", "b", (F.col("n") + known).alias("n"))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: one row (a, b) for each document and key."""
        self._write(self.merged(keys), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._newest(old), level + 1)
                self._drop(old)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def close(self) -> None:
        """Takes the runs out of the catalog; their files go with the program."""
        self._drop(self._all())


def drop_lines(docs: DataFrame, hot: DataFrame, text: str, min_chars: int) -> DataFrame:
    """docs with the lines dropped whose key hash is in hot (a, b); adds n_lines, n_dropped."""
    ta, tb, gone = fresh(docs, "ta_", "tb_", "gone_")
    body = F.coalesce(F.col(text), F.lit(""))
    ids = [F.xxhash64(body).alias(ta), F.xxhash64(F.lit(1), body).alias(tb)]
    lines = docs.select(*ids, F.posexplode(lines_of(F.col(text))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= min_chars).select(ta, tb, "pos", key_hash(F.col("key")).alias("h"))
    lines = lines.select(ta, tb, "pos", "h.a", "h.b", F.pmod(ta, F.lit(SALTS)).cast("int").alias("salt"))
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = lines.join(salted, ["a", "b", "salt"]).select(ta, tb, "pos").distinct()  # copies of a text meet in their task
    found = met.groupBy(ta, tb).agg(F.array_sort(F.collect_list("pos")).alias(gone))  # of one text's lines
    joined = docs.select("*", *ids).join(written(found, "dropped-lines"), [ta, tb], "left")  # a plain join, which can be split
    every, n = lines_of(F.col(text)), F.size(gone)
    first = lambda j: F.when(j == 0, 1).otherwise(F.get(F.col(gone), j - 1) + 2)  # noqa: E731  of the slice behind the j-th place
    last = lambda j: F.when(j == n, F.size(every)).otherwise(F.get(F.col(gone), j))
    between = let(every, lambda ls: F.flatten(F.transform(F.sequence(F.lit(0), n), lambda j: F.slice(ls, first(j), last(j) - first(j) + 1))))
    kept = F.when(F.col(gone).isNull(), body).otherwise(F.array_join(between, "\n"))
    return (
        joined.withColumn("n_lines", F.size(every).cast("long"))
        .withColumn("n_dropped", F.coalesce(n, F.lit(0)).cast("long"))
        .withColumn(text, kept)
        .drop(ta, tb, gone)
    )


def dedup_lines(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 3
) -> DataFrame:
    """docs with text less the lines whose key is in min_docs documents or more, with n_lines and n_dropped.

    The table is counted in so many batches, told apart by the hash of the text.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    runs = LineRuns(docs.sparkSession, min_docs)
    for i in range(batches):
        part = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(batches)) == i)
        runs.add(document_keys(part, text, min_chars))
    hot = written(runs.saturated(), "hot-lines")
    runs.close()
    return drop_lines(docs, hot, text, min_chars)
