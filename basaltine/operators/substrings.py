"""Joins on containment: which needles are parts of which texts, by an inverted index of q-grams.

A text that contains a needle has all of its q-grams, so it is enough to look where the needle's rarest one is. Each needle is
looked up by that gram alone, and what is met is verified on the whole texts. A needle that is shorter than q is its own gram:
texts are also cut into pieces of the lengths of such needles. No needle is lost, whatever its length. Only grams
that some needle was given move, without texts; texts are fetched for candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.session import written

Q = 3


def grams(text: Column, sizes: Column) -> Column:
    """The distinct pieces of text of each of the given sizes."""
    n = F.char_length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str, q: int = Q) -> DataFrame:
    """needles with the rows of texts whose text contains the needle. Empty and null needles are in none. Columns of both sides have different names."""
    short = needles.select(F.col(needle).alias("needle")).where(F.char_length("needle") > 0).distinct()
    short = written(short.withColumn("size", F.least(F.char_length("needle"), F.lit(q))), "needles")
    bodies = written(texts.select(F.col(text).alias("body")).where("body is not null").distinct().withColumn("id", F.xxhash64("body")), "bodies")
    own = short.select("needle", F.explode(grams(F.col("needle"), F.array("size"))).alias("gram"))
    sizes = F.array(*[F.lit(r[0]) for r in short.select("size").distinct().orderBy("size").collect()]).cast("array<int>")  # q at most
    index = bodies.select("id", F.explode(grams(F.col("body"), sizes)).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    index = written(index, "grams")
    held = own.join(index.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left")
    # a needle with a gram that no text has is in none
    rarest = held.groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), F.col("gram"))).alias("gram"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
    met = rarest.where("df > 0").join(index, "gram").join(bodies, "id").where(F.contains("body", F.col("needle"))).select("needle", "body")
    pairs = needles.join(met, F.col(needle) == F.col("needle")).drop("needle")
    return pairs.join(texts, F.col("body") == F.col(text)).drop("body")
