"""Joins that go beyond equality: as-of, band, theta, positional, suffix, interval.

All of them keep an equality on a key, so they are dealt out by it. Band joins cut the range axis into buckets and join on the
bucket too, so a group that holds a third of all rows is spread out. As-of joins and interval anti-joins are one sort of a
key's rows: memory is not bound to a key, since the sort spills, but a key is one task. Points in ranges (trees.within) are
spread by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, carry: Sequence[str]) -> DataFrame:
    """left with the columns carry of the last row of right at or before it (null if none).

    One sort by (keys, time) over the union of both sides: no pair is ever made. Rows of right come first on ties.
    """
    left_names = left.columns
    tagged_right = right.select(
        *keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.struct(*carry).alias("__r"), F.lit(None).alias("__l")
    )
    tagged_left = left.select(
        *keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__r"), F.struct(*left_names).alias("__l")
    )
    both = tagged_right.unionByName(tagged_left)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in carry])


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, carry: Sequence[str]) -> DataFrame:
    """left with the columns carry of the first row of right after it (null if none)."""
    left_names = left.columns
    tagged_right = right.select(
        *keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.struct(*carry).alias("__r"), F.lit(None).alias("__l")
    )
    tagged_left = left.select(
        *keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__r"), F.struct(*left_names).alias("__l")
    )
    both = tagged_right.unionByName(tagged_left)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(0, Window.unboundedFollowing)
    filled = both.withColumn("__r", F.first("__r", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in carry])


def band(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, width: int | float, how: str = "inner") -> DataFrame:
    """Rows with equal keys and |a - b| <= width. The axis is cut into buckets of that width; right is copied to three."""
    bucket = F.floor(F.col(a) / F.lit(width)).alias("__bucket")
    spread = F.explode(F.array(*[F.floor(F.col(b) / F.lit(width)) + d for d in (-1, 0, 1)])).alias("__bucket")
    r = right.select("*", spread)
    close = F.abs(F.col(a) - F.col(b)) <= width
    l_, r_ = left.select("*", bucket).alias("l"), r.alias("r")
    on = close
    for k in [*keys, "__bucket"]:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    joined = l_.join(r_, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bucket")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys]).drop("__bucket")


def interval_anti(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows of left whose interval meets none of right's with equal keys.

    No pairs are made: in the order of right's starts and left's ends, a left row is met if the largest end of right so far
    reaches its start. Rows of left with a null in a key or a bound meet nothing.
    """
    r = right.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__side"), F.col(end).alias("__end"), F.lit(None).alias("__l"))
    l_ = left.select(*keys, F.col(end).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__end"), F.struct(*left.columns).alias("__l"))
    known = F.col("__at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = r.where(known & (F.col("__at") <= F.col("__end"))).unionByName(l_)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = F.max("__end").over(w) >= F.col(f"__l.{start}")
    met = met & known & (F.col(f"__l.{start}") <= F.col("__at"))
    return both.withColumn("__met", met).where("__side = 1 and not coalesce(__met, false)").select("__l.*")


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column | str], right_order: Sequence[Column | str]) -> DataFrame:
    """The n-th row of a key on the left with the n-th on the right; pos counts from 0."""
    a = left.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)) - 1)
    b = right.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)) - 1)
    return a.join(b, [*keys, "pos"])


def suffix_resolve(left: DataFrame, right: DataFrame, name: str, path: str, sep: str = "/") -> DataFrame:
    """Each name with the paths that end with it at a part's border: paths are expanded to their tails, then equality."""
    parts = F.split(F.col(path), sep)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))
    return left.join(right.withColumn("__tail", F.explode(tails)), F.col(name) == F.col("__tail")).drop("__tail")
