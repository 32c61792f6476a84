"""De-duplication of findings: best row per key, overlapping intervals, merged ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the given order, which should end with a total one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], name: str = "island") -> DataFrame:
    """df with the number, within its key, of the run of overlapping intervals that each row is in.

    On a line overlapping intervals are connected exactly if no gap parts them: a row opens an island when it starts
    after the largest end before it. One sort by key and start; no pair is made.
    """
    w = Window.partitionBy(*keys).orderBy(start, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn(
        name, F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__opens")


def merged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ids: str, others: str = "contributing") -> DataFrame:
    """The best row of each key, with the sorted other ids of the key."""
    best = best_per_key(df, keys, order)
    every = df.groupBy(*keys).agg(F.collect_set(ids).alias(others))
    joined = best.join(every, list(keys))
    return joined.withColumn(others, F.array_sort(F.array_except(others, F.array(ids))))
