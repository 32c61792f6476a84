"""All matches of patterns in whole texts, with their places and lines.

A text is matched once from end to end, across its lines: each match is taken together with the text before it, so places are
sums of lengths and lines are sums of line ends, and nothing is searched again. Only matches and lengths move,
to be summed up in their text's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _parts(text: Column, pattern: str) -> Column:
    """An array of (whole, match): the text from the last match to the end of this one, and this one. \\G keeps a failed search from starting over."""
    step = F.lit(rf"\G(?s:.*?)({pattern})")
    whole, match = F.regexp_extract_all(text, step, F.lit(0)), F.regexp_extract_all(text, step, F.lit(1))
    return F.arrays_zip(whole.alias("whole"), match.alias("match"))


def _named(parts: Column, name: str) -> Column:
    return F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("pattern"), i.alias("pos"), x["whole"].alias("whole"), x["match"].alias("match")))


def _line_ends(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))


def all_matches(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """rows, without text, with pattern, n, start, end, line, end_line, match for each match of each pattern.

    start counts signs from 0, end is the place behind the match, n and lines count from 1. Patterns must match something;
    groups inside them are not counted. Null texts have no matches.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_named(_parts(body, p), name) for name, p in patterns.items()])
    kept = [c for c in rows.columns if c != text]
    every = rows.withColumn("row_", F.monotonically_increasing_id()).select(*kept, "row_", F.explode(found).alias("m"))
    every = every.select(
        *kept,
        "row_",
        "m.pattern",
        F.col("m.pos").alias("pos"),
        F.char_length("m.whole").alias("whole"),
        _line_ends(F.col("m.whole")).alias("ends"),
        _line_ends(F.col("m.match")).alias("inside"),
        F.col("m.match").alias("match"),
    )
    so_far = Window.partitionBy("row_", "pattern").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end, last = F.sum("whole").over(so_far), F.sum("ends").over(so_far) + 1
    return every.select(
        *kept,
        "pattern",
        (F.col("pos") + 1).alias("n"),
        (end - F.char_length("match")).alias("start"),
        end.alias("end"),
        (last - F.col("inside")).alias("line"),
        last.alias("end_line"),
        "match",
    )
