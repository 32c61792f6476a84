"""Times as numbers, the same in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def epoch_day(column: str) -> Column:
    """Days since 1970."""
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
