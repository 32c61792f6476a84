"""What the operators share: places for intermediate tables, and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.session import new_folder, shared_dir, written  # noqa: F401

#: The characters that part words and are stripped from lines, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table with few bytes a row."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, key: str) -> DataFrame:
    """df, to be broadcast if its rows and keys are known to be small: 32 bytes a row beside the key's characters."""
    size = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, however it is spelt."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(docs: DataFrame, gone: DataFrame, key: str, digest: Column) -> DataFrame:
    """docs less the rows that gone names by (k_, h_): the key, null like others, and a digest that has no null."""
    k, h, mark = fresh(docs, "gone_key_", "gone_hash_", "digest_")
    gone = gone.select(F.col("k_").alias(k), F.col("h_").alias(h)).distinct()
    marked = docs.withColumn(mark, digest)
    return marked.join(gone, F.col(key).eqNullSafe(F.col(k)) & (F.col(mark) == F.col(h)), "left_anti").drop(mark)
