"""Sharding: a two-pass external shuffle into shards of equal row counts.

Pass 1 scatters: every row gets a seeded 64-bit hash of its columns and of its place in the input, and goes by that
hash to one of the buckets, which are of bucket_bytes of text, one bucket a task. The place keeps repeated rows apart,
so copies scatter like other rows. Pass 2 puts each bucket in hash order, gives it a Fisher-Yates shuffle and writes
it, row by row with its position, to a table in the shared folder. Writing fixes the order, so that no lost executor
can change it between the steps that follow, and texts move between executors once. The buckets one after the other
are a random order of all rows; row g of it goes to shard g mod n_shards, slot g div n_shards. So law "rows" holds: row
counts are at most one apart and slots have no gaps. Where a bucket begins is broadcast, one number for each bucket;
there are MAX_BUCKETS at most, beyond that buckets grow.

The order depends on the seed and on how the input is stored (its files and splits). A bucket grows beyond its size
only as the sum of independent rows strays, or by one row that is itself larger. Null and empty texts weigh 8 bytes;
null ids and repeated rows are rows like others; an empty table gives an empty result. Columns of the input named
shard or slot are replaced; other names of the input are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltine.llm.common import fresh, written

#: Bytes of text in a bucket, about.
BUCKET_BYTES = 16 << 20
#: Of these one number each is broadcast.
MAX_BUCKETS = 1 << 20


def scatter(df: DataFrame, text: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, str, str]:
    """The rows of each bucket, shuffled and written; and the names of the columns of their bucket and position."""
    bucket, key, pos, held = fresh(df, "bucket_", "key_", "pos_", "held_")
    total = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8), F.lit(0))).first()[0]
    n_buckets = min(MAX_BUCKETS, max(1, -(-total // bucket_bytes)))
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    rows = df.withColumn(key, F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *plain))
    rows = rows.withColumn(bucket, F.pmod(key, F.lit(n_buckets)).cast("int"))
    packed = (
        rows.repartitionById(n_buckets, F.col(bucket))
        .sortWithinPartitions(bucket, key)
        .groupBy(bucket)
        .agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns])).alias(held))
    )
    flat = packed.select(bucket, F.posexplode(F.shuffle(held, seed)).alias(pos, held))
    return written(flat.select(bucket, pos, *[F.col(held)[c].alias(c) for c in df.columns]), "buckets"), bucket, pos


def shard(df: DataFrame, n_shards: int, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows with their shard and slot."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    rows, bucket, pos = scatter(df, text, seed, bucket_bytes)
    n, start = fresh(rows, "n_", "start_")
    starts = rows.groupBy(bucket).agg(F.count("*").alias(n))  # MAX_BUCKETS rows at most
    starts = starts.select(bucket, (F.sum(n).over(Window.orderBy(bucket)) - F.col(n)).alias(start))
    dealt = rows.join(F.broadcast(starts), bucket).withColumn(start, F.col(start) + F.col(pos))
    return dealt.select(
        *df.columns,
        F.pmod(start, F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"`{start}` div {n_shards}").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as folders shard=k under path, every file in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
