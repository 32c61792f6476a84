"""Running streams to their end and reading what they gave; the streams themselves."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basaltine.session import new_folder


def source(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A driver's table as a file stream; a single file or a folder of files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


#: State that is kept in files beside memory. Its rows aren't counted, which would read the old value of each that is written.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Closing:
    """A stream with an end: once all input is read, one more row far ahead in time moves the watermark over all that is open.

    rows: the stream and that row's own source in one; the row has only a time, its other columns are null.
    """

    def __init__(self, stream: DataFrame, at: str):
        self.spark, self.at = stream.sparkSession, at
        self.folder = new_folder(self.spark, "stream-end")
        self.spark.createDataFrame([], stream.schema).write.parquet(self.folder)
        last = self.spark.readStream.schema(stream.schema).parquet(self.folder)
        self.rows = stream.unionByName(last)

    def close(self, when: str = "9000-01-01") -> None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.rows.schema if f.name != self.at]
        row = self.spark.range(1).select(*empty, F.lit(when).cast("timestamp").alias(self.at))
        row.select(*self.rows.columns).write.mode("append").parquet(self.folder)


def finished(stream: DataFrame, mode: str, closing: Closing | None = None) -> DataFrame:
    """What a stream gives once all its input is read.

    append: all rows; with closing also those that wait for the watermark, from a second run on the same state. complete: those
    of the last batch. update: all rows with their batch number, to pick the last. Batches are written by foreachBatch under
    their number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    out, kept, schema = new_folder(spark, "stream-out"), new_folder(spark, "stream-state"), stream.schema

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    def run() -> bool:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", kept).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
        return query.lastProgress is not None

    some = run()
    if closing is not None:
        closing.close()
        some = run() or some
    if not some:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
    return rows.drop("batch") if mode == "append" else rows


#: The states of a scan that nothing changes any more, as the event types that stand for them.
TERMINAL = {"purchase": "COMPLETED", "error": "FAILED", "signup": "CANCELLED"}
STATES = "user_id long, state string, since_us long, n long"


def scan_states(events: DataFrame) -> DataFrame:
    """Per key the state after its events: the first terminal one stays, else running or pending."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, name, n = state.get if state.exists else (None, "PENDING", 0)
        done = name in TERMINAL.values()
        for b in batches:
            n += len(b)
            ends = b[b.event_type.isin(TERMINAL)]
            if len(ends):
                first = ends.sort_values(["us", "event_id"]).iloc[0]
                if not done or first.us < at:
                    at, name, done = int(first.us), TERMINAL[first.event_type], True
            elif not done and (b.event_type == "click").any():
                name, at = "RUNNING", int(b.us.min())
        state.update((at, name, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [name], "since_us": [at], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, STATES, "at long, name string, n long", "update", GroupStateTimeout.NoTimeout
    )


def allowed(times: list[int], recent: list[int], window: int, limit: int) -> tuple[list[bool], list[int]]:
    """Which calls a sliding-window limiter lets through, and the calls it remembers. Denied calls are not remembered."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r <= window]
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


#: Fixed value: milliseconds after which a limiter forgets a key that makes no calls.
IDLE_MS = 3_600_000


def rate_limited(events: DataFrame, window_us: int, limit: int, idle_ms: int | None = None) -> DataFrame:
    """(user_id, event_id, allowed) of a limiter for each key; the state holds at most `limit` times.

    With idle_ms a key without calls for so long is swept from the state; that is for streams without an end, since
    the sweep itself keeps a stream going.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        b = pd.concat(list(batches), ignore_index=True).sort_values(["us", "event_id"])  # all of a key's calls in time's order
        ok, recent = allowed(b.us.tolist(), recent, window_us, limit)
        yield pd.DataFrame({"user_id": key[0], "event_id": b.event_id.to_numpy(), "allowed": ok})
        state.update((recent,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, allowed boolean", "recent array<long>", "append", timeout
    )


MESSAGES = "user_id long, seq long, kind string, body string"


def scan_messages(events: DataFrame, statuses: bool = True) -> DataFrame:
    """(user_id, seq, kind, body): what a listener of a scan is told. Each batch tells the status, then the lines that are new;
    the first terminal event tells the end, and nothing follows it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, done = state.get if state.exists else (0, False)
        rows = []
        if not done:
            b = pd.concat(list(batches), ignore_index=True).sort_values(["us", "event_id"])
            if statuses:
                ends = [TERMINAL[t] for t in b.event_type if t in TERMINAL]
                rows.append((key[0], seq, "status", ends[0] if ends else "RUNNING"))
                seq += 1
            for event, kind in zip(b.event_id.tolist(), b.event_type.tolist()):
                rows.append((key[0], seq, "log", str(event)))
                seq += 1
                if kind in TERMINAL:
                    rows.append((key[0], seq, "done", TERMINAL[kind]))
                    seq, done = seq + 1, True
                    break
        state.update((seq, done))
        yield pd.DataFrame(rows, columns=["user_id", "seq", "kind", "body"])

    return events.groupBy("user_id").applyInPandasWithState(step, MESSAGES, "seq long, done boolean", "append", GroupStateTimeout.NoTimeout)


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """(user_id, done, total, percent): files that are done against all of a scan's, 100 at most. done may be a stream."""
    n = done.groupBy("user_id").agg(F.count("*").alias("done"))
    percent = F.least(F.lit(100.0), F.bround(F.lit(100.0) * F.col("done") / F.col("total"), 1))
    return n.join(totals, "user_id").select("user_id", "done", "total", percent.alias("percent"))


def accepted(requests: DataFrame, revocations: DataFrame) -> DataFrame:
    """requests (token, at, ...) whose token isn't revoked: revocations (token, expires_at) hold until they expire."""
    r = revocations.select(F.col("token").alias("r_token"), "expires_at")
    return requests.join(r, (F.col("token") == F.col("r_token")) & (F.col("expires_at") > F.col("at")), "left_anti")


def stalls(events: DataFrame, idle_ms: int) -> DataFrame:
    """(user_id, start_ms, last_ms, n): runs of a key's events that nothing followed for longer than idle_ms, told once the watermark has passed that time.

    events has a watermark on at. A run is a session that an event keeps open for idle_ms, to the last microsecond of a millisecond.
    Copies of an event (event_id, user_id and millisecond) count once in it. Rows that come when the watermark has passed their time and
    idle_ms are dropped, so the state of a key is what the watermark and idle_ms leave open; with ROCKS it is in files.
    """
    left = (F.lit(idle_ms * 1000 + 999) - F.pmod(F.unix_micros("at"), F.lit(1000))) / 1_000_000  # sessions that touch are one
    over = F.make_interval(secs=left.cast("decimal(18,6)"))
    rows = events.select("user_id", "event_id", "at", F.unix_millis("at").alias("ms"))
    runs = rows.groupBy(F.session_window("at", over), "user_id").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("last_ms"), F.size(F.collect_set(F.struct("event_id", "ms"))).cast("long").alias("n")
    )
    return runs.select("user_id", "start_ms", "last_ms", "n")
