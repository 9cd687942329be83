"""Streams of messages: expiry, replay protection, conversation states, snapshots, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Which conversation transitions may follow a state.
ALLOWED = {
    "NEW": ["PROPOSE", "ERROR"],
    "PROPOSE": ["COUNTER", "ACCEPT", "REFUSE", "ESCALATE", "CANCEL", "EXPIRE", "ERROR"],
    "COUNTER": ["COUNTER", "ACCEPT", "REFUSE", "ESCALATE", "CANCEL", "EXPIRE", "ERROR"],
    "ESCALATE": ["ACCEPT", "REFUSE", "CANCEL", "EXPIRE", "ERROR"],
    "ACCEPT": ["EXECUTE", "CANCEL", "EXPIRE", "ERROR"],
    "EXECUTE": ["CONFIRM", "ERROR", "EXPIRE"],
    "CONFIRM": [],
    "REFUSE": [],
    "CANCEL": [],
    "EXPIRE": [],
    "ERROR": [],
}
FINAL = [s for s, nxt in ALLOWED.items() if not nxt]


def as_event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need timestamps with a zone; Parquet may give them without."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def admit(messages: DataFrame, received: str = "received_at") -> DataFrame:
    """Adds ``admission``: ADMIT, EXPIRED (quarantine), or AUDIT_ONLY for acts of closing that come
    late: these are logged and never acted on.  The stricter of deadline and expiry holds."""
    limit = F.least(F.coalesce("deadline", "expires_at"), F.coalesce("expires_at", "deadline"))
    late = limit.isNotNull() & (F.col(received) > limit)
    closing = F.col("act").isin("ACCEPT", "CONFIRM")
    return messages.withColumn("admission", F.when(late & closing, "AUDIT_ONLY").when(late, "EXPIRED").otherwise("ADMIT"))


def without_replays(messages: DataFrame, at: str = "created_at", window: str = "10 minutes") -> DataFrame:
    """Drops a nonce that its sender used before within the window."""
    return messages.withWatermark(at, window).dropDuplicatesWithinWatermark(["sender", "nonce"])


def conversation_states(messages: DataFrame, timeout: str = "30 minutes") -> DataFrame:
    """State of each thread after each message: thread_id, message_id, transition, state, legal.  An
    illegal transition ends in ERROR; silence beyond the timeout gives EXPIRE."""
    out = "thread_id string, message_id string, transition string, state string, legal boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "NEW"
        if state.hasTimedOut:
            state.remove()
            if now not in FINAL:
                yield pd.DataFrame([(key[0], None, "EXPIRE", "EXPIRE", True)], columns=["thread_id", "message_id", "transition", "state", "legal"])
            return
        rows = []
        for pdf in batches:
            for m in pdf.sort_values(["created_at", "message_id"]).itertuples():
                legal = m.transition in ALLOWED[now]
                now = m.transition if legal else now if now in FINAL else "ERROR"
                rows.append((key[0], m.message_id, m.transition, now, legal))
        state.update((now,))
        if now not in FINAL:
            state.setTimeoutDuration(timeout)
        yield pd.DataFrame(rows, columns=["thread_id", "message_id", "transition", "state", "legal"])

    return messages.select("thread_id", "message_id", "transition", "created_at").groupBy("thread_id").applyInPandasWithState(step, out, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key, late rows within the watermark included."""
    return as_event_time(events, at).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def discovery_counts(pairs: DataFrame, propose: int = 5, promote: int = 10) -> DataFrame:
    """Running counts of observed pairs (left, right), flagged as proposed and promoted."""
    n = pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= propose).withColumn("promoted", F.col("n") >= promote)


def snapshot_sink(path: str, keys: list[str], at: str):
    """A foreachBatch function: last value per key, written as a new version beside the old; the
    pointer is the newest complete version."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        from claimloom.operators.claims import upsert as merge

        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        old = [v for v in done if v < epoch]
        rows = merge(spark.read.schema(batch.schema).parquet(f"{path}/v={max(old)}"), batch, keys, at) if old else merge(batch.limit(0), batch, keys, at)
        rows.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return upsert


def against_current(path: str, keys: list[str], out: str):
    """A foreachBatch function: each batch meets a table as it is at that time, which other jobs may
    replace meanwhile; a repeated batch writes over its own results."""

    def step(batch: DataFrame, epoch: int) -> None:
        table = batch.sparkSession.read.parquet(path)  # read anew for every batch
        batch.join(table, keys, "left").write.mode("overwrite").parquet(f"{out}/v={epoch}")

    return step
