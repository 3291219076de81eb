"""Streaming ingestion: new files go through the same functions as a batch, once each."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session on this machine alone may do without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="siltstone-")


def ingest(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """Runs transform over the files of source that this checkpoint has not seen yet, appends to target and returns it.

    The file sink commits by batch, so a batch that runs again after a failure counts once."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def hourly_counts(events: DataFrame, at: str, kind: str, late: str = "1 hour") -> DataFrame:
    """hour, kind, n: events by hour; on a stream, events later than `late` behind the newest are left out."""
    d = events.withWatermark(at, late) if events.isStreaming else events
    return d.groupBy(F.window(at, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def rolling_failures(events: DataFrame, at: str, failed, every: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """until, failures: failed events of the hour up to each step of `every`; steps without any are absent."""
    d = events.withWatermark(at, late) if events.isStreaming else events
    return d.where(failed).groupBy(F.window(at, "1 hour", every).alias("w")).agg(F.count("*").alias("failures")).select(F.col("w.end").alias("until"), "failures")


def expired(tasks: DataFrame, now, lease: str = "lease_expires_at") -> DataFrame:
    """Running tasks whose lease is over."""
    return tasks.where((F.col("status") == "running") & (F.col(lease) <= now))


def expiries(claims: DataFrame, lease: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """task, expires_at of each lease that ran out: a claim that no later event of its task followed within the lease. claims:
    task, at, claims (does the event take the lease, or give it back?).

    A task's last open claim is its state, with a timer at the lease's end; the timer goes off when the stream's time has
    passed it, so a lease ends even if nothing more is heard of its task. Events later than `late` are left out."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    span = int(pd.Timedelta(lease) / pd.Timedelta(microseconds=1))

    def advance(key, batches, state):
        ended = []
        if state.hasTimedOut:
            ended.append(state.get[0])
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("us", kind="stable")
            ends = state.get[0] if state.exists else None
            for at, claims_it in zip(rows["us"].tolist(), rows["claims"].tolist()):
                if ends is not None and at > ends:
                    ended.append(ends)
                ends = at + span if claims_it else None
            if ends is None:
                if state.exists:
                    state.remove()
            else:
                state.update((ends,))
                state.setTimeoutTimestamp(max(ends // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task": pd.Series([key[0]] * len(ended), dtype="int64"), "us": pd.Series(ended, dtype="int64")})

    d = claims.select(F.col("task").cast("long").alias("task"), F.col("at").cast("timestamp").alias("at"), "claims").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    ended = d.groupBy("task").applyInPandasWithState(advance, "task long, us long", "ends long", "append", GroupStateTimeout.EventTimeTimeout)
    return ended.select("task", F.timestamp_micros("us").alias("expires_at"))
