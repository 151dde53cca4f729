"""Event streams: windows under watermarks, late data, deduplication, sessions with custom state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stage import folders_of, shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """A stream over a folder of Parquet files; ts becomes a timestamp, as watermarks ask for one."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return sliding(events, size, size, delay)


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) for each window and type."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", size, step)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): events of a user without a longer gap."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


STATE = "n bigint, last_type string, last_seen timestamp"
SESSION_OUT = "user_id bigint, n bigint, last_type string, last_seen timestamp"


def _folder(timeout: bool):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, seen = state.get if state.exists else (0, "", pd.Timestamp(0))
        for b in batches:
            b = b.sort_values(["ts", "event_id"])
            n += len(b)
            if len(b) and b["ts"].iloc[-1] >= seen:
                last, seen = b["event_type"].iloc[-1], b["ts"].iloc[-1]
        if timeout and state.hasTimedOut:
            state.remove()
        else:
            state.update((int(n), last, seen))
            if timeout:
                state.setTimeoutDuration(6 * 3600 * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last], "last_seen": [seen]})

    return fold


def session_state(events: DataFrame, *, expire: bool = True) -> DataFrame:
    """The state of each user after every batch: events so far, the last type, when it was seen.

    State that is idle for six hours expires; a stream that ends with its input needs expire=False, as a timeout by
    the clock keeps it waiting.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return events.select("event_id", "ts", "user_id", "event_type").groupBy("user_id").applyInPandasWithState(_folder(expire), SESSION_OUT, STATE, "update", timeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows, held by the driver; for tests and small reports."""
    checkpoint = f"{shared_dir(stream.sparkSession)}/tessella/stream-{name}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over what is there now into Parquet files of the shared folder, and read them."""
    folder = f"{shared_dir(stream.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("epoch=")) for n in folders_of(spark, path) if n.startswith("epoch="))


def upsert_sink(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """The latest row of each key, by order and then by the other columns, as one Parquet version per batch.

    A version holds all keys so far: a batch is merged with the version before it, and a batch that is run again writes
    the same version again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch
        before = [v for v in _versions(batch.sparkSession, path) if v < epoch]
        if before:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/epoch={before[-1]}"))
        last = F.max(F.struct(order, *[c for c in batch.columns if c != order]))
        rows.groupBy(F.col(key).alias("__key")).agg(last.alias("__row")).select("__row.*").select(batch.columns).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that upsert_sink() has written."""
    return spark.read.parquet(f"{path}/epoch={_versions(spark, path)[-1]}")
