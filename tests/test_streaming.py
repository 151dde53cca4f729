import uuid

import pytest
from pyspark.sql import functions as F

from tessella.sources.tables import read_table
from tessella.streaming import events as EV


@pytest.fixture
def stream(spark, sf_dir):
    return spark.readStream.schema(EV.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_of_a_stream_equal_the_batch(spark, sf_dir, stream):
    batch = EV.tumbling(read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    got = EV.run_to_memory(EV.tumbling(stream), "w" + uuid.uuid4().hex, "complete")
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(batch)


def test_state_counts_every_event(spark, sf_dir, stream):
    got = EV.run_to_memory(EV.session_state(stream, expire=False), "s" + uuid.uuid4().hex, "update")
    want = {r["user_id"]: r["n"] for r in read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r["user_id"]: r["n"] for r in got.collect()} == want


def test_upsert_sink(spark, tmp_path):
    """Two batches with the same key: the latest row stays, and keys of the first batch too."""
    folder = str(tmp_path / "in")
    schema = "key long, ts long, v string"
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    for rows in ([(1, 5, "a"), (1, 9, "b"), (1, 2, "c"), (2, 1, "x")], [(3, 1, "y"), (1, 7, "late"), (2, 4, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        EV.upsert_sink(stream(), str(tmp_path / "out"), "key", "ts", str(tmp_path / "ck")).awaitTermination()
    assert sorted(tuple(r) for r in EV.read_latest(spark, str(tmp_path / "out")).collect()) == [(1, 9, "b"), (2, 4, "z"), (3, 1, "y")]


def test_late_rows_are_left_out(spark, tmp_path):
    """Rows behind the watermark of an earlier batch do not count again."""
    folder = str(tmp_path / "in")
    for day, ids in ((10, [1, 2]), (20, [3]), (1, [4])):
        spark.createDataFrame([(i, f"2024-01-{day:02d} 00:00:00", 1, "e", 1.0, "") for i in ids], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
        q = EV.tumbling(EV.read_events(spark, folder)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
