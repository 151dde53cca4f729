"""The array and log sources."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import arrays


@pytest.fixture(autouse=True)
def known(spark):
    arrays.register(spark)


def rows_of(df):
    return [(r["row"], list(r["vector"])) for r in df.orderBy("row").collect()]


def test_files_in_ranges(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(57, 5)).astype(np.float32)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", other=x[:3], mine=x)
    np.savez_compressed(tmp_path / "c.npz", mine=x)
    read = lambda path, **o: spark.read.format("array").options(rows=10, **o).load(str(path))
    want = list(enumerate(x.tolist()))
    for df in (read(tmp_path / "a.npy"), read(tmp_path / "b.npz", array="mine"), read(tmp_path / "c.npz")):
        assert df.rdd.getNumPartitions() == 6 and rows_of(df) == want
    assert read(tmp_path / "a.npy").select("row").agg(F.sum("row")).first()[0] == 57 * 56 // 2
    with pytest.raises(Exception, match="name one of its arrays"):
        read(tmp_path / "b.npz").count()


def test_gate(spark, tmp_path):
    x = np.ones((30, 4), np.float32)
    x[17, 2] = np.nan
    np.save(tmp_path / "a.npy", x)
    read = lambda **o: spark.read.format("array").options(**o).load(str(tmp_path / "a.npy"))
    assert read(dim=4).count() == 30
    with pytest.raises(Exception, match="row 17"):
        read(finite=True).select("vector").collect()
    with pytest.raises(Exception, match="shape"):
        read(dim=3).count()


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select(F.array(F.col("id").cast("float"), (F.col("id") * 2).cast("float")).alias("v")).repartition(4)
    write = lambda d, mode: d.write.format("array").option("vector", "v").mode(mode).save(path)
    write(df, "append")
    read = lambda: sorted(v[0] for _, v in rows_of(spark.read.format("array").load(path)))
    assert read() == list(range(100))
    write(df.limit(3), "append")
    assert len(read()) == 103
    write(df.where("v[0] < 5"), "overwrite")
    assert read() == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="different lengths"):
        write(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<float>").coalesce(1), "append")
    assert read() == [0, 1, 2, 3, 4]


def test_growing_log(spark, tmp_path, monkeypatch):
    log = tmp_path / "a.log"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        s = spark.readStream.format("log").load(str(tmp_path / "*.log"))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return [r["line"] for r in spark.read.parquet(out).orderBy("file", "at").collect()]

    log.write_bytes(b"one\ntwo\nunfin")
    assert run() == ["one", "two"]
    with log.open("ab") as f:
        f.write(b"ished\nthree\n")
    (tmp_path / "b.log").write_bytes("é\n".encode() * 3)
    assert run() == ["one", "two", "unfinished", "three", "é", "é", "é"]


def test_pieces_of_a_log(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays.LogReader, "PIECE", 7)
    lines = [f"line {i}" * (i % 4) for i in range(50)]
    (tmp_path / "a.log").write_text("".join(x + "\n" for x in lines))
    r = arrays.LogReader({"path": str(tmp_path / "*.log")})
    assert [x[2] for p in r.partitions({}, r.latestOffset()) for x in r.read(p)] == lines


def test_bucketed_index(spark, tmp_path):
    """Joins by the key read the buckets as they lie; a failed or changed build leaves no half of a table."""
    from tessella.sources import stage

    src = tmp_path / "src.parquet"
    spark.range(500).write.parquet(str(src))
    rows = lambda n: spark.range(n).select(F.concat(F.lit("t"), F.col("id") % 50).alias("term"), F.col("id").alias("doc"))
    name = f"bucket-test-{uuid.uuid4().hex}"

    def broken():
        return rows(10).select(F.raise_error(F.lit("broken")).cast("string").alias("term"))

    with pytest.raises(Exception, match="broken"):
        stage.kept(spark, name, [str(src)], broken, bucket_by="term", buckets=8)
    index = stage.kept(spark, name, [str(src)], lambda: rows(500), bucket_by="term", buckets=8)
    assert index.count() == 500
    again = stage.kept(spark, name, [str(src)], broken, bucket_by="term", buckets=8)
    asked = spark.createDataFrame([("t7",), ("t9",)], "term string").hint("merge")
    joined = again.join(asked, "term")
    assert joined.count() == 20
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    few = again.where(F.col("term").isin("t7", "t9"))
    # only the files of two buckets are read
    assert few.count() == 20 and few.rdd.getNumPartitions() <= 2 < again.rdd.getNumPartitions()
    # the sources change: the build fails once, and the old table stays; then the new one takes its place
    spark.range(3).write.mode("append").parquet(str(src))
    with pytest.raises(Exception, match="broken"):
        stage.kept(spark, name, [str(src)], broken, bucket_by="term", buckets=8)
    assert again.count() == 500
    assert stage.kept(spark, name, [str(src)], lambda: rows(600), bucket_by="term", buckets=8).count() == 600
    folder = f"{stage.shared_dir(spark)}/tessella/{name}"
    (of,) = stage.folders_of(spark, folder)
    assert len(stage.folders_of(spark, f"{folder}/{of}")) == 1
