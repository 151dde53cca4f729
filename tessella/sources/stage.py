"""Tables that a job writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset and Spark runs in one process, a folder of this machine serves; on a cluster that is an error,
    since executors could not see each other's files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this process has written for itself; it goes when the process ends.
_mine: list[str] = []


@atexit.register
def _clean() -> None:
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    for path in _mine if jvm is not None else ():
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except Exception:  # the JVM has gone first; the folder's owner cleans up
            return


def written(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: it cuts lineage, and survives the loss of executors.

    partition_by names a column that gets a folder for each of its values, so that a filter on it reads no others. The
    files go when the process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    _mine.append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of a file or of the files of a folder: what a stale copy is told by."""
    fs, at = _fs(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it is missing."""
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write() fill a folder aside and rename it to path: path is whole or not there, and a failed build leaves it as it was.

    Of two builders at once the first to be done wins.
    """
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return
    aside = f"{path.rpartition('/')[0]}/_building-{uuid.uuid4().hex}"
    _, there = _fs(spark, aside)
    try:
        write(aside)
        if not fs.exists(at) and not fs.rename(there, at) and not fs.exists(at):
            raise OSError(f"{aside} could not be renamed to {path}")
    finally:
        if fs.exists(there):
            fs.delete(there, True)


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], *, version: int = 1, bucket_by: str | None = None, buckets: int = 64) -> DataFrame:
    """The table built from source files: built once for the state that they are in, and again when one changes.

    version counts the ways in which the table has been built; a new one is no old one's copy. With bucket_by the files
    are buckets of that column's hash, sorted by it: a join or an aggregation by it reads them without a shuffle, and a
    filter on some of its values reads their buckets only. Tables of the sources' earlier states go once a new one is
    there.
    """
    from .tables import signature

    state = {p: files_of(spark, p) for p in sources}
    bucketed = {"by": bucket_by, "buckets": buckets} if bucket_by else {}
    folder = f"{shared_dir(spark)}/tessella/{name}/of={signature({'sources': sorted(sources), 'version': version, **bucketed})}"
    table = f"kept_{signature({'folder': folder, 'state': state})}"
    path = f"{folder}/sig={signature(state)}"

    def write(aside: str) -> None:
        rows = build()
        if not bucket_by:
            rows.write.parquet(aside)
            return
        # one file for each bucket
        dealt = rows.repartition(buckets, bucket_by).write.bucketBy(buckets, bucket_by).sortBy(bucket_by)
        building = f"building_{uuid.uuid4().hex}"
        try:
            dealt.format("parquet").option("path", aside).saveAsTable(building)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {building}")

    publish(spark, path, write)
    fs, _ = _fs(spark, folder)
    for old in folders_of(spark, folder):
        if old.startswith("sig=") and not path.endswith(f"/{old}"):
            fs.delete(_fs(spark, f"{folder}/{old}")[1], True)
    if not bucket_by:
        return spark.read.parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({bucket_by}) SORTED BY ({bucket_by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    # the files may have been built anew since the session saw them
    spark.catalog.refreshTable(table)
    return spark.table(table)


def forget(spark: SparkSession, name: str) -> None:
    """Delete all kept tables of the name."""
    fs, at = _fs(spark, f"{shared_dir(spark)}/tessella/{name}")
    fs.delete(at, True)
