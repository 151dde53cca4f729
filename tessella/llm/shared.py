"""Storage that every executor can reach, and small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import written as materialize

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def id_hash(c: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the same folds in any engine."""
    return (F.crc32(c.cast("string").cast("binary")) % modulus).cast("int")


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more; Spark learns of them by collections."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of an IdFilter for each id, and its least and largest sizes: 1 and 16 MB. With more ids than fit, more rows pass.
BITS_PER_ID, MIN_FILTER_BITS, MAX_FILTER_BITS = 64, 1 << 23, 1 << 27


class IdFilter:
    """A one-hash Bloom filter of ids, of bounded size, that saves rows without a partner the way through a shuffle.

    It never rejects an id that was put in; the join behind it stays exact. It reaches the rows as a scalar subquery.
    """

    def __init__(self, ids: DataFrame):
        (name,) = ids.columns
        spark = ids.sparkSession
        self.bits = MIN_FILTER_BITS
        n = ids.count()
        while self.bits < min(n * BITS_PER_ID, MAX_FILTER_BITS):
            self.bits *= 2
        at = ids.where(F.col(name).isNotNull()).select(self._slot(F.col(name)).alias("p"))
        some = at.select(F.call_function("shiftright", "p", F.lit(6)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
        some = some.groupBy("w").agg(F.bit_or("m").alias("m"))
        none = spark.range(self.bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("m"))
        words = some.unionByName(none).groupBy("w").agg(F.bit_or("m").alias("m"))
        one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("words"))
        self.words = materialize(one, "id-filter")

    def _slot(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.bits))

    def accepts(self, id_: Column) -> Column:
        slot = self._slot(id_)
        word = F.get(self.words.scalar(), F.call_function("shiftright", slot, F.lit(6)).cast("int"))
        bit = F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return F.coalesce(id_.isNotNull() & (bit == 1), F.lit(False))

    def split(self, docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose id the filter accepts, the others)."""
        hit = self.accepts(F.col(id_col))
        return docs.where(hit), docs.where(~hit)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in gone (one column id_col); only rows that the filter accepts are shuffled."""
    maybe, rest = IdFilter(gone).split(docs, id_col)
    return rest.unionByName(maybe.join(gone, id_col, "left_anti").select(docs.columns))
