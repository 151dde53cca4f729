"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Bins are ordered by residual capacity and carry one bitmap of sources and one of duplicate clusters. An item goes to the
tightest bin that holds it and shares neither bit with it; the successor search goes on until such a bin is found or
the bins end. Items are dealt by hash into shards of bounded size, so a source or cluster of any size spreads evenly and
every shard packs on its own, in the same way on every run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

#: Items of one shard: what one task holds at a time.
SHARD_ITEMS = 4096


def best_fit(lengths: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item, placed longest first, ties in the order given.

    sources and clusters are small numbers, or -1 for none; items with the same number never share a bin. Items longer
    than the capacity are refused.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    open_: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        if n > capacity:
            raise ValueError(f"an item of {n} is longer than {capacity}")
        s = 1 << sources[i] if sources[i] >= 0 else 0
        c = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(open_, (n, -1))
        while at < len(open_) and (source_bits[open_[at][1]] & s or cluster_bits[open_[at][1]] & c):
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        out[i] = (b, capacity - residual)
        source_bits[b] |= s
        cluster_bits[b] |= c
        if residual > n:
            insort(open_, (residual - n, b))
    return out


def _numbers(values: Iterable[object], repeated_only: bool) -> list[int]:
    """Small numbers for the values that need a bit; null needs none."""
    values = list(values)
    count: dict[object, int] = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    number: dict[object, int] = {}
    return [-1 if v is None or repeated_only and count[v] < 2 else number.setdefault(v, len(number)) for v in values]


def word_count(text: Column) -> Column:
    """Words: runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def pack(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    length: Column | None = None,
    cluster: Column | None = None,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """One row per segment: id, segment, start, length, bin, bin_offset.

    A document longer than the capacity is cut without loss: its full segments have a bin each and the rest is packed
    with the others. length defaults to the number of words, cluster to the hash of the text, so exact copies never
    share a bin; with source_col, neither do two documents of one source. An empty or null text is one segment of
    length 0, and takes up no room but obeys the constraints. Null sources and clusters conflict with nothing; repeated
    ids are items of their own; extra columns are ignored.
    """
    length = word_count(F.col(text_col)) if length is None else length
    # a null or empty text is no copy of another
    cluster = F.when(F.length(text_col) > 0, F.xxhash64(text_col)) if cluster is None else cluster
    source = F.xxhash64(source_col) if source_col else F.lit(None).cast("long")
    if source_col:
        source = F.when(F.col(source_col).isNotNull(), source)
    items = docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n"), source.alias("source"), cluster.cast("long").alias("cluster"))
    shards = max(1, ceil(docs.count() / shard_items))
    # twice hashed: the shard must not follow from the hash that deals rows to tasks
    items = items.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), F.col("id")), F.lit(shards)).cast("int"))
    id_type = dict(docs.dtypes)[id_col]
    numeric = isinstance(docs.schema[id_col].dataType, NumericType)

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["id"] is None, r["id"] or 0 if numeric else str(r["id"]), r["n"], str(r["source"]), str(r["cluster"])))
        rest = [r["n"] % capacity or min(r["n"], capacity) for r in rows]
        placed = best_fit(rest, _numbers((r["source"] for r in rows), False), _numbers((r["cluster"] for r in rows), True), capacity)
        out: dict[str, list] = {k: [] for k in ("id", "segment", "start", "length", "shard", "bin", "bin_offset")}
        bins = max((b for b, _ in placed), default=-1) + 1
        for r, n, (b, offset) in zip(rows, rest, placed, strict=True):
            full = (r["n"] - n) // capacity
            for k in range(full + 1):
                last = k == full
                values = (r["id"], k, k * capacity, n if last else capacity, r["shard"], b if last else bins, offset if last else 0)
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
                bins += not last
        return pa.table(out, schema=schema)

    schema = pa.schema([("id", to_arrow_type(docs.schema[id_col].dataType)), ("segment", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("shard", pa.int32()), ("bin", pa.int64()), ("bin_offset", pa.int64())])
    packed = items.groupBy("shard").applyInArrow(work, f"id {id_type}, segment int, start long, length long, shard int, bin long, bin_offset long")
    name = F.concat_ws("-", "shard", "bin")
    return packed.select(F.col("id").alias(id_col), "segment", "start", "length", name.alias("bin"), "bin_offset")
