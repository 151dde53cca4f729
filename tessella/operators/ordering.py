"""Places and running sums in an order over all rows, in two passes, so that no task sees more than its range.

Rows are dealt into ranges of the order, sorted within them and written with their range and their place in it. The
ranges' sizes or sums are few rows; what lies before a range is added to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import written

#: monotonically_increasing_id() has the partition above this bit and the row below it.
_ROW_BITS = 33
_RANGE, _PLACE = "__range", "__place"


def _dealt(rows: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """rows with their range and their place in it, written once: a range keeps its rows whatever is computed again."""
    keys = [F.col(c) for c in (*by, *order)]
    row = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(sorted_.withColumn(_RANGE, F.shiftright(row, _ROW_BITS).cast("int")).withColumn(_PLACE, row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), "ordered")


def _before(per: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """per (range, by, value) with the sum of value over the earlier ranges of the same group as before."""
    if by:
        earlier = F.sum(value).over(Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
        return per.withColumn("__before", F.coalesce(earlier, F.lit(0)))
    # one row for each range: they meet as one array, and no task sorts them
    others = [c for c in per.columns if c not in (_RANGE, value)]
    whole = per.agg(F.array_sort(F.collect_list(F.struct(_RANGE, value, *others))).alias("a"))
    kind = dict(per.dtypes)[value]
    upto = F.transform("a", lambda x, i: F.struct(x[_RANGE].alias(_RANGE), *[x[c].alias(c) for c in others], F.aggregate(F.slice("a", 1, i), F.lit(0).cast(kind), lambda s, y: s + y[value]).alias("__before")))
    return whole.select(F.explode(upto).alias("x")).select("x.*")


def _joined(rows: DataFrame, per: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return rows.join(F.broadcast(per), _RANGE)  # a row for each range
    other = per.select(F.col(_RANGE).alias("__r"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[c for c in per.columns if c not in (_RANGE, *by)])
    same: Column = F.col(_RANGE) == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return rows.join(other, same).drop("__r", *[f"__by{i}" for i in range(len(by))])


def numbered(rows: DataFrame, order: Sequence[str], *, by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """rows with their number from 0 in the order of some columns, within each group of by; nulls come first.

    Rows that agree in all of them are numbered in some order.
    """
    dealt = _dealt(rows, order, by)
    per = dealt.groupBy(_RANGE, *by).agg(F.min(_PLACE).alias("__first"), F.count("*").alias("__n"))
    place = F.col(_PLACE) - F.col("__first") + F.col("__before")
    return _joined(dealt, _before(per, "__n", by), by).select(*rows.columns, place.cast("long").alias(name))


def running_total(rows: DataFrame, value: str, order: Sequence[str], *, by: Sequence[str] = (), name: str = "upto") -> DataFrame:
    """rows with the sum of value over all rows up to and with this one in the order, within each group of by."""
    dealt = _dealt(rows, order, by)
    own = F.sum(value).over(Window.partitionBy(_RANGE, *by).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0))
    per = dealt.groupBy(_RANGE, *by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__n"))
    return _joined(dealt.withColumn("__own", own), _before(per, "__n", by), by).select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))
