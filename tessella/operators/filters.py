"""Structured filters compiled to columns, so that they reach the scan, and the relaxation cascade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..sources.stage import written

HARD_KEYS = ("product_type", "colour_group", "graphical_appearance")
ALLOWED_KEYS = ("product_type", "colour_group", "graphical_appearance", "occasion", "seasonality")
Values = str | Sequence[str]


def _values(v: Values | None) -> list[str]:
    return [x for x in ([v] if isinstance(v, str) else list(v or [])) if x]


def compile_filters(must: Mapping[str, Values], must_not: Mapping[str, Values], columns: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """AND over keys; a list means any of its values; an aliased key is OR over its columns; blank values are ignored.

    A key without a column fails every row if it is required, and excludes none if it is forbidden.
    """
    aliases = aliases or {}
    have = set(columns)

    def any_of(key: str, values: list[str]) -> Column:
        tests = [F.coalesce(F.col(c), F.lit("")).isin(*values) for c in aliases.get(key, (key,)) if c in have]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    out = F.lit(True)
    for key, v in must.items():
        if values := _values(v):
            out = out & any_of(key, values)
    for key, v in must_not.items():
        if values := _values(v):
            out = out & ~any_of(key, values)
    return out


def post_filter(must: Mapping[str, str], must_not: Mapping[str, Values], aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Equality of normalised text on the first non-blank alias; forbidden values do not touch blank ones."""
    aliases = aliases or {}

    def value(key: str) -> Column:
        return normalize_text(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in aliases.get(key, (key,))]))

    out = F.lit(True)
    for key, v in must.items():
        if v and v.strip():
            out = out & (value(key) == normalize_text(F.lit(v)))
    for key, v in must_not.items():
        for x in _values(v):
            out = out & ~((value(key) != "") & (value(key) == normalize_text(F.lit(x))))
    return out


def only_keys(filters: Column, keys: Sequence[str] = HARD_KEYS) -> Column:
    """A map of filters with none but the given keys and no blank value."""
    return F.map_filter(filters, lambda k, v: k.isin(*keys) & (F.coalesce(v, F.lit("")) != ""))


def drop_contradictions(must_not: Column, must: Column) -> Column:
    """A forbidden key goes where the same key is asked for."""
    return F.map_filter(must_not, lambda k, v: ~F.array_contains(F.map_keys(must), k))


def unless_empty(rows: DataFrame, keep: Column, by: str | None = None) -> DataFrame:
    """The rows that pass, or all of a group's rows where none does."""
    if by:
        return rows.withColumn("__n", F.count_if(keep).over(Window.partitionBy(by))).where(keep | (F.col("__n") == 0)).drop("__n")
    n = rows.agg(F.count_if(keep).alias("__n"))
    return rows.crossJoin(F.broadcast(n)).where(keep | (F.col("__n") == 0)).drop("__n")


def first_values(filters: Column) -> Column:
    """A map of lists as one of single values: the first that is not blank; keys without one go."""
    first = F.transform_values(filters, lambda k, v: F.get(all_non_blank(v), F.lit(0)))
    return F.map_filter(first, lambda k, v: v.isNotNull())


def all_non_blank(values: Column) -> Column:
    """The values of a list that are not blank, trimmed, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def cascade(asked: DataFrame, items: DataFrame, tiers: Sequence[tuple[Sequence[str], Column]], limit: int, *, by: str = "query", item: str = "id", score: str = "score") -> DataFrame:
    """(by, item, score, tier, rank): the limit best items of the first tier that has any for a query; a query is not its own hit.

    A tier is (columns in which item and query agree, a test of the item). Of each combination of the columns only the
    limit + 1 best items meet a query, and only queries that the tiers before have left go to the next.
    """
    out, rest = None, asked
    for number, (keys, test) in enumerate(tiers, 1):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), item))
        top = items.where(test).withColumn("__r", place).where(F.col("__r") <= limit + 1).select(*keys, item, score)
        found = rest.select(by, *keys).join(top, list(keys)).where(F.col(by) != F.col(item))
        order = Window.partitionBy(by).orderBy(F.desc(score), item)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        found = written(found.select(by, item, score, F.lit(number).alias("tier"), "rank"), "tier")
        rest = rest.join(found.select(by).distinct(), by, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def relax(candidates: DataFrame, tiers: Sequence[Column], limit: int, *, by: str = "query", item: str = "id") -> DataFrame:
    """The tightest tier that holds any candidate of a query, ranked within that tier; tier counts from 1.

    Candidates have (query, id, score). All tiers are tested in one pass, and a tier's rows are ranked on their own.
    """
    tests = F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tiers, 1)])
    rows = candidates.withColumn("tier", F.explode(F.array_compact(tests)))
    least = F.min("tier").over(Window.partitionBy(by))
    best = rows.withColumn("least", least).where("tier = least").drop("least")
    order = Window.partitionBy(by).orderBy(F.desc("score"), item)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
