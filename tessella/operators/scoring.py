"""Pair scores whose parameters are tables: masks of type pairs, relations of slot pairs, vectors of aspect values.

A parameter is looked up once for each distinct pair of kinds that the rows have; where the table has none, a default
stands. What is derived from it, as a mask's gate, is worked out there too, and rows then meet that small table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def _zeros(like: Column) -> Column:
    return F.transform(like, lambda x: F.lit(0.0))


def kind_pairs(rows: DataFrame, a: str, b: str, *, ordered: bool) -> DataFrame:
    """(kind_a, kind_b): the distinct pairs of kinds of the rows; unordered pairs have the lesser kind first."""
    x, y = F.col(a), F.col(b)
    return rows.select((x if ordered else F.least(x, y)).alias("kind_a"), (y if ordered else F.greatest(x, y)).alias("kind_b")).distinct()


def _with_parameters(rows: DataFrame, table: DataFrame, column: str, a: str, b: str, *, ordered: bool, derive=lambda c: c) -> DataFrame:
    """rows with column (null where the table has no row for the pair of kinds)."""
    known = kind_pairs(rows, a, b, ordered=ordered).join(table.select("kind_a", "kind_b", column), ["kind_a", "kind_b"], "left").withColumn(column, derive(F.col(column)))
    x, y = F.col(a), F.col(b)
    keyed = rows.withColumn("kind_a", x if ordered else F.least(x, y)).withColumn("kind_b", y if ordered else F.greatest(x, y))
    return keyed.join(known, ["kind_a", "kind_b"], "left").drop("kind_a", "kind_b")


def masked(rows: DataFrame, masks: DataFrame, *, name: str = "masked") -> DataFrame:
    """rows (kind of a: ka, of b: kb, vectors va, vb) with the score in the subspace of their unordered pair of kinds.

    masks is (kind_a, kind_b, mask), kind_a the lesser. A pair without a mask has one of zeros: every gate is a half.
    """
    gate = lambda m: F.transform(m, lambda x: 1 / (1 + F.exp(-x)))
    x = _with_parameters(rows, masks, "mask", "ka", "kb", ordered=False, derive=gate)
    half = F.transform("va", lambda v: F.lit(0.5))
    return x.withColumn(name, V.dot(F.zip_with("va", "vb", lambda p, q: p * q), F.coalesce("mask", half))).drop("mask")


def translated(rows: DataFrame, relations: DataFrame, *, name: str = "translated") -> DataFrame:
    """rows (ka, kb, va, vb) with minus the squared distance of va + relation to vb; a pair without a relation has none to add.

    relations is (kind_a, kind_b, relation) of ordered pairs.
    """
    x = _with_parameters(rows, relations, "relation", "ka", "kb", ordered=True)
    return x.withColumn(name, V.translation_score(F.col("va"), F.col("vb"), F.coalesce("relation", _zeros(F.col("va"))))).drop("relation")


def aspect_affinities(rows: DataFrame, aspects: DataFrame, values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows with a column affinity_<aspect> for each aspect: the cosine of the vectors of both sides' values.

    aspects is (aspect, value, vector); values names the two columns of rows that hold an aspect's values. Each distinct
    pair of values is worked out once; a value without a vector gives 0.
    """
    for name, (a, b) in values.items():
        known = aspects.where(F.col("aspect") == name).select("value", V.l2_normalize(F.col("vector")).alias("u"))
        pairs = kind_pairs(rows, a, b, ordered=False)
        left, right = known.select(F.col("value").alias("kind_a"), F.col("u").alias("ua")), known.select(F.col("value").alias("kind_b"), F.col("u").alias("ub"))
        worked = pairs.join(left, "kind_a").join(right, "kind_b").select("kind_a", "kind_b", V.dot(F.col("ua"), F.col("ub")).alias(f"affinity_{name}"))
        keyed = rows.withColumn("kind_a", F.least(a, b)).withColumn("kind_b", F.greatest(a, b))
        rows = keyed.join(worked, ["kind_a", "kind_b"], "left").drop("kind_a", "kind_b").fillna(0.0, [f"affinity_{name}"])
    return rows


def aspect_score(rows: DataFrame, weights: Mapping[str, float], *, residual: str = "residual", name: str = "aspects") -> DataFrame:
    """rows with the weighted sum of the residual and of affinity_<aspect>; weights go through softplus, so none is negative."""
    soft = {k: F.log1p(F.exp(F.lit(float(w)))) for k, w in weights.items()}
    total = F.col(residual) * soft["residual"]
    for k, w in soft.items():
        if k != "residual":
            total = total + F.col(f"affinity_{k}") * w
    return rows.withColumn(name, total)
