"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join; the number of steps grows with the logarithm of the component size,
and each step's links are written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Links (u, v) with u > v, rewired to each neighbourhood's least node."""
    if small:
        sides = links.select("u", "v")
    else:
        sides = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("x"), "m")
    return out.where(F.col("x") != F.col("m")).select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (two columns of ids, any order, self-links and repeats allowed).

    A component is named by its least node. Nodes without a link to another are not listed; null ends are ignored.
    """
    a, b = links.columns
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(mark) == seen:
            break
        seen = tuple(mark)
        if not seen[0]:
            break
        now = materialize(_stars(_stars(now, small=False), small=True), "links")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
