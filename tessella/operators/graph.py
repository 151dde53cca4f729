"""Item graphs from baskets: co-purchase counts, NPMI, two-hop walks, neighbours under caps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS
from ..sources.stage import written
from . import ordering
from .rules import season_clash

MIN_BASKET, MAX_BASKET = 2, 10


def baskets(lines: DataFrame, customer: str, day: str, item: str, *, least: int = MIN_BASKET, most: int = MAX_BASKET) -> DataFrame:
    """(customer, day, items): distinct items of a customer and day, ascending, if there are least to most of them.

    Sizes are checked on counts first, so that no oversized basket is ever collected. All takes one shuffle by the basket.
    """
    each = lines.select(F.col(customer).alias("customer"), F.col(day).alias("day"), F.col(item).alias("item")).where("customer IS NOT NULL AND day IS NOT NULL AND item IS NOT NULL")
    sized = each.repartition("customer", "day").distinct().withColumn("n", F.count("*").over(Window.partitionBy("customer", "day")))
    return sized.where(F.col("n").between(least, most)).groupBy("customer", "day").agg(F.sort_array(F.collect_list("item")).alias("items"))


def item_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def pair_counts(found: DataFrame) -> DataFrame:
    """(item_a, item_b, n) with item_a < item_b; a basket of at most MAX_BASKET items makes its pairs in place."""
    pairs = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: F.struct(a.alias("item_a"), b.alias("item_b")))))
    return found.select(F.explode(pairs).alias("p")).groupBy("p.item_a", "p.item_b").agg(F.count("*").alias("n"))


def npmi(n_ab: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """Normalised pointwise mutual information; -1 where a count is not positive, 1 where the pair is everywhere."""
    p, a, b = (x.cast("double") / total for x in (n_ab, n_a, n_b))
    value = F.when(p >= 1, 1.0).otherwise(F.log(p / (a * b)) / -F.log(p))
    return F.when((n_ab <= 0) | (n_a <= 0) | (n_b <= 0) | (total <= 0), -1.0).otherwise(value)


def edges(found: DataFrame, *, method: str = "npmi", min_count: int = 3, threshold: float = 0.0, scale: float = 1000.0) -> DataFrame:
    """(item_a, item_b, n, weight): counts, or NPMI of at least the threshold times scale."""
    if method != "cobuy":
        # read three times
        found = written(found, "baskets")
    pairs = pair_counts(found).where(F.col("n") >= min_count)
    if method == "cobuy":
        return pairs.withColumn("weight", F.col("n").cast("double"))
    items = item_counts(found)
    total = found.agg(F.count("*").alias("total"))
    joined = pairs.join(items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
    joined = joined.join(items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b").crossJoin(F.broadcast(total))
    value = F.round(npmi(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("total")), 9)
    return joined.withColumn("value", value).where(F.col("value") >= threshold).select("item_a", "item_b", "n", (F.col("value") * scale).alias("weight"))


def both_ways(found: DataFrame) -> DataFrame:
    """Each edge from either end; what makes the edges runs once."""
    ends = [F.struct(F.col(a).alias("item_a"), F.col(b).alias("item_b"), "weight") for a, b in (("item_a", "item_b"), ("item_b", "item_a"))]
    return found.select(F.explode(F.array(*ends)).alias("e")).select("e.*")


def undirected_max(found: DataFrame) -> DataFrame:
    """One edge per unordered pair, with the largest weight."""
    return found.groupBy(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b")).agg(F.max("weight").alias("weight"))


def adjacency(found: DataFrame, *, positive_only: bool = False) -> DataFrame:
    """Both directions with the largest weight; weights of 0 or less go if asked."""
    out = both_ways(undirected_max(found))
    return out.where("weight > 0") if positive_only else out


#: Items of a user that one side of a cell of the product holds, about.
CELL = 1024


def walk_sides(ui: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Both sides (u, x, y, item_a or item_b, nu) of the product of every user's items with themselves.

    A user of nu items has s * s cells, s = ceil(nu / cell): an item's row goes to all cells of its line on the left side,
    and of its column on the right, so that any two items of a user meet in one cell, and a cell has about cell rows a
    side. Users of up to cell items have one.
    """
    per = ui.groupBy("u").agg(F.count("*").alias("nu"))
    rows = ui.join(per, "u").withColumn("s", F.ceil(F.col("nu") / cell).cast("int"))
    own, every = F.pmod(F.xxhash64("i"), F.col("s")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    left = rows.select("u", own.alias("x"), every.alias("y"), F.col("i").alias("item_a"), "nu")
    return left, rows.select("u", every.alias("x"), own.alias("y"), F.col("i").alias("item_b"))


#: Items in the users' lists that meet in one task of the walk, about; pairs that it holds at once; and counters by which items of many are told.
ENTRIES, CHUNK, COUNTERS = 8 << 20, 2 << 20, 1 << 14


def p3alpha(lines: DataFrame, user: str, item: str, *, top: int = 50, max_user_items: int | None = None, scale: float = 1000.0, places: int = 9, cell: int = CELL) -> DataFrame:
    """Two steps of a random walk item -> user -> item: the top neighbours of each item, undirected, by the larger weight.

    Steps are row-normalised over distinct (user, item) rows. Items are cut into blocks by ranges, and the lists of the
    users who have one of a block's items go there, in pieces of about cell items. So a task sums whole rows of the product
    and returns their best: pairs are never shuffled. An item whose users' lists are more than ENTRIES is dealt out by its
    users, and its sums are joined by an aggregation. max_user_items leaves users out above it, which changes the result
    and is off unless given.
    """
    ui = lines.select(F.col(user).alias("u"), F.col(item).alias("i")).where(F.col("u").isNotNull() & F.col("i").isNotNull())
    # one shuffle by the user serves distinct rows, their number, and the lists
    ui = ui.repartition("u").distinct().withColumn("nu", F.count("*").over(Window.partitionBy("u")))
    if max_user_items:
        ui = ui.where(F.col("nu") <= max_user_items)
    piece = F.pmod(F.xxhash64("i"), F.ceil(F.col("nu") / cell)).alias("piece")
    lists = written(ui.groupBy("u", "nu", piece).agg(F.sort_array(F.collect_list("i")).alias("items")), "walk")
    spark, kind = lists.sparkSession, lists.schema["items"].dataType.elementType.simpleString()
    number = kind in ("tinyint", "smallint", "int", "bigint")
    keys = lambda c: F.transform(c, lambda i: i.cast("long") if number else F.xxhash64(i))
    each = lists.select("u", "nu", F.explode("items").alias("i"))
    counter = F.pmod(F.xxhash64("i"), F.lit(COUNTERS)).alias("counter")
    counted = written(each.groupBy(counter).agg(F.sum("nu").alias("load")), "walk-loads")
    met, most = counted.agg(F.sum("load"), F.max("load")).first()
    blocks = int(min(max((met or 0) / ENTRIES, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), 10_000))
    parts = [j / blocks for j in range(1, blocks)]
    bounds = lists.select(F.explode(keys("items")).alias("key")).agg(F.percentile_approx("key", parts, 10 * max(blocks, 1000))).first()[0] if parts else []
    bounds = np.unique(np.array(bounds or [], np.int64))
    mine, load = lists.withColumn("mine", F.col("items")), 0
    if (most or 0) > ENTRIES:
        some = each.join(F.broadcast(counted.where(F.col("load") > ENTRIES).select("counter")), counter == F.col("counter"), "left_semi")
        loads = written(some.groupBy("i").agg(F.sum("nu").alias("load"), F.count("*").alias("ni")).where(F.col("load") > ENTRIES), "walk-hot")
        load = loads.agg(F.sum("load")).first()[0] or 0
    if load:
        rest = each.join(loads.select("i"), "i", "left_anti").groupBy("u", piece).agg(F.collect_list("i").alias("mine"))
        mine = lists.join(rest, ["u", "piece"])
    mine = mine.withColumn("key", keys("mine"))
    few = _by_blocks(mine.where(F.col("nu") <= cell).select("nu", "items", "key", "mine"), bounds)
    sent = few.select("block", F.lit(True).alias("whole"), "nu", "mine", "items", F.lit(True).alias("counts"))
    # users of several pieces: the items of a block meet every piece
    first = F.pmod(F.xxhash64(F.get("mine", F.lit(0))), F.ceil(F.col("nu") / cell))
    many = _by_blocks(mine.where(F.col("nu") > cell).select("u", "nu", "key", "mine"), bounds)
    many = many.groupBy("u", "block").agg(F.flatten(F.collect_list("mine")).alias("mine")).withColumn("whole", F.lit(True))
    if load:
        n = -(-load // ENTRIES)
        dealt = (F.pmod(F.xxhash64("u"), F.lit(n)) - n).cast("int").alias("block")
        many = many.unionByName(each.join(loads.select("i"), "i", "left_semi").groupBy("u", dealt).agg(F.collect_list("i").alias("mine")).withColumn("whole", F.lit(False)))
    wide = lists if load else lists.where(F.col("nu") > cell)
    met_by = wide.join(many, "u").select("block", "whole", "nu", "mine", "items", (F.col("piece") == first).alias("counts"))
    found = sent.unionByName(met_by).groupBy("block").applyInArrow(lambda t: _walk(t, top, places), f"item_a {kind}, item_b {kind}, weight double, whole boolean")
    if load:
        found = written(found, "walk-rows")
        # the parts of an item's row meet
        hot = found.where("NOT whole").groupBy("item_a", "item_b").agg(F.sum("weight").alias("weight")).join(loads.select(F.col("i").alias("item_a"), "ni"), "item_a")
        order = Window.partitionBy("item_a").orderBy(F.desc("weight"), "item_b")
        hot = hot.withColumn("weight", F.floor(F.col("weight") / F.col("ni") * 10.0**places + HALF) / 10.0**places).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
        found = found.where("whole").select("item_a", "item_b", "weight").unionByName(hot.select("item_a", "item_b", "weight"))
    return undirected_max(found).withColumn("weight", F.col("weight") * scale)


def _by_blocks(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows (.., key, mine), each as often as its mine has items of different blocks: block, and as mine the items of it.

    key has a number for each of mine; a block ends before each of bounds, which are ascending.
    """
    given = [c for c in rows.columns if c not in ("key", "mine")]

    def work(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column("mine")).to_numpy().astype(np.int64)
            # about as many items at once as a chunk has pairs
            ends = np.flatnonzero(np.diff(np.cumsum(size * np.minimum(size, len(bounds) + 1)) // CHUNK, append=-1)) + 1
            for a, z in zip(np.r_[0, ends[:-1]], ends):
                b = batch.slice(a, z - a)
                row, block = np.repeat(np.arange(z - a), size[a:z]), np.searchsorted(bounds, b.column("key").flatten().to_numpy(), "right")
                order = np.lexsort((block, row))
                row, block = row[order], block[order]
                starts = np.flatnonzero(np.r_[np.ones(min(len(row), 1), bool), (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
                items = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), b.column("mine").flatten().take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row[starts])) for c in given), pa.array(block[starts], pa.int32()), items], [*given, "block", "mine"])

    return rows.mapInArrow(work, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in given) + f", block int, mine {rows.schema['mine'].dataType.simpleString()}")


#: Halves are rounded up, whatever the order of summing has left of them.
HALF = 0.5 + 1e-6


def _walk(t: pa.Table, top: int, places: int) -> pa.Table:
    """(item_a, item_b, weight, whole) of a block's rows (nu, mine, items, counts): an item of mine meets all of items.

    The top rows of each item, if the block is whole; else all sums, still to be joined with those of other blocks.
    """
    whole = t.column("whole")[0].as_py()
    left, right = (t.column(c).combine_chunks() for c in ("mine", "items"))
    coded = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code, values = rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))
    n_left, n_right = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (left, right))
    a, b = code[: n_left.sum()], code[n_left.sum() :]
    row, starts, share = np.repeat(np.arange(len(n_left)), n_left), np.cumsum(n_right) - n_right, 1.0 / t.column("nu").to_numpy()
    ni = np.bincount(a[t.column("counts").to_numpy()[row]], minlength=len(values))
    order = np.argsort(a, kind="stable")
    a, row = a[order], row[order]
    pairs, first = np.cumsum(n_right[row]), np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    out = []

    def met(x: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, share) of all pairs of the left entries x to z."""
        n = n_right[row[x:z]]
        at = np.repeat(starts[row[x:z]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(a[x:z], n), b[at], np.repeat(share[row[x:z]], n)

    def best(one: np.ndarray, other: np.ndarray, weight: np.ndarray) -> None:
        """Pairs of whole rows, by item and neighbour."""
        if whole:
            weight = np.floor(weight / ni[one] * 10.0**places + HALF) / 10.0**places
            ends = np.flatnonzero(np.r_[one[1:] != one[:-1], True]) + 1
            keep = np.ones(len(one), bool)
            for x, z in zip(np.r_[0, ends[:-1]], ends):
                if z - x > top:
                    keep[x:z] = weight[x:z] >= np.partition(weight[x:z], z - x - top)[z - x - top]
            one, other, weight = one[keep], other[keep], weight[keep]
            order = np.lexsort((other, -weight, one))
            one, other, weight = one[order], other[order], weight[order]
            keep = np.arange(len(one)) - np.searchsorted(one, one) < top
            one, other, weight = one[keep], other[keep], weight[keep]
        out.append(pa.table({"item_a": values.take(pa.array(one)), "item_b": values.take(pa.array(other)), "weight": weight, "whole": np.full(len(one), whole)}))

    upto, last = np.r_[0, pairs], np.r_[first[1:], len(a)]
    g = 0
    while g < len(first):
        x, z = first[g], last[g]
        if upto[z] - upto[x] > CHUNK:
            # one item of many pairs: its row is summed in full length, piece by piece
            weight = np.zeros(len(values))
            while x < z:
                to = max(x + 1, min(z, int(np.searchsorted(upto, upto[x] + CHUNK, "right")) - 1))
                _, other, w = met(x, to)
                weight += np.bincount(other, w, len(values))
                x = to
            weight[a[first[g]]] = 0
            other = np.flatnonzero(weight)
            best(np.full(len(other), a[first[g]]), other, weight[other])
            g += 1
            continue
        to = max(g + 1, int(np.searchsorted(upto[last], upto[x] + CHUNK, "right")))
        one, other, w = met(x, last[to - 1])
        key = one * len(values) + other
        order = np.argsort(key)
        key, w = key[order], w[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, w = key[at], np.add.reduceat(w, at)
        keep = key // len(values) != key % len(values)
        best(key[keep] // len(values), key[keep] % len(values), w[keep])
        g = to
    return pa.concat_tables(out)


def endpoints(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.array("item_a", "item_b")).alias("item")).distinct()


def bought_together(lines: DataFrame, asked: DataFrame, *, least: int = 2) -> DataFrame:
    """(item): those of asked (query) that have a co-buy edge, in at least so many baskets of lines (customer, day, item).

    Only pairs with an asked item are made; lines have to hold the whole of a basket that has one.
    """
    found = written(baskets(lines, "customer", "day", "item"), "baskets-near")
    each = found.select(F.explode("items").alias("query"), "items").join(asked, "query", "left_semi")
    pairs = each.select("query", F.explode("items").alias("other")).where("query <> other").groupBy("query", "other").agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= least).select(F.col("query").alias("item")).distinct()


def cold_edges(found: DataFrame, warm: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """Edges with at least one end outside warm: one column of items, or what tells a warm item by itself.

    The second needs no join, and holds wherever edges are made, so others can be left out before they travel.
    """
    if not isinstance(warm, DataFrame):
        return found.where(~F.coalesce(warm(F.col("item_a")), F.lit(False)) | ~F.coalesce(warm(F.col("item_b")), F.lit(False)))
    (name,) = warm.columns
    w = warm.select(F.col(name).alias("x"), F.lit(True).alias("in")).distinct()
    joined = found.join(w.select(F.col("x").alias("item_a"), F.col("in").alias("wa")), "item_a", "left").join(w.select(F.col("x").alias("item_b"), F.col("in").alias("wb")), "item_b", "left")
    return joined.where("wa IS NULL OR wb IS NULL").select(found.columns)


def diverse_neighbors(adj: DataFrame, meta: DataFrame, *, key: str, type_col: str, season_col: str | None = None, limit: int = SETTINGS.pair_limit, per_type: int = SETTINGS.max_per_type, min_weight: float = SETTINGS.min_weight) -> DataFrame:
    """(item_a, item_b, weight, rank): best neighbours, at most per_type of a type, none that clashes in season.

    Walking the list and counting what was taken gives the same: an item's fate depends only on better ones of its
    type. A blank type is never capped.
    """
    cols = [F.col(key).alias("item_b"), F.coalesce(F.col(type_col).cast("string"), F.lit("")).alias("type_b")]
    found = adj.where(F.col("weight") >= min_weight)
    if season_col:
        cols.append(F.col(season_col).alias("season_b"))
        found = found.join(meta.select(F.col(key).alias("item_a"), F.col(season_col).alias("season_a")), "item_a", "left")
    found = found.join(meta.select(*cols), "item_b", "left")
    if season_col:
        found = found.where(~season_clash(F.col("season_a"), F.col("season_b")))
    by_type = Window.partitionBy("item_a", "type_b").orderBy(F.desc("weight"), "item_b")
    found = found.withColumn("r", F.row_number().over(by_type)).where((F.col("r") <= per_type) | (F.coalesce("type_b", F.lit("")) == ""))
    order = Window.partitionBy("item_a").orderBy(F.desc("weight"), "item_b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("item_a", "item_b", "weight", "rank")


def borrowed_neighbors(twins: DataFrame, adj: DataFrame) -> DataFrame:
    """(item, neighbour, score): neighbours of an item's twins, by the sum of the twins' similarity.

    twins is (item, twin, similarity); an item is no neighbour of itself.
    """
    joined = twins.join(adj.select(F.col("item_a").alias("twin"), F.col("item_b").alias("neighbour")), "twin")
    return joined.where("item <> neighbour").groupBy("item", "neighbour").agg(F.round(F.sum("similarity"), 9).alias("score"))


def borrow_scores(twins: DataFrame, adj: DataFrame, fit: Column, vectors: DataFrame, *, tie: float = 0.01, places: int = 9) -> DataFrame:
    """(item, neighbour, one, all) from twins (item, twin, similarity): what a twin's edges say of an item's own.

    one is 1 where the closest twin has the edge, all the sum of the similarities of the twins that have it; both with
    tie * fit, a column over own and other, the vectors (key, vector) of the two ends. Ties of twins go to the least id.
    """
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("similarity"), "twin"))
    edges_of = adj.select(F.col("item_a").alias("twin"), F.col("item_b").alias("neighbour"))
    x = twins.withColumn("place", place).join(edges_of, "twin").where("item <> neighbour")
    x = x.groupBy("item", "neighbour").agg(F.max(F.when(F.col("place") == 1, 1.0).otherwise(0.0)).alias("one"), F.sum("similarity").alias("all"))
    own, other = vectors.select(F.col("key").alias("item"), F.col("vector").alias("own")), vectors.select(F.col("key").alias("neighbour"), F.col("vector").alias("other"))
    extra = F.coalesce(fit, F.lit(0.0)) * tie
    x = x.join(own, "item", "left").join(other, "neighbour", "left").withColumn("extra", extra)
    return x.select("item", "neighbour", *[F.round(F.col(c) + F.col("extra"), places).alias(c) for c in ("one", "all")])


def first_tier(tiers: list[DataFrame], by: str = "item") -> DataFrame:
    """Rows of the first frame that has any for an item; each has (by, candidate, score), tier counts from 1."""
    whole = None
    for i, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(i))
        whole = t if whole is None else whole.unionByName(t)
    least = F.min("tier").over(Window.partitionBy(by))
    return whole.withColumn("least", least).where("tier = least").drop("least")


def degrees(found: DataFrame) -> DataFrame:
    return both_ways(found).groupBy(F.col("item_a").alias("item")).agg(F.count("*").alias("degree"))


def degree_bin(degree: Column) -> Column:
    return F.floor(F.log2(degree + 1)).cast("int")


def nearest_rank(rows: DataFrame, value: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value): the element at int(q * n) of the sorted values, from 0; found from counts of values, summed by ranges."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = ordering.running_total(counts, "c", [value], by=by)
    n = upto.groupBy(*by).agg(F.sum("c").alias("n"))
    upto = upto.join(n, by) if by else upto.crossJoin(F.broadcast(n))
    q = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("q")
    rank = F.least(F.floor(F.col("q") * F.col("n")), F.col("n") - 1)
    asked = upto.select(*by, value, "c", "upto", "n", q).where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")))
    return asked.select(*by, "q", value)


def profile(found: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges, mean degree, mean weight, largest degree."""
    one = undirected_max(found)
    deg = degrees(one)
    d = deg.agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))
    return one.agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight")).crossJoin(F.broadcast(d))


def report(adj: DataFrame, meta: DataFrame, key: str, fields: list[str], fractions: list[float]) -> DataFrame:
    """(name, q, value) of a directed adjacency: sizes, share of nodes that meta knows, edges within a value of each field,
    and least, greatest, mean and nearest-rank quantiles of degrees and weights. A blank value is within nothing."""
    adj = written(adj.select("item_a", "item_b", "weight"), "adjacency")
    deg = written(adj.groupBy(F.col("item_a").alias("item")).agg(F.count("*").cast("double").alias("degree")), "degrees")
    sides = [meta.select(F.col(key).alias(f"item_{e}"), *[F.col(f).cast("string").alias(f"{f}_{e}") for f in fields]) for e in "ab"]
    x = adj.join(sides[0], "item_a", "left").join(sides[1], "item_b", "left")
    within = [F.avg((F.coalesce(F.col(f"{f}_a") != "", F.lit(False)) & F.coalesce(F.col(f"{f}_a") == F.col(f"{f}_b"), F.lit(False))).cast("double")).alias(f"within {f}") for f in fields]
    one = x.agg(F.count("*").cast("double").alias("directed edges"), F.count_if(F.col("item_a") < F.col("item_b")).cast("double").alias("edges"), *within, *[f("weight").cast("double").alias(f"{n} weight") for n, f in (("least", F.min), ("greatest", F.max), ("mean", F.avg))])
    nodes = deg.join(meta.select(F.col(key).alias("item"), F.lit(1.0).alias("known")).distinct(), "item", "left")
    two = nodes.agg(F.count("*").cast("double").alias("nodes"), F.sum("known").alias("known nodes"), F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage"), *[f("degree").alias(f"{n} degree") for n, f in (("least", F.min), ("greatest", F.max), ("mean", F.avg))])
    flat = lambda d: d.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in d.columns]))).alias("name", "value")).select("name", F.lit(None).cast("double").alias("q"), "value")
    quant = [nearest_rank(d, c, fractions).select(F.lit(c).alias("name"), "q", F.col(c).cast("double").alias("value")) for d, c in ((deg, "degree"), (adj, "weight"))]
    return flat(one).unionByName(flat(two)).unionByName(quant[0]).unionByName(quant[1])


def mean_of_neighbors(adj: DataFrame, vectors: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(item, i, x): the mean of an item's own vector and its neighbours', by dimension."""
    own = vectors.select(F.col(key).alias("item"), F.col(key).alias("source"))
    links = adj.select(F.col("item_a").alias("item"), F.col("item_b").alias("source")).unionByName(own)
    each = links.join(vectors.select(F.col(key).alias("source"), F.posexplode(vector_col).alias("i", "x")), "source")
    return each.groupBy("item", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def sampling_weight(deg_a: Column, deg_b: Column) -> Column:
    """Edges between popular items weigh less."""
    return 1.0 / F.sqrt(deg_a.cast("double") * deg_b)


def coverage_stats(found: DataFrame, items: DataFrame) -> DataFrame:
    """One row: nodes, warm and cold ones, coverage in percent, and the least, middle and largest weight."""
    (name,) = items.columns
    warm = endpoints(found).withColumnRenamed("item", name).withColumn("w", F.lit(1))
    n = items.distinct().join(warm, name, "left").agg(F.count("*").alias("nodes"), F.count("w").alias("warm"))
    n = n.withColumn("cold", F.col("nodes") - F.col("warm")).withColumn("coverage", F.round(100 * F.col("warm") / F.col("nodes"), 4))
    w = found.agg(F.min("weight").alias("least"), F.percentile("weight", 0.5).alias("middle"), F.max("weight").alias("most"))
    return n.crossJoin(F.broadcast(w))


def partitions(items: DataFrame, by: str) -> DataFrame:
    """(by, n, start): where each group begins if all items stand group by group, as samplers index them."""
    n = items.groupBy(by).agg(F.count("*").alias("n"))
    return ordering.running_total(n, "n", [by]).select(by, "n", (F.col("upto") - F.col("n")).cast("long").alias("start"))


def top_edges(found: DataFrame, k: int, method: str) -> DataFrame:
    """(method, item, other, rank): the k heaviest neighbours."""
    order = Window.partitionBy("item_a").orderBy(F.desc("weight"), "item_b")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select(F.lit(method).alias("method"), F.col("item_a").alias("item"), F.col("item_b").alias("other"), "rank")


def disagreements(a: DataFrame, b: DataFrame, family: Callable[[Column], Column]) -> DataFrame:
    """(item, one, two): items whose first neighbours by two methods differ, and not just in style (family of the id)."""
    x = a.where("rank = 1").select("item", F.col("other").alias("one"))
    y = b.where("rank = 1").select("item", F.col("other").alias("two"))
    return x.join(y, "item").where((F.col("one") != F.col("two")) & (family(F.col("one")) != family(F.col("two"))))
