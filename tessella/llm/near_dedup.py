"""Near-duplicate detection with an LSH forest over MinHash signatures.

Rows with equal shingle sets form a class; one row stands for it. Each tree of the forest sorts the classes by one
signature order of DEPTH hash values. Neighbours in an order that share at least MIN_DEPTH leading values are
candidates: where few classes share that prefix all of them meet, and in a dense region the nearest neighbours share
longer prefixes, so the depth adapts to the region and no group is ever paired with itself. Candidates whose signatures
could belong to a link are confirmed on the full shingle sets. The closest candidate of each class is confirmed first;
the others only if they would join two components that are still apart. Where more classes share a prefix than one meets
as neighbours, and they lie in several components after that, every two of them from different components are compared:
the region is cut into blocks of bounded size, and each two blocks that may hold a link meet in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops
from .components import connected_components
from .shared import IdFilter, materialize, release_shuffles, without

TREES = 16
DEPTH = 8
MIN_DEPTH = 4
#: Neighbours that each class meets on one side in each order.
NEIGHBOURS = 4
#: Classes of one block of a crowded region; a task compares two blocks.
BLOCK = 1024
#: Copies of one text are dealt apart if they are more than this part of all rows.
HOT = 1 / 2000
#: Standard deviations by which a signature's estimate may fall short of the threshold.
SLACK = 5.0
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, how many each has).

    Words are runs without ASCII white space, A-Z in lower case. With fewer words than width the whole sequence is the
    only shingle; a text without words has none.
    """
    data = bytesops.ascii_lower(data)
    start, end, doc = bytesops.words(data, offsets)
    h = bytesops.mix(bytesops.span_hash(bytesops.prefix_hash(data), start, end) + (end - start).astype(np.uint64))
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    full = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        full = bytesops.mix(full * _C[0] + h[k : k + len(full)] * _C[1] + np.uint64(k))
    sets = []
    sizes = np.zeros(n, dtype=np.int64)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.unique(full[a : b - width + 1])
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = bytesops.mix(np.array([one * _C[2] + x]))[0]
            s = np.array([one], dtype=np.uint64)
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets x TREES*DEPTH) low halves of the least values; only for sizes > 0."""
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), TREES * DEPTH), dtype=np.uint16)
    for k in range(TREES * DEPTH):
        out[:, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], at) & np.uint32(0xFFFF)
    return out


def _longs(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel())
    return pa.ListArray.from_arrays(np.arange(0, len(values) * width + 1, width, dtype=np.int32), flat)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, k1, k2, keys) of rows (id, text): set size, 128-bit set hash, two 64-bit halves of each tree's key."""

    def work(batches):
        for batch in batches:
            for rows, data, offsets in bytesops.runs(batch):
                sets, sizes = shingle_sets(data, offsets, width)
                some = np.flatnonzero(sizes)
                at = np.concatenate(([0], np.cumsum(sizes[some])[:-1])).astype(np.int64) if len(some) else np.zeros(0, np.int64)
                k1, k2 = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                keys = np.zeros((len(sizes), TREES * 2), np.int64)
                if len(some):
                    k1[some] = np.add.reduceat(bytesops.mix(sets), at).view(np.int64)
                    k2[some] = np.bitwise_xor.reduceat(bytesops.mix(sets + _C[2]), at).view(np.int64)
                    sig = signatures(sets, sizes[some]).astype(np.uint64).reshape(len(some), TREES * 2, DEPTH // 2)
                    packed = np.zeros(sig.shape[:2], np.uint64)
                    for j in range(DEPTH // 2):
                        packed = (packed << np.uint64(16)) | sig[:, :, j]
                    keys[some] = packed.view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes), pa.array(k1), pa.array(k2), _longs(keys, TREES * 2)], ["id", "n", "k1", "k2", "keys"])

    return docs.mapInArrow(work, "id long, n long, k1 long, k2 long, keys array<long>")


def tree_keys(classes: DataFrame) -> DataFrame:
    """(id, n, tree, p, q): a row per class and tree, with the two halves of its key."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: F.struct(i.alias("tree"), F.get("keys", i * 2).alias("p"), F.get("keys", i * 2 + 1).alias("q")))
    return classes.select("id", "n", F.explode(trees).alias("t")).select("id", "n", "t.tree", "t.p", "t.q")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: neighbours in some tree whose sizes allow a link."""
    rows = tree_keys(classes)
    # p is the first half of the key: equal p is a common prefix of MIN_DEPTH values
    order = Window.partitionBy("tree", "p").orderBy("q", "id")
    near = rows.select("id", "n", *[F.lead(F.struct("id", "n"), k).over(order).alias(f"n{k}") for k in range(1, NEIGHBOURS + 1)])
    other = F.filter(F.array(*[f"n{k}" for k in range(1, NEIGHBOURS + 1)]), lambda x: x.isNotNull() & (F.least(x["n"], F.col("n")) * 100 >= F.greatest(x["n"], F.col("n")) * percent))
    pairs = near.where(F.col("n1").isNotNull()).select("id", F.explode(other).alias("x"))
    return pairs.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()


def least_same(percent: int) -> int:
    """Equal signature values that a link has at least."""
    total = TREES * DEPTH
    p = percent / 100
    return int(total * p - SLACK * (total * p * (1 - p)) ** 0.5)


def estimate(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, same): equal signature values, for the pairs that may be a link."""
    left = classes.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    right = classes.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    least = least_same(percent)

    def count(batches):
        for b in batches:
            x, y = (b.column(c).flatten().to_numpy().view(np.uint16).reshape(b.num_rows, -1) for c in ("ka", "kb"))
            same = (x == y).sum(axis=1).astype(np.int32)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(same).filter(keep)], ["a", "b", "same"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb")
    return both.mapInArrow(count, "a long, b long, same int")


def full_sets(ends: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, s) of the distinct ids in ends: the bytes of each one's shingle set."""
    near, _ = IdFilter(ends).split(docs.select("id", "text"), "id")

    def sets_of(batches):
        for batch in batches:
            for rows, data, offsets in bytesops.runs(batch):
                sets, sizes = shingle_sets(data, offsets, width)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                raw = [sets[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(raw, pa.binary())], ["id", "s"])

    # rows that share an id share it with equal sets or not at all: one of them stands for the class
    return near.mapInArrow(sets_of, "id long, s binary").join(ends, "id")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    found = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, width)

    def judge(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = found.select(F.col("id").alias("a"), F.col("s").alias("x")), found.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def crowded(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, tree, p, c): classes under prefixes that more share than one meets as neighbours, in several components c."""
    named = found.select(F.col("node").alias("id"), F.col("component").alias("c"))
    rows = tree_keys(classes).select("id", "tree", "p").join(named, "id", "left").withColumn("c", F.coalesce("c", "id"))
    open_ = rows.groupBy("tree", "p").agg(F.count("*").alias("m"), F.min("c").alias("x"), F.max("c").alias("y"))
    open_ = open_.where((F.col("m") > NEIGHBOURS + 1) & (F.col("x") < F.col("y"))).select("tree", "p")
    return rows.join(open_, ["tree", "p"]).select("id", "tree", "p", "c")


def block_pairs(rows: DataFrame) -> DataFrame:
    """(tree, p, a, b, block, id, c) of the rows of crowded: the members of every two blocks that may hold a link.

    A large component has blocks of its own, which need not meet each other; small ones share blocks.
    """
    group = ["tree", "p"]
    sizes = rows.groupBy(*group, "c").agg(F.count("*").alias("m"))
    small = sizes.where(F.col("m") <= BLOCK).groupBy(*group).agg(F.sum("m").alias("rest"))
    sizes = sizes.join(small, group, "left").withColumn("own", F.when(F.col("m") > BLOCK, F.col("c")))
    sizes = sizes.withColumn("parts", F.ceil(F.when(F.col("own").isNotNull(), F.col("m")).otherwise(F.col("rest")) / BLOCK))
    sizes = materialize(sizes.select(*group, "c", "own", "parts"), "near-sizes")
    each = F.when(F.col("own").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("c"), F.col("parts"))))
    blocks = sizes.select(*group, "own", F.explode(each).alias("k")).distinct()
    blocks = blocks.select(*group, "own", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "k").alias("block"))
    x, y = blocks.select(*group, F.col("own").alias("oa"), F.col("block").alias("a")), blocks.select(*group, F.col("own").alias("ob"), F.col("block").alias("b"))
    pairs = x.join(y, group).where((F.col("a") <= F.col("b")) & F.coalesce(F.col("oa") != F.col("ob"), F.lit(True)))
    met = pairs.select(*group, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("c"), F.col("parts")))
    placed = rows.join(sizes, [*group, "c"]).select(*group, "id", "c", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), dealt.alias("k")).alias("block"))
    return met.join(placed, [*group, "block"]).select(*group, "a", "b", "block", "id", "c")


def joins(ids: np.ndarray, c: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components c as all links between these classes would; with side, links across two sides.

    The classes that resemble most others come first, so a hub joins its copies before they are compared to each other.
    """
    side = np.arange(len(ids)) if side is None else side
    least = least_same(percent)
    score = np.zeros(len(ids), np.int64)
    for column in sig.T:
        _, value, count = np.unique(column, return_inverse=True, return_counts=True)
        score += count[value]
    order = np.lexsort((ids, -score))
    ids, sig, sets, side = ids[order], sig[order], [sets[i] for i in order], side[order]
    label = np.unique(c, return_inverse=True)[1][order]
    n = np.array([len(s) for s in sets], np.int64)
    cut = np.concatenate(([0], np.cumsum(n)))
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(universe), bool)
    out = []
    for i in range(len(ids) - 1):
        rest = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (side[i + 1 :] != side[i]))
        rest = rest[np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * percent]
        rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= least]
        if not len(rest):
            continue
        mark[flat[cut[i] : cut[i + 1]]] = True
        if len(rest) * 8 > len(ids) - i:
            both = np.add.reduceat(mark[flat[cut[i + 1] :]], cut[i + 1 : -1] - cut[i + 1], dtype=np.int64)[rest - i - 1]
        else:
            both = np.array([np.count_nonzero(mark[flat[cut[j] : cut[j + 1]]]) for j in rest])
        mark[flat[cut[i] : cut[i + 1]]] = False
        rest = rest[100 * both >= percent * (n[rest] + n[i] - both)]
        if len(rest):
            _, first = np.unique(label[rest], return_index=True)
            out += [(ids[i], ids[j]) for j in rest[first]]
            label[np.isin(label, label[rest])] = label[i]
    return out


def crowded_links(rows: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between the components that meet under one prefix; rows are those of crowded."""
    sets = materialize(full_sets(rows.select("id").distinct(), docs, width).dropDuplicates(["id"]).join(classes.select("id", "keys"), "id"), "near-sets")

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sig = np.concatenate([x.flatten().to_numpy() for x in group.column("keys").chunks]).view(np.uint16).reshape(group.num_rows, -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("s")]
        side = group.column("side").to_numpy()
        found = joins(group.column("id").to_numpy(), group.column("c").to_numpy(), sig, sets, percent, side if side.any() else None)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    both = block_pairs(rows).withColumn("side", (F.col("block") != F.col("a")).cast("int")).join(sets, "id")
    both = both.select("tree", "p", F.col("a").alias("x"), F.col("b").alias("y"), "side", "id", "c", "keys", "s")
    return both.groupBy("tree", "p", "x", "y").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two rows are linked if their shingle sets have a Jaccard similarity of at least percent / 100; component_id is the
    least id reachable over links and kept says that it is the row's own. Null, empty and blank texts have no shingles
    and no links. Rows of equal sets are linked whatever their number. A null id is never linked and kept, with a null
    component. Repeated rows under one id get a row each; ids are expected to name one text. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = materialize(profile(rows, width), "near-profile")
    full = known.where((F.col("n") > 0) & F.col("id").isNotNull())
    # combined before the shuffle: a class of any size costs one row per task
    reps = full.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.count("*").alias("copies"))
    reps = materialize(reps, "near-classes")
    classes = reps.select(F.col("rep").alias("id"), "n", "keys").dropDuplicates(["id"])
    reps = reps.drop("keys")
    pairs = materialize(estimate(candidates(classes, percent), classes, percent), "near-pairs")
    best = [F.row_number().over(Window.partitionBy(c).orderBy(F.desc("same"), o)) for c, o in (("a", "b"), ("b", "a"))]
    ranked = pairs.select("a", "b", F.least(*best).alias("rank"))
    ranked = materialize(ranked, "near-ranked")
    release_shuffles(spark)
    links = materialize(confirm(ranked.where("rank = 1"), rows, width, percent), "near-links")
    found = materialize(connected_components(links), "near-components")
    at = [found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    apart = ranked.where("rank > 1").join(at[0], "a", "left").join(at[1], "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    apart = materialize(apart, "near-apart")
    if not apart.isEmpty():
        links = links.unionByName(materialize(confirm(apart, rows, width, percent), "near-links"))
        found = materialize(connected_components(links), "near-components")
    release_shuffles(spark)
    met = materialize(crowded(classes, found), "near-crowded")
    if not met.isEmpty():
        links = links.unionByName(materialize(crowded_links(met, classes, rows, width, percent), "near-links"))
        found = materialize(connected_components(links), "near-components")
        release_shuffles(spark)
    named = reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = materialize(named.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"), "copies"), "near-named")
    key, rows = ["k1", "k2", "n"], known.select("id", "n", "k1", "k2")
    # texts without shingles match nothing; classes of more than HOT of all rows, of which there are at most 1 / HOT, are
    # broadcast, so that no key of the join holds more
    hot = named.where(F.col("copies") > full.count() * HOT).drop("copies")
    often = rows.where("n > 0").join(F.broadcast(hot.withColumnRenamed("component", "hot")), key, "left")
    other = often.where("hot IS NULL").drop("hot").join(named.drop("copies"), key, "left")
    out = often.where("hot IS NOT NULL").withColumnRenamed("hot", "component").unionByName(other)
    out = out.unionByName(rows.where("n = 0").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stand for their component; a row whose id is repeated stays with every repeat."""
    gone = near_duplicates(docs, id_col=id_col, **options).where(~F.col("kept")).select(id_col).distinct()
    return without(docs, materialize(gone, "near-gone"), id_col)
