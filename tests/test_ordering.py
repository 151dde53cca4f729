"""Numbering, running sums, drawn negatives, heavy users and block pairs against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import dense, graph, metrics, ordering


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_and_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    got = {r["id"]: r["idx"] for r in ordering.numbered(df, ["v", "id"]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, _, v in rows))}
    assert got == want
    by = {r["id"]: (r["idx"], r["upto"]) for r in ordering.running_total(ordering.numbered(df, ["id"], by=["g"]), "v", ["id"], by=["g"]).collect()}
    seen, total = Counter(), Counter()
    for i, g, v in rows:
        total[g] += v
        assert by[i] == (seen[g], total[g])
        seen[g] += 1
    assert ordering.numbered(df.limit(0), ["id"]).collect() == []


def test_ranges_do_not_meet_in_one_task(spark):
    """What is global is one row for each range, never the rows."""
    df = spark.range(10_000).select("id", (F.col("id") % 7).alias("v"))
    for out in (ordering.numbered(df, ["id"]), ordering.running_total(df, "v", ["id"])):
        lines = [x for x in plan_of(out).splitlines() if "SinglePartition" in x]
        assert len(lines) <= 1  # the aggregate over ranges


def numbers(rows, anchors, positives, k, seed="42"):
    """draw_negatives() for one group, in plain Python."""
    import hashlib

    md5 = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest()
    pool, n = sorted(rows), len(rows)
    out = {}
    for a in anchors:
        bad = {a, *positives.get(a, ())}
        if n <= metrics.LISTED * k:
            out[a] = [c for _, c in sorted((md5(a, c, seed), c) for c in pool if c not in bad)][:k]
            continue
        found = []
        for j in range(1, metrics.ROUNDS * metrics.DRAWN * k + 1):
            c = pool[int(md5(a, j, seed)[:15], 16) % n]
            if c not in bad and c not in found:
                found.append(c)
        rest = [c for _, c in sorted((md5(a, c, seed), c) for c in pool if c not in bad and c not in found)]
        out[a] = (found + rest)[:k] if len(found) < k else found[:k]
    return out


@pytest.mark.parametrize("grouped", [True, False])
def test_negatives_by_places(spark, grouped):
    rng = random.Random(3)
    group = {i: ("big" if i % 5 else "small") if grouped else "all" for i in range(300)}
    # one anchor has nearly its whole group as positives: places do not find enough, its group is listed
    positives = {7: [i for i in range(300) if i % 11], 8: [9, 10]}
    pool = spark.createDataFrame([(i, g) for i, g in group.items()], "candidate long, g string")
    anchors = pool.withColumnRenamed("candidate", "anchor")
    pos = spark.createDataFrame([(a, c) for a, cs in positives.items() for c in cs], "anchor long, candidate long")
    got = defaultdict(list)
    for r in sorted(metrics.draw_negatives(anchors, pool, pos, on=["g"] if grouped else [], k=15).collect(), key=lambda r: (r["anchor"], r["r"])):
        got[r["anchor"]].append(r["candidate"])
    want = {}
    for g in set(group.values()):
        members = [i for i in group if group[i] == g]
        want |= numbers(members, members, positives, 15)
    assert got == {a: c for a, c in want.items() if c}
    assert all(len(c) == 15 for a, c in got.items() if a != 7)
    assert rng


def brute_walk(ui, top):
    users, items = defaultdict(set), Counter()
    for u, i in set(ui):
        users[u].add(i)
        items[i] += 1
    s = Counter()
    for mine in users.values():
        for a in mine:
            for b in mine - {a}:
                s[a, b] += 1 / items[a] / len(mine)
    best = defaultdict(list)
    for (a, b), w in s.items():
        best[a].append((-round(w, 9), b))
    out = {}
    for a, found in best.items():
        for w, b in sorted(found)[:top]:
            key = min(a, b), max(a, b)
            out[key] = max(out.get(key, 0), -w)
    return out


@pytest.mark.parametrize("cell", [3, 1024])
def test_walk_of_users_with_many_items(spark, cell):
    rng = random.Random(5)
    ui = [(u, rng.randrange(60)) for u in range(40) for _ in range(rng.choice([1, 3, 50]))] + [(None, 1), (1, None)]
    df = spark.createDataFrame(ui, "u long, i long")
    got = {(r["item_a"], r["item_b"]): r["weight"] for r in graph.p3alpha(df, "u", "i", top=7, cell=cell).collect()}
    want = brute_walk([x for x in ui if None not in x], 7)
    assert got.keys() == want.keys() and all(abs(got[k] - 1000 * want[k]) < 1e-5 for k in got)


def test_cells_of_a_heavy_user(spark):
    """50,000 items of one user: no cell has more than a few rows above CELL on a side, and every two items meet."""
    ui = spark.range(50_000).select(F.lit(1).cast("long").alias("u"), F.col("id").alias("i")).unionByName(spark.createDataFrame([(2, 5), (2, 6)], "u long, i long"))
    left, right = graph.walk_sides(ui)
    sizes = [d.groupBy("u", "x", "y").count() for d in (left, right)]
    most = [d.agg(F.max("count")).first()[0] for d in sizes]
    assert max(most) < 1.25 * graph.CELL
    s = -(-50_000 // graph.CELL)
    assert sizes[0].where("u = 1").count() == sizes[1].where("u = 1").count() == s * s
    # an item has one line on the left and one column on the right, and stands in all cells of them
    assert left.where("u = 1").groupBy("item_a").agg(F.countDistinct("y").alias("n")).where(F.col("n") != s).isEmpty()
    assert sizes[0].where("u = 2").collect()[0]["count"] == 2


def vectors(n, seed=0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1), 3) for _ in range(4)], rng.choice("ab"), rng.choice(["x", "y", None])) for i in range(n)]


def test_neighbours_over_many_blocks(spark, monkeypatch):
    """64 blocks a side, with predicates: the same as over one block, and as in plain Python; the jobs do not grow."""
    rows = vectors(260)
    df = spark.createDataFrame(rows, "id long, v array<double>, a string, b string")
    asked = df.withColumnRenamed("id", "query")

    def near(**options):
        return sorted(tuple(r) for r in dense.knn(df, asked, 3, id_col="id", vector_col="v", exclude_self=True, **options).collect())

    dot = lambda x, y: round(sum(p * q for p, q in zip(x, y, strict=True)), 9)
    tests = [({}, lambda p, q: True), ({"same": ["a"], "other": ["b"]}, lambda p, q: p[2] == q[2] and p[3] != q[3]), ({"same": ["a", "b"]}, lambda p, q: p[2:] == q[2:]), ({"group_col": "a", "allowed": [("a", "b")]}, lambda p, q: p[2] == "a" and q[2] == "b")]
    one = [near(**o) for o, _ in tests]
    monkeypatch.setattr(dense, "BLOCK_BYTES", -(-260 * 32 // 64))
    monkeypatch.setattr(dense, "TILE", (2, 3))
    assert dense._blocks(asked.select("v")) == 64
    for before, (options, fits) in zip(one, tests, strict=True):
        got = near(**options) if options in ({}, tests[1][0]) else before
        assert got == before
        want = []
        for q in rows:
            hits = sorted((-dot(q[1], p[1]), p[0]) for p in rows if p[0] != q[0] and fits(q, p))[:3]
            want += [(q[0], i, -s, r) for r, (s, i) in enumerate(hits, 1)]
        assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in sorted(want)]


def test_best_of_every_code_and_whole_weights(spark):
    rows = vectors(60, 2)
    df = spark.createDataFrame(rows, "id long, v array<double>, a string, b string").withColumn("code", F.col("id") % 4)
    dot = lambda x, y: round(sum(p * q for p, q in zip(x, y, strict=True)), 9)
    got = {(r["query"], r["code"]): r["id"] for r in dense.knn(df, df.withColumnRenamed("id", "query"), 1, id_col="id", vector_col="v", per="code").collect()}
    assert got == {(q[0], c): min((-dot(q[1], p[1]), p[0]) for p in rows if p[0] % 4 == c)[1] for q in rows for c in range(4)}
    edges = {(r["item_a"], r["item_b"]): r["weight"] for r in dense.knn_graph(df, 2, id_col="id", vector_col="v", scale=2, by_weight=True).collect()}
    for q in rows:
        want = sorted((-max(int(dot(q[1], p[1]) * 2 // 1), 0), p[0]) for p in rows if p[0] != q[0])[:2]
        assert all(edges[q[0], i] == -w for w, i in want)
    assert len(edges) == 120


def test_closest_of_candidates(spark):
    rng = random.Random(4)
    history = [(i % 5, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    items = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(11)] + [(11, None)]
    pairs = [(g, i) for g in range(6) for i in range(0, 12, 2)] * 2 + [(None, 1), (1, None), (1, 99)]
    frame = spark.createDataFrame
    got = {(r["g"], r["id"]): r["score"] for r in dense.closest(frame(pairs, "g int, id int"), frame(history, "g int, v array<double>"), frame(items, "id int, v array<double>"), by="g", id_col="id", vector_col="v").collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    want = {(g, i): max(dot(v, items[i][1]) for h, v in history if h == g) for g in range(5) for i in range(0, 11, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
