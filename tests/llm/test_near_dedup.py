import random

from tessella.llm import components, near_dedup, queries


def brute(docs, width, percent):
    """(n_shingles, component) by id, comparing every two texts."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().split()
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(rows, docs, width, percent):
    want = brute(docs, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_small_cases(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(0, None), (1, ""), (2, " \t "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  Two"), (7, "É x y"), (8, "é x y")]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 120]))]
        for _ in range(rng.choice([1, 3, 14])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + k, "copy of one text that many rows hold") for k in range(60)]
    docs.append((len(docs), "long " * 40_000))
    frame = spark.createDataFrame([(i, t, 9, "x") for i, t in docs], "doc_id long, text string, n int, component_id string")
    for width, percent in ((3, 85), (5, 80)):
        check(near_dedup.near_duplicates(frame, width=width, percent=percent).collect(), docs, width, percent)
    kept = near_dedup.drop_near_duplicates(frame)
    want = brute(docs, 5, 80)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_copies_that_link_only_to_their_base(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(600)]
    texts = [base] + [list(base) for _ in range(300)]
    for k, text in enumerate(texts[1:]):
        for at in rng.sample(range(5, 595), 13):
            text[at] = f"c{k}x{at}"
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(near_dedup.near_duplicates(frame, width=3, percent=85).collect(), docs, 3, 85)


def dense_pairs(n):
    """n pairs of texts over one common stock of words: 0.92 within a pair, 0.84 (no link) across."""
    docs = []
    for k in range(n):
        pair = [f"p{k}x{i}" for i in range(20)]
        for side in "ab":
            docs.append((len(docs), " ".join([f"w{i}" for i in range(402)] + pair + [f"{side}{k}y{i}" for i in range(18)])))
    return docs


def test_links_in_a_dense_region(spark, monkeypatch):
    for n, block in ((1000, near_dedup.BLOCK), (60, 16)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        frame = spark.createDataFrame(dense_pairs(n), "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, width=3, percent=85).collect()}
        assert got == {i: i // 2 * 2 for i in range(2 * n)}


def test_blocks_of_a_crowded_region(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rows = [(i, 1, 7, 0 if i < 40 else i if i < 70 else 70) for i in range(74)] + [(i, 2, 7, i % 3) for i in range(9)]
    met = near_dedup.block_pairs(spark.createDataFrame(rows, "id long, tree int, p long, c long")).collect()
    tasks = {}
    for r in met:
        tasks.setdefault((r["tree"], r["p"], r["a"], r["b"]), []).append((r["id"], r["c"], r["block"]))
    seen = {(k[0], *sorted((x[0], y[0]))) for k, members in tasks.items() for x in members for y in members if x[1] != y[1] and (k[2] == k[3] or x[2] != y[2])}
    assert seen == {(r[1], *sorted((r[0], t[0]))) for r in rows for t in rows if r[1] == t[1] and r[3] != t[3]}


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, 1, True)] * 2
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None) and len(rows) == 4


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(0, n)] + [(1000, 1001), (5000, 5000)], "x long, y long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.op3_minhash_near_dedup(spark, sf_dir).collect(), docs, 3, 85)
