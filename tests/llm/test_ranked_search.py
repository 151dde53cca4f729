import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessella.llm import queries
from tessella.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """Every document against every item, in plain Python."""
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        hits = []
        for i, c in rows:
            if i is None:
                continue
            m = 100 - 50 + (50 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                hits.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


def collection(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([4, 60])]) for _ in range(rng.choice([1, 8, 40])))) for i in range(300)]
    docs += [(1000 + i, "Twin text é Ü") for i in range(70)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w3"), (None, ""), (2000, None), (2001, "?!"), (2002, "w7 " * 5000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12])))) for i in range(25)]
    items += [(90, "twin é"), (91, None), (92, "never seen"), (93, "w1"), (93, "w2 w2"), (None, "w4")]
    return docs, items


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 20, 1 << 20, 16), (40, 100, 60, 2), (7, 64, 10_000, 1)])
def test_small_corpus(spark, monkeypatch, limits):
    for name, v in zip(("SHARD_POSTINGS", "PART_BYTES", "ITEM_BYTES", "FIRST_WAVE"), limits, strict=True):
        monkeypatch.setattr(rs, name, v)
    docs, items = collection()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in rs.rank_documents(frame, asked).collect()), key=repr)
    assert got == brute(docs, items)
    got = sorted((tuple(r) for r in rs.rank_documents(frame, asked, k=3).collect()), key=repr)
    assert got == brute(docs, items, 3)


@pytest.mark.parametrize("seed", range(5))
def test_pruning_changes_nothing_and_saves_postings(seed):
    rng = np.random.default_rng(seed)
    n, t = 2000, 30
    doc, term = np.nonzero(rng.random((n, t)) < rng.random(t) ** 2)
    order = np.lexsort((doc, term))
    doc, term = doc[order].astype(np.int32), term[order]
    some, cut = np.unique(term, return_index=True)
    tf, length = rng.integers(1, 9, len(doc)).astype(np.int32), rng.integers(9, 90, n)
    row = {"terms": some.astype(np.int32), "cut": cut.astype(np.int32), "docs": doc, "tf": tf, "ids": np.arange(n), "length": length}
    shard = rs.Shard({k: v.tobytes() for k, v in row.items()}, n, int(length.sum()))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for c in np.bincount(term, minlength=t)])
    asked = np.flatnonzero(rng.random(t) < 0.5).astype(np.int32)
    full = np.zeros(n, np.int64)
    for x, d, s in zip(term, doc, shard.impact, strict=True):
        if x in asked:
            full[d] += weight[x] * s
    every = int(np.isin(term, asked).sum())
    for need in (1, int(np.sort(full)[-200]), int(np.sort(full)[-10]), int(full.max()) + 1):
        shard.probed = 0
        d, s = shard.search(asked, weight[asked], need)
        assert sorted(zip(d.tolist(), s.tolist(), strict=True)) == [(i, full[i]) for i in range(n) if full[i] >= need]
    assert shard.probed < every / 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.rank_documents(docs, items).collect() == []
    assert rs.rank_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
    assert rs.rank_documents(spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_against_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = sorted(tuple(r) for r in queries.op12_ranked_search(spark, sf_dir).collect())
    assert got == sorted(con.execute(queries.ORACLES["op12_ranked_search"]).fetchall())
    assert sorted(got, key=repr) == brute(con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall())
