import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessella.llm import collocations as co
from tessella.llm import queries


def brute(rows, least=100, top=2000, longest=5, percent=100):
    """Every phrase of every piece, counted in plain Python."""
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        gone = {p[i : i + k] for p, v in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * v >= percent * c[p[i : i + k]]}
        hits = []
        for p, a in found.items():
            if p not in gone:
                s, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                hits.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, lft, rgt, n, -s) for r, (s, a, p, lft, rgt) in enumerate(sorted(hits)[:top], 1)]
    return sorted(out)


def texts(seed=0, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "x\x1cy", "日本"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words[: rng.choice([3, 15])]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", "!"]) for _ in range(rng.randrange(30)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), t))
    return [*out, ("en", None), ("en", ""), ("de", "..."), ("en", "New York City " * 50), ("en", "new york CITY, " * 20)]


@pytest.mark.parametrize("limits", [(2 << 20, 4 << 20, 1 << 23), (300, 40, 64), (1, 1, 1 << 23)])
def test_small_corpus(spark, monkeypatch, limits):
    """Also with a filter so small that it accepts almost everything."""
    for name, v in zip(("SHARD_WORDS", "PART_BYTES", "MIN_BITS"), limits, strict=True):
        monkeypatch.setattr(co, name, v)
    if limits[2] == 64:
        monkeypatch.setattr(co, "MAX_BITS", 64)
    rows = texts()
    frame = spark.createDataFrame([(g, t, 1, "x", 3) for g, t in rows], "lang string, text string, n int, phrase string, score int").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(frame, least=20).collect())
    assert got == brute(rows, 20) and len(got) > 20
    assert sorted(tuple(r) for r in co.collocations(frame, least=6, longest=3, percent=80, top=7).collect()) == brute(rows, 6, 7, 3, 80)


def test_states_of_the_automaton():
    """Places, links and lengths against the classes of all phrases by their last places."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        codes = rng.integers(-1, 3, 60).astype(np.int32)
        reach = np.zeros(60, np.int64)
        for i, c in enumerate(codes):
            reach[i] = 0 if c < 0 else 1 + (reach[i - 1] if i else 0)
        ends = defaultdict(set)
        for i in range(60):
            for k in range(1, min(reach[i], 4) + 1):
                ends[tuple(codes[i - k + 1 : i + 1].tolist())].add(i)
        a = co.Automaton(codes, reach, 4)
        seen = {}
        for s in range(len(a.end)):
            for k in range(a.low[s], a.high[s] + 1):
                p = tuple(codes[a.end[s] - k + 1 : a.end[s] + 1].tolist())
                assert len(ends[p]) == a.count[s] and p not in seen
                seen[p] = s
            link, below = a.link[s], p[len(p) - a.low[s] + 1 :]
            assert (link == -1 and not below) or seen[below] == link and a.count[link] > a.count[s]
        assert set(seen) == set(ends)
        for k in range(1, 5):
            e, n = a.phrases(k)
            assert {tuple(codes[i - k + 1 : i + 1].tolist()): c for i, c in zip(e.tolist(), n.tolist(), strict=True)} == {p: len(v) for p, v in ends.items() if len(p) == k}


def test_empty_tables_and_large_counts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).collect() == []
    rows = [("en", "aa bb " * 40_000), ("en", "cc dd. " * 3_000)]
    assert sorted(tuple(r) for r in co.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()) == brute(rows)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op13_collocations(spark, sf_dir).collect())
    assert got == sorted(con.execute(queries.ORACLES["op13_collocations"]).fetchall())
    assert got == brute(con.execute("SELECT lang, text FROM documents").fetchall())
