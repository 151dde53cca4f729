import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import queries
from tessella.llm import substring_dedup as sd


def brute(docs, n=50):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) by id, from every window of every text."""
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - n + 1):
            if first[raw[p : p + n]] < i:
                gone[p : p + n] = True
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[i] = (len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest())
    return out


def check(frame, docs):
    rows = sd.remove_repeats(frame).collect()
    assert len(rows) == len(docs)
    want = brute(docs)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=200).map(str.encode), st.integers(9, 20))
def test_equal_windows(raw, n):
    got = sd.equal_windows(np.frombuffer(raw, np.uint8), n)
    words = [raw[i : i + n] for i in range(len(raw) - n + 1)]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (got[i] == got[j]) == (a == b)


def test_small_cases(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé f\n") for _ in range(n))
    passage, other = text(160), text(90)
    docs = [(0, None), (1, ""), (2, "short"), (3, "x" * 49), (4, "x" * 49), (5, "y" * 50), (6, "y" * 50), (7, "y" * 51)]
    docs += [(20 - i, text(rng.randrange(200)) + passage[rng.randrange(60) :] + text(30)) for i in range(10)]
    docs += [(30 + i, passage[:100] + passage[40:] + other) for i in range(4)]
    docs += [(40, text(5000)), (41, "z" * 9000), (42, "z" * 9001 + other), (43, "\x00" * 60), (44, "\x00" * 70)]
    docs += [(50 + i, "q" + passage + other) for i in range(3)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int")
    check(frame, docs)
    again = sd.remove_repeats(frame, with_text=True).where("doc_id = 42").first()
    assert len(again["kept"]) == again["n_bytes"] - again["n_removed"] and again["n_removed"] > 8900


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert sd.remove_repeats(spark.createDataFrame([], schema)).collect() == []
    rows = sd.remove_repeats(spark.createDataFrame([(None, "w" * 80), (1, "w" * 80), (1, "w" * 80), (None, None)], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 0)]


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(docs)
    for r in queries.op10_suffix_dedup(spark, sf_dir).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
