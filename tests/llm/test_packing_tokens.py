import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing, queries, token_output

VOCAB = f"{queries.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


def slow_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= max(lengths[i], 1) and not (sources[i] >= 0 and sources[i] in b["s"]) and not (clusters[i] >= 0 and clusters[i] in b["c"])]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        out[i] = (k, capacity - bins[k]["left"])
        bins[k]["left"] -= lengths[i]
        bins[k]["s"].add(sources[i])
        bins[k]["c"].add(clusters[i])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(-1, 4), st.integers(-1, 6)), max_size=60))
def test_best_fit_is_the_tightest_compatible_bin(items):
    got = packing.best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 20)
    assert got == slow_best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_segment_tree_finds_the_tightest_bin(lengths):
    bins = token_output.best_fit_decreasing(lengths, 32)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    left = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [x for x in left if x >= lengths[i]]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - lengths[i])
        else:
            left.append(32 - lengths[i])
    assert sorted(32 - sum(lengths[i] for i in b) for b in bins) == sorted(left)


def check_packed(docs, rows, capacity):
    words = {d["doc_id"]: len((d["text"] or "").split()) for d in docs}
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append(r)
    source = {d["doc_id"]: d["source"] for d in docs}
    text = {d["doc_id"]: d["text"] for d in docs}
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == words
    for members in bins.values():
        spans = sorted((r["bin_offset"], r["length"]) for r in members)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= capacity
        named = [source[r["doc_id"]] for r in members if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
        texts = [text[r["doc_id"]] for r in members if text[r["doc_id"]]]
        assert len(texts) == len(set(texts))


def test_pack_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check_packed(docs, queries.op4_best_fit_packing(spark, sf_dir).collect(), queries.PACK_CAPACITY)


def test_pack_odd_rows(spark):
    rows = [(0, None, "a"), (1, "", None), (2, "w " * 5000, "a"), (3, "same", "a"), (4, "same", None), (5, "same", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, bin int")
    check_packed(docs.collect(), packing.pack(docs, capacity=2048).collect(), 2048)
    assert packing.pack(docs.limit(0)).collect() == []


TEXTS = [None, "", " ", "  a  b", "a b", " lead", "trail ", "x\ny z", "x \n y", "tab\t a", "nb sp x y", "naïve 😀 don't 123 4,5!!", "word " * 3000, "\x1c a \x85 b", "a b\n", "q" * 9000]


def test_tokens_equal_the_library_and_round_trip(spark):
    tok = token_output.Tokenizer(token_output.read_bytes(spark, VOCAB))
    for t in TEXTS[1:]:
        assert np.frombuffer(tok.encode(t), tok.dtype).tolist() == tok.encoding.encode_ordinary(t), repr(t)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    unpacked(spark, docs, token_output.pack_tokens(docs, VOCAB, capacity=512, block_tokens=2000).collect(), 512)
    assert token_output.pack_tokens(docs.limit(0), VOCAB).collect() == []


def unpacked(spark, docs, rows, capacity):
    tok = token_output.Tokenizer(token_output.read_bytes(spark, VOCAB))
    parts = {}
    for r in rows:
        ids, cu = np.frombuffer(r["ids"], tok.dtype), r["cu_seqlens"]
        assert len(ids) == capacity and cu[-1] == r["n_tokens"] <= capacity and not ids[cu[-1] :].any()
        assert hashlib.sha256(ids[: cu[-1]].tobytes()).hexdigest() == r["sha256"]
        where = np.frombuffer(r["positions"], "<u2")
        assert len(where) == capacity and where.tolist() == token_output.positions(cu).tolist() + [0] * (capacity - cu[-1])
        for d, k, a, b in zip(r["doc_ids"], r["segments"], cu, cu[1:]):
            assert (d, k) not in parts
            parts[d, k] = ids[a:b].tobytes()
    whole = defaultdict(bytes)
    for d, k in sorted(parts):
        whole[d] += parts[d, k]
    for d in docs.collect():
        assert tok.decode(whole[d["doc_id"]]) == (d["text"] or "")


def test_token_query_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = queries.op9_token_output(spark, sf_dir)
    unpacked(spark, docs, packed.collect(), queries.PACK_CAPACITY)
    assert token_output.fill(packed, queries.PACK_CAPACITY).first()["fill"] > 0.95


def test_written_matrix(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id long, text string")
    token_output.write_packed(token_output.pack_tokens(docs, VOCAB, capacity=16, pad_id=7), str(tmp_path / "m"))
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        n = r["cu_seqlens"][-1]
        assert len(r["ids"]) == 32 and set(np.frombuffer(r["ids"], "<u2")[n:]) <= {7}
        assert np.frombuffer(r["positions"], "<u2")[:n].tolist() == token_output.positions(r["cu_seqlens"]).tolist()
    assert token_output.positions([0, 3, 5]).tolist() == [0, 1, 2, 0, 1]
    assert token_output.fill(token_output.pack_tokens(docs.limit(0), VOCAB), 16).first()["fill"] == 1.0


@pytest.mark.parametrize("kind", ["string", "decimal(5,0)", "short", "date"])
def test_pack_ids_of_any_type(spark, kind):
    docs = spark.sql(f"SELECT CAST({"date_add(current_date(), CAST(id AS INT))" if kind == "date" else "id"} AS {kind}) AS doc_id, 'w x' AS text, 's' AS source FROM range(5) UNION ALL SELECT NULL, 'y', NULL")
    got = packing.pack(docs).collect()
    assert len(got) == 6 and {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}


def test_bins_are_filled(spark, sf_dir):
    """Residual room is small where no source holds more than a bin's share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("source").selectExpr("doc_id", "text", "cast(doc_id as string) AS source")
    rows = packing.pack(docs, capacity=2048).collect()
    bins = {r["bin"] for r in rows}
    assert sum(r["length"] for r in rows) > 0.9 * 2048 * len(bins)
