import pytest
from test_near_dedup import brute
from test_packing_tokens import check_packed
from test_secret_scan import plain

import corpus_pipeline as cp
from tessella.llm import decontaminate, queries
from tessella.llm.shared import materialize


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), "test"))
        if name != cp.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns and kept[-1].schema.simpleString() == docs.schema.simpleString()
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] <= ids[0] and len(ids[1]) > 0.7 * len(ids[0])
    want = brute([(r["doc_id"], r["text"]) for r in kept[1].collect()], 5, 80)
    assert ids[2] == {i for i, (_, c) in want.items() if i == c}
    items = [decontaminate.normalize(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in kept[2].collect() if not any(i in decontaminate.normalize(r["text"]) for i in items)}
    assert ids[3] == clean
    before, after = ({r["doc_id"]: r for r in k.collect()} for k in kept[3:5])
    assert set(before) == set(after)
    for i, r in after.items():
        assert plain(r["text"]) == []
        assert r["n_chars"] == len(r["text"]) if plain(before[i]["text"]) else r["text"] != "" or before[i]["text"] == ""
    check_packed(kept[4].collect(), kept[5].collect(), queries.PACK_CAPACITY)


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test")
    key = lambda rows: sorted(map(str, rows))
    assert key(cp.run(spark, sf_dir).collect()) == key(docs.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, label int, row_key string"
PROSE = "The committee met on Tuesday to discuss the plan for the harbour, and most members agreed that it should go on."


def odd_rows():
    texts = [None, "", " ", "x", PROSE, PROSE, PROSE + " token=abcdefghijklmnop", PROSE.replace("Tuesday", "Monday"), "key: AKIA" + "A" * 20, "word " * 60_000, "1 é 😀 0123456789abcdef0123"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "a", 1, "k") for i, t in enumerate(texts)]
    rows += [(None, t, None, None, None, None, None, None) for t in texts] + rows[4:7]
    return rows


@pytest.mark.parametrize("stage", range(len(cp.STAGES)))
def test_odd_tables(spark, tmp_path, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the plan for the harbour and most members agreed"), (2, None), (None, "nothing of the kind is in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    name, f = cp.STAGES[stage]
    got = f(spark, docs, str(tmp_path)).collect()
    none = f(spark, docs.limit(0), str(tmp_path))
    assert none.collect() == []
    if stage == len(cp.STAGES) - 1:
        check_packed([r for r in docs.collect() if r["doc_id"] is not None][:11], [r for r in f(spark, spark.createDataFrame(odd_rows()[:11], SCHEMA), str(tmp_path)).collect()], queries.PACK_CAPACITY)
        assert len({(r["doc_id"], r["segment"]) for r in got}) and sum(r["length"] for r in got) == sum(len((r["text"] or "").split()) for r in docs.collect())
        return
    assert none.columns == docs.columns
    key = lambda r: tuple(r)[:2]
    before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in got]
    if name == "secret masking":
        assert len(after) == len(before) and all(plain(t[1]) == [] for t in after)
        assert sorted(map(str, (t for t in before if not plain(t[1])))) == sorted(map(str, (t for t in after if "[secret]" not in (t[1] or ""))))
    else:
        assert set(map(str, after)) <= set(map(str, before))
    if name == "near-duplicate removal":
        named = [t for t in before if t[0] is not None]
        want = brute([(i, t[1]) for i, t in enumerate(named)], 5, 80)
        least = {}
        for i, (_, c) in want.items():
            least[c] = min(least.get(c, 1 << 60), named[i][0])
        assert sorted(t[0] for t in after if t[0] is not None) == sorted(named[i][0] for i, (n, c) in want.items() if n == 0 or least[c] == named[i][0])
        assert sum(t[0] is None for t in after) == 11
    if name == "benchmark decontamination":
        assert not any("harbour" in (t[1] or "") for t in after) and len(after) == sum("harbour" not in (t[1] or "") for t in before)


def test_secrets_of_null_and_repeated_ids_are_masked(spark):
    a, b = "token=abcdefghijklmnop z", "other words here, then token=ponmlkjihgfedcba"
    texts = [(None, a), (None, b), (1, a), (1, b), (1, "plain"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.mask_secrets(spark, docs, "").collect()
    assert len(got) == len(texts) and all(plain(r["text"] or "") == [] and r["n_chars"] == len(r["text"] or "") for r in got)
    assert sorted(str(r["doc_id"]) for r in got if "[secret]" in (r["text"] or "")) == ["1", "1", "None", "None"]
    assert sum("other words here" in (r["text"] or "") for r in got) == 2 and sum(r["text"] == "plain" for r in got) == 1
