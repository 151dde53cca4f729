from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import decontaminate as dc
from tessella.llm import queries


def slow_distance(pattern, text):
    """Sellers' dynamic programme."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        old, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            old, row[i] = row[i], min(old + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=14), min_size=1, max_size=4), st.text("abc ", max_size=60), st.sampled_from([0.0, 0.1, 0.3, 0.5]))
def test_matches_brute_force(items, text, rate):
    got = dc.Matcher(list(enumerate(items)), rate, 1).match(text)
    want = [(i, d) for i, x in enumerate(items) if (d := slow_distance(x, text)) <= min(int(rate * len(x)), len(x) - 1)]
    assert got == want


def test_short_items_leak_only_as_whole_texts():
    m = dc.Matcher([(1, "short one"), (2, "a longer item of some words")], 0.2)
    assert m.match("short one") == [(1, 0)] and m.match("shrt one") == [(1, 1)] and m.match("a short one") == [] and m.match("") == []


ITEM = "The quick brown fox jumps over the lazy dog while the band plays on and on until morning comes."


def test_rows(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short"), (1, ITEM), (5, "zz " * 30)], "item_id long, text string")
    docs = [(0, None), (1, ""), (2, f"x {ITEM.upper()} y"), (3, "pre " + ITEM.replace("lazy", "lzay").replace("fox ", "fox\n\n")), (4, "short and clean"), (5, "word " * 20000 + ITEM), (5, "word " * 20000 + ITEM)]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, item_id string, leaked_items int")
    for block in (1 << 20, 40):
        got = sorted((r["doc_id"], r["contaminated"], tuple(r["item_ids"]), tuple(r["distances"])) for r in dc.leaks(frame, bench, block_bytes=block).collect())
        assert got == [(0, False, (), ()), (1, False, (), ()), (2, True, (1,), (0,)), (3, True, (1,), (2,)), (4, False, (), ()), (5, True, (1,), (0,)), (5, True, (1,), (0,))]
    kept = dc.remove_leaks(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4]
    assert dc.leaks(frame.limit(0), bench).collect() == [] and not any(r["contaminated"] for r in dc.leaks(frame, bench.limit(0)).collect())


def test_query_against_brute_force(spark, sf_dir):
    """Every text against every item: near matches too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = {r["item_id"]: dc.normalize(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    masks = {i: dc._masks(t) for i, t in items.items()}
    got = {r["doc_id"]: r for r in queries.op7_decontaminate(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        text = dc.normalize(d["text"])
        want = {}
        for i, t in items.items():
            e = int(dc.ERROR_RATE * len(t))
            if t in text:
                want[i] = 0
            elif len(text) >= len(t) - e and len(text) <= 20_000:
                n = dc.myers(masks[i], len(t), text, e)
                if n <= e:
                    want[i] = n
        found = dict(zip(got[d["doc_id"]]["item_ids"], got[d["doc_id"]]["distances"], strict=True))
        assert found == want if len(text) <= 20_000 else want.items() <= found.items()


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", min_size=1, max_size=20), st.text("abcd", max_size=40))
def test_myers_is_the_dynamic_programme(pattern, text):
    assert dc.myers(dc._masks(pattern), len(pattern), text, len(pattern)) == slow_distance(pattern, text)
