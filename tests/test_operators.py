import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import audits, dense, filters, fusion, graph, metrics, nlu, profiles, rules, sessions
from tessella.sources import tables


def test_npmi_bounds_and_symmetry(spark):
    rng = random.Random(2)
    lines = [(c, d, rng.randrange(12)) for c in range(20) for d in range(3) for _ in range(rng.randrange(1, 9))]
    found = graph.baskets(spark.createDataFrame(lines, "c int, d int, i int"), "c", "d", "i")
    assert all(2 <= len(r["items"]) <= 10 and r["items"] == sorted(set(r["items"])) for r in found.collect())
    for r in graph.edges(found, min_count=1, threshold=-1.0, scale=1.0).collect():
        assert -1 - 1e-9 <= r["weight"] <= 1 + 1e-9 and r["item_a"] < r["item_b"]
    both = graph.adjacency(graph.edges(found, method="cobuy", min_count=1)).collect()
    assert {(r.item_a, r.item_b, r.weight) for r in both} == {(r.item_b, r.item_a, r.weight) for r in both}


def walk(neighbours, limit, per_type):
    """The neighbours taken one after the other."""
    taken, count = [], {}
    for n, _, t in sorted(neighbours, key=lambda x: (-x[1], x[0])):
        if t and count.get(t, 0) >= per_type:
            continue
        taken.append(n)
        count[t] = count.get(t, 0) + 1
        if len(taken) == limit:
            break
    return taken


def test_diverse_neighbours_equal_a_walk(spark):
    rng = random.Random(4)
    meta = [(i, rng.choice(["", "a", "b", "c"])) for i in range(60)]
    adj = [(a, b, float(rng.randrange(6))) for a in range(12) for b in rng.sample(range(12, 60), 25)]
    got = {}
    found = graph.diverse_neighbors(spark.createDataFrame(adj, "item_a int, item_b int, weight double"), spark.createDataFrame(meta, "k int, t string"), key="k", type_col="t", limit=8, per_type=2)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["item_a"], []).append(r["item_b"])
    kind = dict(meta)
    for a in range(12):
        assert got[a] == walk([(b, w, kind[b]) for x, b, w in adj if x == a], 8, 2)


def test_season_clash_drops_a_neighbour(spark):
    meta = spark.createDataFrame([(1, "x", "Spring/Summer"), (2, "x", "Autumn/Winter"), (3, "x", "All year"), (4, "x", None)], "k int, t string, s string")
    adj = spark.createDataFrame([(1, 2, 9.0), (1, 3, 5.0), (1, 4, 1.0)], "item_a int, item_b int, weight double")
    assert [r["item_b"] for r in graph.diverse_neighbors(adj, meta, key="k", type_col="t", season_col="s").orderBy("rank").collect()] == [3, 4]


def test_relaxation_takes_the_tightest_tier(spark):
    c = spark.createDataFrame([(1, 10, 0.5, False, True), (1, 11, 0.9, False, True), (1, 12, 0.1, False, False), (2, 13, 0.2, True, True), (2, 14, 0.9, False, True)], "query int, id int, score double, a boolean, b boolean")
    got = [(r["query"], r["id"], r["tier"]) for r in filters.relax(c, [F.col("a"), F.col("b"), F.lit(True)], 5).orderBy("query", "rank").collect()]
    assert got == [(1, 11, 2), (1, 10, 2), (2, 13, 1)]


def test_rrf_ignores_the_scale_of_scores(spark):
    rows = [(1, d, float(s), r, b) for b in ("x", "y") for r, (d, s) in enumerate([(5, 9), (6, 4), (7, 1)] if b == "x" else [(7, 3), (5, 2)], 1)]
    df = spark.createDataFrame(rows, "query int, doc int, score double, rank int, branch string")
    assert fusion.rrf(df, 10).collect() == fusion.rrf(df.withColumn("score", F.col("score") * 100), 10).collect()
    assert [r["doc"] for r in fusion.hybrid({"x": df.where("branch = 'x'")}, 2).orderBy("rank").collect()] == [5, 6]


def test_metrics(spark):
    same = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 0)], "s double, y int")
    assert metrics.auc(same, "s", "y").first()["auc"] == 0.5
    ranked = spark.createDataFrame([(1, d, d) for d in range(1, 11)], "query int, doc int, rank int")
    truth = spark.createDataFrame([(1, 2), (1, 4), (1, 99)], "query int, doc int")
    recalls = [metrics.at_k(ranked, truth, k).first()["recall"] for k in (1, 2, 5, 10)]
    assert recalls == sorted(recalls) and recalls[-1] == pytest.approx(2 / 3)
    assert metrics.at_k(ranked, truth, 5).first()["average_precision"] == pytest.approx((1 / 2 + 2 / 4) / 3)
    grades = spark.createDataFrame([(1, d, g) for d, g in ((1, 2), (2, 1), (3, 0))], "query int, doc int, grade int")
    assert metrics.ndcg(ranked, grades, 10).first()["ndcg"] == pytest.approx(1.0)


def test_profiles(spark):
    w = [r[0] for r in spark.createDataFrame([(1, 1), (1, 3), (3, 3)], "p int, n int").select(profiles.recency_weight(F.col("p"), F.col("n"))).collect()]
    assert w == pytest.approx([math.exp(-2), math.exp(-2), 1.0])


def test_filters_on_unknown_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    f = filters.compile_filters
    assert df.where(f({"absent": "1"}, {}, df.columns)).count() == 0
    assert df.where(f({}, {"absent": "1", "v": "x"}, df.columns)).count() == 1
    assert df.where(f({"k": ["a", "b"], "v": ""}, {}, df.columns)).count() == 2


def test_slot_rules(spark):
    df = spark.createDataFrame([("top", "bottom", True), ("bottom", "top", True), ("top", "dress", False), ("accessory", "accessory", True)], "a string, b string, ok boolean")
    assert df.where(rules.slot_pair_allowed(F.col("a"), F.col("b")) != F.col("ok")).count() == 0
    c = spark.createDataFrame([("Red", "Pink", True), ("Red", "Dark Green", False), ("Blue", "Pink", True), ("", "Red", True), ("Black", "Red", True)], "a string, b string, ok boolean")
    assert c.where(rules.colours_compatible(F.col("a"), F.col("b"), F.lit(""), F.lit("")) != F.col("ok")).count() == 0
    s = spark.createDataFrame([("Winter coat", "beach", False), ("all-year", "beach", True), ("", "hot", True)], "a string, b string, ok boolean")
    assert s.where(rules.seasons_compatible(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_content_filter_modes(spark):
    r = {k: F.col(k) for k in {n for m in rules.MODES.values() for n in m}}
    df = spark.createDataFrame([tuple(k != "season" for k in r)], ", ".join(f"{k} boolean" for k in r))
    assert [df.select(rules.content_filter(r, m)).first()[0] for m in ("none", "minimal", "standard", "legacy", "redesigned")] == [True, True, True, False, True]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30), st.sampled_from([0.0, 0.3, 0.5, 1.0]))
def test_nearest_rank(spark, xs, q):
    got = graph.nearest_rank(spark.createDataFrame([(x,) for x in xs], "v double"), "v", [q]).first()["v"]
    assert got == sorted(xs)[min(int(q * len(xs)), len(xs) - 1)]


def test_bio_round_trip(spark):
    rows = spark.createDataFrame([(1, ["a", "dark", "blue", "coat"], ["dark", "blue"])], "id int, t array<string>, s array<string>")
    tagged = rows.select("id", "t", nlu.bio_tags(F.col("t"), F.col("s"), "COL").alias("g"))
    assert tagged.first()["g"] == ["O", "B-COL", "I-COL", "O"]
    flat = tagged.select("id", F.posexplode(F.arrays_zip("t", "g")).alias("pos", "x")).select("id", "pos", F.col("x.t").alias("token"), F.col("x.g").alias("tag"))
    assert [tuple(r) for r in nlu.bio_spans(flat, "id").collect()] == [(1, "COL", "dark blue")]


def test_sessions(spark):
    turns = spark.createDataFrame([(1, 1, "x", False, "a", ""), (1, 2, "", False, "", "t"), (1, 3, "", True, "", ""), (1, 4, "y", True, "b", "")], "s int, n int, anchor string, clear boolean, intent string, type string")
    got = [(r["anchor"], r["last_intent"], r["last_type"]) for r in sessions.fold_turns(turns, "s", "n").orderBy("n").collect()]
    assert got == [("x", "a", None), ("x", "a", "t"), (None, "a", "t"), ("y", "b", "t")]
    ids = spark.createDataFrame([(1, ""), (2, "k")], "r int, s string").select(sessions.session_id(F.col("s"), F.col("r"))).collect()
    assert [r[0] for r in ids] == ["anon-1", "k"]


def test_routing(spark):
    df = spark.createDataFrame([(nlu.SIMILAR, True, True, ""), (nlu.CHAT, False, False, "")], "i string, a boolean, v boolean, l string")
    got = df.select(nlu.route(F.col("i"), F.col("a"), F.lit(False), F.col("l"), variant_cue=F.col("v"), refinement=F.lit(False)), nlu.direct_response(F.col("i"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(nlu.VARIANT, None), (nlu.CHAT, "chit_chat")]
    more = spark.createDataFrame([(nlu.SIMILAR, True, False, nlu.GRAPH), (nlu.SIMILAR, False, False, nlu.GRAPH), (nlu.CHAT, False, True, "")], "i string, a boolean, m boolean, l string")
    got = more.select(nlu.route(F.col("i"), F.col("a"), F.col("m"), F.col("l"), variant_cue=F.lit(False), refinement=F.lit(True))).collect()
    assert [r[0] for r in got] == [nlu.GRAPH, nlu.SIMILAR, nlu.SIMILAR]


def test_upsert_and_patch(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, dense.upsert(t, c, "k").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, tables.patch(t, c.where("seq = 2").drop("seq"), "k", ["v"]).collect())) == [(1, "a"), (2, "y")]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("7", "n"), ("", "skip"), ("12345678901", None)], "id string, name string")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), ["id", "name"], id_col="id").collect())) == [("0000000007", "n"), ("12345678901", "")]
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "id string, name string").count() == 3
    (tmp_path / "log.txt").write_text('{\n "event": "a",\n "n": 1\n}\n\n{\n "event": "b",\n "n": 2\n}\n')
    assert [tuple(r) for r in tables.read_blocks(spark, str(tmp_path / "log.txt"), "event string, n int").collect()] == [("a", 1), ("b", 2)]
    assert tables.append_missing(df, str(tmp_path / "p"), "id") == 3
    assert tables.append_missing(df.limit(2), str(tmp_path / "p"), "id") == 0
    built = []
    for _ in range(2):
        out = tables.cached(spark, str(tmp_path / "cache"), {"b": 1, "a": 2}, lambda: built.append(1) or df)
    assert out.count() == 3 and len(built) == 1
    tables.write_graph(spark.createDataFrame([(1, 2, 3.0)], "item_a int, item_b int, weight double"), str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).count() == 2
    assert tables.valid_vectors(spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, float("inf")],)], "v array<double>"), "v", 2).count() == 1


def test_audits(spark):
    a = spark.createDataFrame([("Red coat",), ("blue",)], "q string")
    assert [r[0] for r in audits.without_leaks(a, spark.createDataFrame([("red COAT",)], "q string"), "q").collect()] == ["blue"]
    r = F.array(F.struct(F.lit("A").alias("t")), F.struct(F.lit("B").alias("t")))
    one = spark.range(1).select(*[audits.check_results(r, k, field="t", values=["A"], least=0.5).alias(k) for k in ("min", "all_in", "none_in", "frac_in")]).first()
    assert tuple(one) == (True, False, False, True)


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g int")
    asked = df.where("id < 9").withColumnRenamed("id", "query")
    one = [dense.knn(df.repartition(n), asked, 5, id_col="id", vector_col="v").orderBy("query", "rank").collect() for n in (1, 7)]
    assert one[0] == one[1]


LEXICON = {
    "colour_group": {"black": "Black", "navy": "Dark Blue", "red": "Red", "light blue": "Light Blue", "dark blue": "Dark Blue", "pink": "Pink", "white": "White"},
    "product_type": {"dress": "Dress", "jeans": "Trousers", "boots": "Boots", "sneakers": "Sneakers", "jacket": "Jacket", "skirt": "Skirt"},
    "fit": {"skinny": "Skinny fit"},
}


def test_lexicon_and_negation(spark):
    rows = [
        (1, "a black dress for a wedding"), (2, "jeans that aren't too skinny"), (3, "no, not any boots, only sneakers in navy"), (4, "nothing in black, a white dress"),
        (5, "light blue or dark blue jacket, no wool"), (6, "a jacket however not a red one"), (7, ""), (8, "show me a skirt but without pink"),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    lex = nlu.lexicon_frame(spark, LEXICON)
    yes = sorted(tuple(r)[:3] for r in nlu.extract_attributes(df, "id", "text", lex).collect())
    no = sorted(tuple(r)[:3] for r in nlu.extract_attributes(df, "id", "text", lex, negative=True).collect())
    assert yes == [
        (1, "colour_group", "Black"), (1, "product_type", "Dress"), (2, "product_type", "Trousers"), (3, "colour_group", "Dark Blue"), (3, "product_type", "Sneakers"), (4, "colour_group", "White"), (4, "product_type", "Dress"),
        (5, "colour_group", "Light Blue"), (5, "product_type", "Jacket"), (6, "product_type", "Jacket"), (8, "product_type", "Skirt"),
    ]
    assert no == [(2, "fit", "Skinny fit"), (3, "product_type", "Boots"), (4, "colour_group", "Black"), (6, "colour_group", "Red"), (8, "colour_group", "Pink")]


def test_types_that_name_none(spark):
    df = spark.createDataFrame([("gala attire",), ("Something nice",), ("looks",), ("Dress",)], "t string")
    assert [r[0] for r in df.select(nlu.usable_type(F.col("t"))).collect()] == ["", "", "looks", "Dress"]


def test_lexicon_of_values(spark):
    got = nlu.lexicon_of(spark.createDataFrame([("c", "Dark Blue"), ("c", "dark blue"), ("c", ""), ("t", "T-shirt"), ("t", None)], "field string, value string"))
    assert sorted((r["field"], r["surface"], r["value"], r["n_words"]) for r in got.collect()) == [("c", "dark blue", "Dark Blue", 2), ("t", "t shirt", "T-shirt", 2)]


def test_json_logs_reports_and_buckets(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"id": 1,\n "v": "a"}')
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "o.json"), "id int, v string").collect()] == [(1, "a")]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    for _ in range(2):
        tables.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("logged_at RLIKE '^[0-9]{4}-.*Z$'").count() == 4
    audits.markdown(rows, "Title").coalesce(1).write.text(str(tmp_path / "report"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())
    assert text.splitlines()[0] == "## Title" and "| id | v |" in text and "| 1 | x |" in text and "| 2 |  |" in text
    tables.write_bucketed(rows, "bucketed_rows", "id", 2)
    assert spark.table("bucketed_rows").count() == 2
    spark.sql("DROP TABLE bucketed_rows")
    for kind in ("orc", "parquet"):
        rows.write.format(kind).save(str(tmp_path / kind))
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2


def test_a_kept_table_follows_its_sources(spark, tmp_path):
    import os

    from tessella.sources import stage

    src, built = tmp_path / "src.txt", []
    src.write_text("a")
    df = lambda: built.append(1) or spark.read.text(str(src))
    for _ in range(2):
        assert stage.kept(spark, "kept-test", [str(src)], df).count() == 1
    src.write_text("a\nb")
    os.utime(src, (1, 1))
    assert stage.kept(spark, "kept-test", [str(src)], df).count() == 2 and len(built) == 2


def test_settings():
    from tessella.settings import Settings

    assert Settings.from_env({}) == Settings() and Settings.from_env({"TESSELLA_LIMIT": "5", "TESSELLA_BM25_B": "0.5"}) == Settings(limit=5, bm25_b=0.5)


def test_learned_blend_and_item_vectors(spark):
    rng = random.Random(3)
    rows = [(float(x), rng.random(), int(x > 0.6)) for x in (rng.random() for _ in range(200))]
    model = profiles.learned_blend(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", "a")
    got = model.transform(spark.createDataFrame(rows, "a double, b double, y int")).select("y", "prediction").collect()
    assert sum(r["y"] == r["prediction"] for r in got) > 180
    baskets = spark.createDataFrame([([1, 2],), ([3, 4],)] * 40, "items array<int>")
    assert profiles.item_vectors(baskets, size=8).count() == 4


def test_channels_of_a_query(spark):
    from tessella.functions import text as TX
    from tessella.functions import vectors as V

    df = spark.createDataFrame([("red coat", [3.0, 4.0]), ("", None)], "t string, i array<double>")
    a, b = df.select(V.query_channels(F.col("t"), F.col("i"), TX.words_alnum("t"), 16).alias("c")).select("c.*").collect()
    assert a["image"] == [0.6, 0.8] and a["terms"] == ["red", "coat"] and abs(sum(x * x for x in a["dense"]) - 1) < 1e-9
    assert b["image"] is None and b["terms"] is None and b["dense"] == df.limit(1).select(V.hashed_vector(F.array(F.lit("fashion"), F.lit("item")), 16)).first()[0]
    assert df.select(TX.without_words("t", F.array(F.lit("coat")))).first()[0] == "red"


def test_taste_signals(spark):
    """By hand; no vector and no past give 0."""
    past = spark.createDataFrame([(1, [1.0, 0.0], 1, 2), (1, [0.0, 1.0], 2, 2)], "customer long, vector array<double>, position long, n long")
    cands = spark.createDataFrame([(1, 5, [0.6, 0.8]), (1, 6, None), (2, 5, [0.6, 0.8])], "customer long, item long, vector array<double>")
    got = {(r["customer"], r["item"]): (r["recency"], r["similar"]) for r in profiles.taste_signals(cands, past).collect()}
    old, new = math.exp(-2), 1.0
    want = (0.6 * old + 0.8 * new) / math.hypot(old, new)
    assert got[1, 5] == (pytest.approx(want, abs=1e-8), 0.8)
    assert got[1, 6] == got[2, 5] == (0.0, 0.0)


def test_model_against_rules_without_errors(spark):
    r = audits.model_against_rules(spark.createDataFrame([("a", "a", "a", 0.5)], "g string, m string, f string, c double"), "g", "m", "f", "c").first()
    assert (r["n"], r["disagree"], r["right_mean"], r["right_least"], r["wrong_mean"], r["wrong_most"]) == (1, 0, 0.5, 0.5, 0.0, 0.0)
