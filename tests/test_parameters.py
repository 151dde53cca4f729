"""Parameter tables, resolution in stages, sketches and stateful sessions against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import nlu, rules, scoring, sketches
from tessella.settings import Settings
from tessella.streaming import conversations as cv


def test_masks_and_relations_with_defaults(spark):
    rows = spark.createDataFrame([(1, "a", "b", [1.0, 2.0], [3.0, 1.0]), (2, "b", "a", [1.0, 2.0], [3.0, 1.0]), (3, "a", "a", [1.0, 0.0], [1.0, 1.0])], "id int, ka string, kb string, va array<double>, vb array<double>")
    masks = spark.createDataFrame([("a", "b", [0.0, 5.0])], "kind_a string, kind_b string, mask array<double>")
    relations = spark.createDataFrame([("b", "a", [1.0, -1.0])], "kind_a string, kind_b string, relation array<double>")
    got = {r["id"]: (r["masked"], r["translated"]) for r in scoring.translated(scoring.masked(rows, masks), relations).collect()}
    gate = 1 / (1 + math.exp(-5))
    want = {1: (1.5 + 2 * gate, -5.0), 2: (1.5 + 2 * gate, -1.0), 3: (0.5, -1.0)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_aspects(spark):
    rows = spark.createDataFrame([(1, "x", "y", 2.0), (2, "x", "?", 1.0)], "id int, a string, b string, residual double")
    aspects = spark.createDataFrame([("colour", "x", [3.0, 0.0]), ("colour", "y", [1.0, 1.0]), ("other", "y", [1.0, 0.0])], "aspect string, value string, vector array<double>")
    got = {r["id"]: r["aspects"] for r in scoring.aspect_score(scoring.aspect_affinities(rows, aspects, {"colour": ("a", "b")}), {"residual": 0.0, "colour": 1.0}).collect()}
    soft = lambda w: math.log1p(math.exp(w))
    assert got == pytest.approx({1: 2 * soft(0) + soft(1) / math.sqrt(2), 2: soft(0)})


def test_a_stage_sees_what_is_left(spark):
    seen = []

    def stage(name, known):
        def run(rest):
            seen.append((name, sorted(r["value"] for r in rest.collect())))
            return rest.join(spark.createDataFrame(known, "value string, resolved string"), "value")

        return name, run

    asked = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",), ("d",)], "value string")
    out = nlu.resolve_chain(asked, [stage("one", [("a", "A")]), stage("two", [("a", "late"), ("b", "B"), ("c", None)])])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "A", "one"), ("b", "B", "two"), ("c", None, "unresolved"), ("d", None, "unresolved")]
    assert seen == [("one", ["a", "b", "c", "d"]), ("two", ["b", "c", "d"])]


def test_stages(spark):
    table = spark.createDataFrame([("Red", "R"), ("dark blue", "D"), ("blue", "B"), ("red", "Q")], "surface string, value string")
    asked = spark.createDataFrame([("RED",), ("a blue red hat",), ("Blue",), ("none",)], "value string")
    run = lambda s: {r["value"]: r["resolved"] for r in s(asked).collect()}
    assert run(nlu.by_name(table)) == {"RED": "Q", "Blue": "B"}
    assert run(nlu.by_word(table)) == {"RED": "Q", "a blue red hat": "B", "Blue": "B"}
    vectors = spark.createDataFrame([("RED", [1.0, 0.0]), ("none", [0.1, 0.2])], "value string, vector array<double>")
    centres = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "id long, resolved string, vector array<double>")
    assert run(nlu.by_vector(vectors, centres, least=0.5)) == {"RED": "x"}
    rgb = spark.createDataFrame([("RED", 200, 0, 0), ("Blue", 5, 5, 5)], "value string, r int, g int, b int")
    palette = spark.createDataFrame([("red", 210, 0, 0), ("black", 0, 0, 0), ("also black", 0, 0, 0)], "resolved string, r int, g int, b int")
    assert run(nlu.by_colour(rgb, palette)) == {"RED": "red", "Blue": "also black"}


def test_slots_by_tiers_and_versions(spark, tmp_path):
    rules_ = [(1, "type", "T", 1, "old"), (2, "type", "T", 1, "top"), (2, "group", "G", 1, "bottom"), (2, "word", "jean", 2, "w2"), (2, "word", "shirt", 1, "w1"), (2, "type", "N", 1, None)]
    spark.createDataFrame(rules_, "version int, tier string, key string, rank int, value string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    items = spark.createDataFrame([(1, "T", "G", "shirt"), (2, "x", "G", "shirt"), (3, "N", None, "jean shirt"), (4, None, "", ""), (5, "N", "x", None)], "id int, t string, g string, name string")
    got = {r["id"]: (r["slot"], r["tier"]) for r in rules.slot_from_table(items, table, {"type": "t", "group": "g"}, id_col="id", words=F.split("name", " ")).collect()}
    assert got == {1: ("top", "type"), 2: ("bottom", "group"), 3: ("w1", "word"), 4: ("other", "default"), 5: ("other", "default")}


def test_families(spark):
    filters = spark.createDataFrame([("q", "type", "shoe"), ("q", "type", "bag"), ("r", "colour", "shoe")], "query string, field string, value string")
    families = spark.createDataFrame([("type", "shoe", "sneaker"), ("type", "shoe", "pump"), ("type", "shoe", "pump")], "field string, generic string, member string")
    assert sorted(tuple(r) for r in rules.expand_families(filters, families).collect()) == [("q", "type", "bag"), ("q", "type", "pump"), ("q", "type", "sneaker"), ("r", "colour", "shoe")]


def test_sketches_beyond_what_they_hold(spark):
    """Merged over days: estimates within their bounds, quantiles within the error of ranks."""
    n, users = 200_000, 30_000
    rows = spark.range(n).select(F.expr("date_add(DATE'2024-01-01', cast(id % 10 as int))").alias("day"), (F.col("id") * 7919 % users).alias("u"), (F.col("id") * 104729 % n).cast("double").alias("v"))
    states = sketches.daily(rows, F.col("day"), "u", "v")
    merged = sketches.ranges(states, 10)
    e, low, high = sketches.distinct(F.col("theta"))
    he, hlow, hhigh = sketches.distinct_hll(F.col("hll"))
    r = merged.orderBy(F.desc("until")).select("n", e.alias("e"), low.alias("low"), high.alias("high"), he.alias("he"), hlow.alias("hlow"), hhigh.alias("hhigh"), sketches.quantile(F.col("kll"), 0.25).alias("q")).first()
    assert r["n"] == n and r["low"] <= users <= r["high"] and r["hlow"] <= users <= r["hhigh"]
    assert r["low"] < r["e"] < r["high"] and r["high"] - r["low"] < 0.1 * users and abs(r["he"] - users) < 0.03 * users
    assert abs(r["q"] / n - 0.25) <= 2 * sketches.rank_error()


def test_sketches_of_little(spark):
    rows = spark.createDataFrame([("2024-01-01", 1, 5.0), ("2024-01-01", None, None), ("2024-01-03", 1, 1.0), ("2024-01-03", 2, 3.0)], "day string, u long, v double").withColumn("day", F.to_date("day"))
    out = sketches.ranges(sketches.daily(rows, F.col("day"), "u", "v"), 2).select(F.col("until").cast("string").alias("d"), "n", *[c.alias(f"c{i}") for i, c in enumerate(sketches.distinct(F.col("theta")))], sketches.quantile(F.col("kll"), 0.5).alias("m"))
    assert sorted(tuple(r) for r in out.collect()) == [("2024-01-01", 2, 1, 1, 1, 5.0), ("2024-01-03", 2, 2, 2, 2, 1.0)]


def brute_sessions(turns, ttl, most):
    """The same folds in plain Python."""
    out, by = {}, defaultdict(list)
    for t in turns:
        by[(t[0] or "").strip() or f"anon-{t[1]}"].append(t)
    for s, mine in by.items():
        seen = None
        for _, seq, ts, action, value, kind, role, text in sorted(mine, key=lambda t: (t[2], t[1])):
            if seen is None or ts - seen > ttl or action == "reset":
                opened, anchor, last, past = seq, "", "", []
            seen = ts
            if action == "clear":
                anchor = ""
            elif action == "set" and (value or "").strip():
                anchor = value.strip()
            last = kind or last
            if action == "message" and (text or "").strip():
                past = [*past, text.strip()][-most:]
            out[seq] = (s, opened, anchor, last, len(past), past[-1] if past else "")
    return out


def test_sessions_of_a_stream_and_its_restart(spark, tmp_path):
    """Three runs of one stream: state goes on from its checkpoint, and expires by event time."""
    rng = random.Random(2)
    turns, now = [], 1_700_000_000
    for seq in range(240):
        now += rng.choice([0, 60, 600, 4000])
        turns.append((rng.choice(["s1", "s2", " s2 ", "", None]), seq, now, rng.choice(["set", "clear", "reset", "message", "message", "message"]), rng.choice(["i1", "i2", " ", None]), rng.choice(["", None, "dress"]), "user", rng.choice(["hi", " there ", "", None])))
    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema = "session string, seq long, ts timestamp, action string, value string, kind string, role string, text string"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, cv.PROVIDER)
    try:
        for a in range(0, 240, 80):
            part = spark.createDataFrame(turns[a : a + 80], schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
            part.coalesce(1).write.mode("append").parquet(folder)
            stream = cv.session_turns(spark.readStream.schema(schema).parquet(folder), ttl_seconds=7200, history=3, delay="0 seconds")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    got = {r["seq"]: (r["session"], r["opened"], r["anchor"], r["last_kind"], r["history"], r["newest"]) for r in spark.read.parquet(out).collect()}
    assert got == brute_sessions(turns, 7200, 3)


def test_settings_act(monkeypatch):
    assert Settings.from_env({"TESSELLA_BM25_K1": "2.5", "TESSELLA_HISTORY_TURNS": "3"}) == Settings(bm25_k1=2.5, history_turns=3)
    import os
    import subprocess
    import sys

    code = "from tessella.operators import sparse, sessions; print(sparse.K1, sessions.TTL)"
    env = os.environ | {"TESSELLA_BM25_K1": "2.5", "TESSELLA_SESSION_TTL_HOURS": "2"}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.strip() == "2.5 2 hours"
