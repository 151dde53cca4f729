import json

from pyspark.sql import functions as F

from tessella.functions import text as TX
from tessella.functions import vectors as V


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text_functions(spark):
    rows = [("  Crème Brûlée ",), ("Áo DÀI đẹp",), ("çöüñ",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", TX.normalize_text("t"))] == ["creme brûlee", "ao dai dep", "çöüñ", ""]
    assert [r[0] for r in values(spark, [("12",), ("12345678901",), ("x1",), (None,)], "t string", TX.normalize_article_id("t"))] == ["0000000012", "12345678901", "x1", ""]
    assert [r[0] for r in values(spark, [("see #123456789 now",), ("no 12345678",)], "t string", TX.extract_article_id("t"))] == ["0123456789", ""]
    assert [r[0] for r in values(spark, [("7",), ("7.9",), ("x",)], "t string", TX.numeric_id("t"))] == [7, 7, None]
    assert [r[0] for r in values(spark, [("Unknown",), ("Red",), (None,)], "t string", TX.clean_value("t"))] == ["", "Red", ""]
    assert values(spark, [("Ab-c é1",)], "t string", TX.words_alnum("t"), TX.words_by_space("t")) == [(["ab", "c", "e1"], ["ab-c", "e1"])]
    assert values(spark, [("n", "", "det", "a", "")], "n string, d string, x string, p string, q string", TX.dense_text("n", "d", "x", ["p", "q"])) == [("n. det. a",)]
    assert [r[0] for r in values(spark, [("a b c d",), ("",), ("w " * 13,)], "t string", TX.length_bucket("t"))] == ["short", None, "long"]
    assert values(spark, [(["the", "red", "of", "coat", "a"],), (["a"],)], "w array<string>", TX.trim_edges(F.col("w"), ["the", "a", "of"])) == [(["red", "of", "coat"],), ([],)]
    assert [r[0] for r in values(spark, [("hello",), ("đẹp",)], "t string", TX.english_only("t"))] == [True, False]
    got = values(spark, [("Menswear", ""), ("Sport", "Womens Trend"), ("Divided", "Divided Basics")], "i string, s string", TX.gender_of("i", "s"))
    assert [r[0] for r in got] == ["Men", "Women", ""]


def test_json_from_prose(spark):
    rows = [('x {"a": 1} then {bad} and {"b": {"c": 2}} end',), ("none",), ('{"k": [1, {"z": 0}]',), (None,)]
    got = [r[0] for r in values(spark, rows, "t string", TX.last_json_object("t"))]
    assert json.loads(got[0]) == {"b": {"c": 2}} and got[1:] == [None, None, None]
    fenced = [('```json\n[{"q": "a", "n": 1}, {"n": 2}]\n```',), ("nothing",)]
    assert [len(r[0]) for r in values(spark, fenced, "t string", TX.json_rows("t", "q string, n int", ["q"]))] == [1, 0]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>", V.norm(a), V.cosine(a, b), V.l2_normalize(b), V.is_finite(a))
    assert got == [(5.0, 0.0, [0.0, 0.0], True), (1.0, 1.0, [1.0, 0.0], True)]
    one = values(spark, [([1.0, 2.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, m array<double>", V.masked_score(a, b, F.col("m")), V.translation_score(a, b, F.col("m")))
    assert one == [(5.5, -8.0)]
    assert not values(spark, [([float("nan")],)], "a array<double>", V.is_finite(a))[0][0]
