"""Queries that must read whole texts."""

from tessella.plans import QUERIES


def test_last_span_of_a_long_text(spark, tmp_path):
    """A second word that ends after the 200th character stays whole."""
    spark.createDataFrame([(1, "a" * 150 + " " + "b" * 150 + " c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["surface"] for r in QUERIES["bio_decode"](spark, str(tmp_path)).collect()] == ["a" * 150 + " " + "b" * 150]
