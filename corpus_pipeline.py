"""The corpus pipeline: classify, drop near duplicates, decontaminate, mask secrets, pack.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a frame; all but the
last return the columns of documents. Each stage's rows are written as Parquet in the shared folder and read again.
Empty tables give empty results, further columns of documents stay as they are whatever their names, and texts of any
length are worked on whole. What a stage does with nulls and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, near_dedup, packing, quality, secret_scan
from tessella.llm.queries import PACK_CAPACITY
from tessella.llm.shared import IdFilter, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labelled documents outside the held-out third.

    A null text is judged like an empty one, a null id has no label and is judged like any other, repeated rows are
    judged alike. Without labels every score is 0.5, and all rows stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more.

    The least id stays. Rows without words or id are no duplicates and stay; rows repeated under one id stay together.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, within its error budget, go. Null and empty texts hold none and stay."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked in the text; n_chars follows. Documents without one stay as they are.

    Rows are told apart by id and text, so null and repeated ids lose their own secrets and nothing else; a null text
    has none.
    """
    key, spans = decontaminate.fresh(docs.columns, "row_key"), decontaminate.fresh(docs.columns, "secret_spans")
    keyed = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text"))))
    found = secret_scan.scan_secrets(keyed, id_col=key).where(F.size("spans") > 0).groupBy(key).agg(F.first("spans").alias(spans))
    found = materialize(found, "secrets-found")
    # only rows that may hold one are shuffled
    maybe, clean = IdFilter(found.select(key)).split(keyed, key)
    joined = maybe.join(found, key, "left")
    hit = F.col(spans).isNotNull()
    out = joined.withColumn("text", F.when(hit, secret_scan.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns).unionByName(out.select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments of documents in bins; no bin holds two documents of one source or two copies of one text.

    A null source conflicts with nothing, null and empty texts are segments of length 0, repeated rows are items of
    their own.
    """
    return packing.pack(docs, capacity=PACK_CAPACITY)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret masking", mask_secrets),
    ("best-fit packing", pack),
]

#: A learned classifier and hash signatures decide; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
