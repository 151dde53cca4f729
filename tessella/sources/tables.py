"""Sources and sinks: explicit schemas, ids kept as text, projections that reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_value, normalize_article_id
from ..functions.vectors import is_finite
from ..operators.dense import upsert as _upsert
from .stage import publish

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], *, id_col: str | None = None, all_columns: Sequence[str] | None = None) -> DataFrame:
    """The given columns as text, nulls empty, ids padded; rows with a blank id are skipped.

    all_columns names the file's columns in order; without it the header does.
    """
    reader = spark.read.option("header", True).option("multiLine", False)
    if all_columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in all_columns]))
    rows = reader.csv(path).select(*columns).fillna("")
    if id_col:
        rows = rows.withColumn(id_col, normalize_article_id(id_col)).where(F.col(id_col) != "")
    return rows


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object (or array of objects) per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def read_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed JSON objects with blank lines between them, as request logs have."""
    text = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def append_log(rows: DataFrame, path: str) -> None:
    """Append events as JSON lines, stamped with the current time in UTC."""
    rows.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def valid_vectors(rows: DataFrame, vector_col: str, size: int) -> DataFrame:
    """Rows whose vector has the size and only finite numbers."""
    return rows.where((F.size(vector_col) == size) & is_finite(F.col(vector_col)))


def signature(config: Mapping[str, object]) -> str:
    """The first 16 digits of the SHA-1 of the sorted JSON of a configuration."""
    import hashlib
    import json

    return hashlib.sha1(json.dumps(dict(config), sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, config: Mapping[str, object], build) -> DataFrame:
    """The table built for a configuration: read if an earlier run has written it whole, else built aside and renamed."""
    path = f"{folder.rstrip('/')}/sig={signature(config)}"
    publish(spark, path, lambda aside: build().write.parquet(aside))
    return spark.read.parquet(path)


def lookup_ids(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of the given ids (one column); missing ones are dropped."""
    (name,) = ids.columns
    return table.join(ids.select(F.col(name).alias(key)).distinct(), key, "left_semi")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return _upsert(table, changes, key)


def patch(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The given columns replaced where changes has a value for the key; also replaces one vector of a point."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def payload(meta: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Renamed and cleaned columns: no-values become empty."""
    return meta.select(*[clean_value(F.col(old)).alias(new) for old, new in renames.items()])


def write_graph(edges: DataFrame, path: str) -> None:
    """Both directions as CSV, by item ascending and weight descending."""
    from ..operators.graph import both_ways

    both_ways(edges).orderBy("item_a", F.desc("weight"), "item_b").write.mode("overwrite").option("header", True).csv(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet folder does not hold yet; returns how many."""
    from ..operators.audits import not_done

    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path)
        rows = not_done(rows, done, key)
    except Exception as e:  # an absent folder is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: later joins and lookups on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


def card(c: Mapping[str, Column]) -> list[Column]:
    """Result card columns; the name falls back to the type, the image comes from the id."""
    from ..functions.text import image_path

    name = F.coalesce(F.nullif(c["name"], F.lit("")), c["product_type"], F.lit(""))
    return [c["article_id"].alias("article_id"), name.alias("name"), *[c[k].alias(k) for k in c if k not in ("article_id", "name")], image_path(c["article_id"]).alias("image_path")]
