"""The registry of named queries with their SQL counterparts, and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, FOLDED, words_alnum
from ..operators import graph, sparse
from ..sources.stage import files_of, kept
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a catalogue: type, group, and a colour and a garment from the two words of the name."""
    p = read_table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_type").alias("product_type"), F.col("p_brand").alias("product_group"), words[0].alias("colour"), words[1].alias("garment"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


CATALOGUE = "cat AS (SELECT p_partkey AS item, p_name AS name, p_type AS product_type, p_brand AS product_group, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS garment, p_size AS size, p_retailprice AS price FROM part)"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), F.col("l_extendedprice").alias("price"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"))
    return lines.join(orders, "l_orderkey").drop("l_orderkey")


PURCHASES = "pur AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, l_partkey AS item, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
BASKETS = PURCHASES + """, lines AS (SELECT DISTINCT customer, day, item FROM pur),
bas AS (SELECT customer, day FROM lines GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 10), bi AS (SELECT l.* FROM lines l JOIN bas USING (customer, day)),
nb AS (SELECT count(*) AS total FROM bas), ic AS (SELECT item, count(*) AS n FROM bi GROUP BY 1),
pc AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n FROM bi a JOIN bi b ON a.customer = b.customer AND a.day = b.day AND a.item < b.item GROUP BY 1, 2),
cobuy AS (SELECT item_a, item_b, n, CAST(n AS DOUBLE) AS weight FROM pc WHERE n >= 2)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.baskets(purchases(spark, sf_dir), "customer", "day", "item")


def cobuy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(baskets(spark, sf_dir), method="cobuy", min_count=2)


#: Bytes of stored documents for each bucket of their postings; there are no fewer than BUCKETS.
BUCKET_BYTES, BUCKETS = 4 << 20, 64


def _buckets(spark: SparkSession, files: list[str]) -> int:
    return max(BUCKETS, sum(size for f in files for _, size, _ in files_of(spark, f)) // BUCKET_BYTES)


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, term, tf), bucketed by document: the documents are tokenised once for the state of their files."""
    files = [f"{sf_dir}/documents.parquet"]
    n = _buckets(spark, files)
    # texts are dealt out, not their words: a document's words are counted where its text lies
    build = lambda: sparse.postings(read_table(spark, sf_dir, "documents").select("doc_id", "text").repartition(n, "doc_id"), "doc_id", words_alnum("text"))
    return kept(spark, "postings", files, build, version=2, bucket_by="doc", buckets=n)


def search_index(spark: SparkSession, sf_dir: str) -> sparse.Index:
    """The index that all text searches share, bucketed by document, and its two statistics."""
    files = [f"{sf_dir}/documents.parquet"]
    rows = kept(spark, "index", files, lambda: sparse.index_rows(doc_postings(spark, sf_dir)), version=2, bucket_by="doc", buckets=_buckets(spark, files))
    n, average = kept(spark, "index-statistics", files, lambda: sparse.Index.statistics(rows), version=2).first()
    return sparse.Index(rows.drop("n"), n, average)


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.query_terms(read_table(spark, sf_dir, "benchmark"), "item_id", words_alnum("text"))


_TOKENS = f"regexp_extract_all(translate(lower(text), '{ACCENTED}', '{FOLDED}'), '[a-z0-9]+')"
POSTINGS = f"""post AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2),
dn AS (SELECT CAST(count(DISTINCT doc) AS DOUBLE) AS n FROM post), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
voc AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln((1 + n) / (1 + df)) + 1 AS idf_tfidf FROM dfs, dn WHERE df >= 2 AND df <= floor(0.95 * n)),
dls AS (SELECT doc, CAST(sum(tf) AS DOUBLE) AS dl FROM post JOIN voc USING (term) GROUP BY 1), avgl AS (SELECT avg(dl) AS avgdl FROM dls),
bm AS (SELECT doc, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM post JOIN voc USING (term) JOIN dls USING (doc), avgl),
tfi AS (SELECT doc, term, tf / dl * idf_tfidf AS weight FROM post JOIN voc USING (term) JOIN dls USING (doc)),
qt AS (SELECT DISTINCT item_id AS query, unnest({_TOKENS}) AS term FROM benchmark),
bms AS (SELECT query, doc, round(sum(weight), 9) AS score FROM qt JOIN bm USING (term) GROUP BY 1, 2),
tfs AS (SELECT query, doc, round(sum(weight), 9) AS score FROM qt JOIN tfi USING (term) GROUP BY 1, 2)"""


def ranked_sql(source: str, k: int, item: str = "doc") -> str:
    return f"(SELECT query, {item}, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, {item}) AS rank FROM {source} QUALIFY rank <= {k})"


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc, bm25, tfidf) of the benchmark items as queries."""
    return search_index(spark, sf_dir).scores(benchmark_terms(spark, sf_dir))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(spark, sf_dir).select("query", "doc", F.col("bm25").alias("score")).where("score > 0")


def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(spark, sf_dir).select("query", "doc", F.col("tfidf").alias("score")).where("score > 0")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, grade): 2 for good and not toxic, 1 for good, else 0."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("doc"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0).alias("grade"))


GRADES = "gr AS (SELECT doc_id AS doc, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM labels)"
