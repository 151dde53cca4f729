"""TF-IDF and BM25 as joins and aggregations over a postings table (doc, term, tf)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS
from ..sources.stage import written
from . import ordering

#: Rows (query, term) of a batch of queries that are sent to every task.
ASKED_TERMS = 500_000
MIN_DF, MAX_DF_RATIO, K1, B = 2, 0.95, SETTINGS.bm25_k1, SETTINGS.bm25_b


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(doc, term, tf), pre-aggregated before the shuffle."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(post: DataFrame) -> DataFrame:
    """One row: n, documents with at least one token."""
    return post.agg(F.countDistinct("doc").alias("n"))


def vocabulary(post: DataFrame, *, method: str = "bm25", min_df: int = MIN_DF, max_df_ratio: float = MAX_DF_RATIO) -> DataFrame:
    """(term, df, idf) of terms in at least min_df documents and, where that is not 0, at most int(ratio * n)."""
    n = F.col("n").cast("double")
    most = F.floor(F.lit(max_df_ratio) * n)
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1 if method == "tfidf" else F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row of statistics joins every term
    terms = document_frequency(post).crossJoin(F.broadcast(corpus_size(post)))
    return terms.where((F.col("df") >= min_df) & ((most <= 0) | (F.col("df") <= most))).select("term", "df", idf.alias("idf"))


def numbered(vocab: DataFrame) -> DataFrame:
    """With idx from 0 in the order of the terms."""
    return ordering.numbered(vocab, ["term"])


def document_length(post: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, dl): tokens in the vocabulary; documents without one are left out."""
    return post.join(vocab.select("term"), "term").groupBy("doc").agg(F.sum("tf").alias("dl"))


def average_length(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.avg("dl").alias("avgdl"))


def _sent(asked: DataFrame) -> DataFrame:
    """The terms of a batch go to the postings; a batch of more than ASKED_TERMS is left to the optimiser."""
    return F.broadcast(asked) if asked.count() <= ASKED_TERMS else asked


def _asked(vocab: DataFrame, only: DataFrame | None) -> DataFrame:
    """The vocabulary, or its terms that are asked for: lengths and counts stay those of all terms."""
    return vocab if only is None else vocab.join(only.select("term").distinct(), "term", "left_semi")


def tfidf_weights(post: DataFrame, vocab: DataFrame, *, only: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight): tf over the document's tokens in the vocabulary, times idf."""
    kept = post.join(_asked(vocab, only).select("term", "idf"), "term").join(document_length(post, vocab), "doc")
    return kept.select("doc", "term", (F.col("tf") / F.col("dl") * F.col("idf")).alias("weight"))


def bm25_weights(post: DataFrame, vocab: DataFrame, *, k1: float = K1, b: float = B, only: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight) with weight > 0."""
    lengths = document_length(post, vocab)
    rows = post.join(_asked(vocab, only).select("term", "idf"), "term").join(lengths, "doc").crossJoin(F.broadcast(average_length(lengths)))
    tf = F.col("tf").cast("double")
    weight = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select("doc", "term", weight.alias("weight")).where("weight > 0")


@dataclass(frozen=True)
class Index:
    """An inverted index: rows (doc, term, tf, df, dl) of the vocabulary, documents with a token, and the mean length.

    Where rows are bucketed by document, neither postings nor scores are shuffled, only each task's best hits.
    """

    rows: DataFrame
    n: int
    average: float

    @staticmethod
    def statistics(rows: DataFrame) -> DataFrame:
        """One row (n, average) of rows from index_rows()."""
        total = rows.agg(F.max("n").alias("n"), F.sum("tf").alias("words"), F.countDistinct("doc").alias("some"))
        return total.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("words") / F.col("some"), F.lit(0.0)).alias("average"))

    def only(self, terms: Sequence[str]) -> Index:
        """The index of a few terms."""
        return Index(self.rows.where(F.col("term").isin(*terms)), self.n, self.average)

    def weight(self, method: str, *, k1: float = K1, b: float = B) -> Column:
        """The weight of a posting: bm25 or tfidf."""
        tf, df = F.col("tf").cast("double"), F.col("df")
        if method == "tfidf":
            return tf / F.col("dl") * (F.log((1.0 + self.n) / (1 + df)) + 1)
        idf = F.log(1 + (float(self.n) - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / self.average))

    def scores(self, terms: DataFrame, places: int = 9) -> DataFrame:
        """(query, doc, bm25, tfidf) of the documents that share a term with a query, in one pass over the asked postings."""
        hits = self.rows.join(_sent(written(terms, "asked-terms")), "term")
        return hits.groupBy("query", "doc").agg(*[F.round(F.sum(self.weight(m)), places).alias(m) for m in ("bm25", "tfidf")])


def index_rows(post: DataFrame, *, min_df: int = MIN_DF, max_df_ratio: float = MAX_DF_RATIO) -> DataFrame:
    """(doc, term, tf, df, dl, n): the postings of the vocabulary, with all that a weight needs."""
    n = post.select("doc").distinct().count()
    most = int(max_df_ratio * n)
    df = document_frequency(post).where((F.col("df") >= min_df) & (F.lit(most <= 0) | (F.col("df") <= most)))
    length = F.sum("tf").over(Window.partitionBy("doc"))
    return post.join(df, "term").select("doc", "term", "tf", "df", length.alias("dl"), F.lit(n).cast("long").alias("n"))


def query_terms(queries: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(query, term), each distinct term once."""
    return queries.select(F.col(id_col).alias("query"), F.explode(F.array_distinct(tokens)).alias("term"))


def scores(weights: DataFrame, terms: DataFrame, places: int = 9) -> DataFrame:
    """(query, doc, score) with score > 0: the sum of the weights of shared terms, rounded so that ties are the same everywhere."""
    return terms.join(weights, "term").groupBy("query", "doc").agg(F.round(F.sum("weight"), places).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int | None, by: str = "query", item: str = "doc") -> DataFrame:
    """With rank 1..k by score, ties by id; without k all are ranked. Spark cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), item)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def grid(index: Index, terms: DataFrame, params: list[tuple[float, float]], only: DataFrame | None = None) -> DataFrame:
    """(query, doc, scores): BM25 for every pair (k1, b) of parameters, side by side, in one pass over the postings.

    Scores are summed where the postings lie. only keeps pairs (query, doc).
    """
    hits = index.rows.join(_sent(terms), "term")
    hits = hits if only is None else hits.join(only.select("query", "doc"), ["query", "doc"], "left_semi")
    # one column each: an aggregate in an array is not generated code
    sums = hits.groupBy("query", "doc").agg(*[F.round(F.sum(index.weight("bm25", k1=k, b=b)), 9).alias(f"s{i}") for i, (k, b) in enumerate(params)])
    return sums.select("query", "doc", F.array(*[f"s{i}" for i in range(len(params))]).alias("scores"))


def may_hold(post: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, doc) of the documents that may hold a query's text as it stands, among those that share a word with it.

    Only the first and the last word of a passage can be parts of longer words in a text that holds it, so two of its
    distinct words may be missing there. post has all words, not the vocabulary's alone.
    """
    asked = written(terms.withColumn("n", F.count("*").over(Window.partitionBy("query"))), "asked-terms")
    met = post.join(_sent(asked), "term").groupBy("query", "doc").agg(F.count("*").alias("met"), F.first("n").alias("n"))
    return met.where("met >= n - 2").select("query", "doc")


def grid_ranks(index: Index, terms: DataFrame, holds: DataFrame, params: list[tuple[float, float]]) -> DataFrame:
    """(query, k1, b, rank): the place of the first document of holds (query, doc) for every pair of parameters.

    A place is one more than the better documents of the query, which are counted where their scores are summed, so no
    score is shuffled or sorted. Documents that share no term with the query have no place.
    """
    terms = written(terms.join(holds.select("query").distinct(), "query", "left_semi"), "asked-terms")
    first = grid(index, terms, params, holds).select("query", "doc", F.posexplode("scores").alias("i", "score"))
    first = first.groupBy("query", "i").agg(F.max(F.struct("score", (-F.col("doc")).alias("doc"))).alias("best"))
    first = written(first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("i", "best.score", (-F.col("best.doc")).alias("doc")))).alias("best")), "first-holders")
    better = lambda s, b, doc: (doc != b["doc"]) & ((s > b["score"]) | ((s == b["score"]) & (doc < b["doc"])))
    x = grid(index, terms, params).join(F.broadcast(first), "query")
    n = x.groupBy("query").agg(*[F.count_if(better(F.col("scores")[i], F.col("best")[i], F.col("doc"))).alias(f"n{i}") for i in range(len(params))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k1"), F.lit(b).alias("b"), (F.col(f"n{i}") + 1).alias("rank")) for i, (k, b) in enumerate(params)])).alias("x")
    return n.select("query", each).select("query", "x.*")


def term_types(items: DataFrame, id_col: str, text: Column, type_col: str, *, min_token: int = 3, min_total: int = 5) -> DataFrame:
    """(term, type, n): in how many items of each type a word occurs, for words in enough items."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{min_token},}})"), F.lit(1)))
    each = items.select(F.col(type_col).alias("type"), F.explode(words).alias("term")).groupBy("term", "type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("term"))
    return each.withColumn("total", total).where(F.col("total") >= min_total).select("term", "type", "n")


def majority_type(terms: DataFrame, counts: DataFrame, *, min_support: int = 15, min_share: float = 0.5) -> DataFrame:
    """(query, type): the type that most items with the query's words have, if there are enough of them."""
    each = terms.join(counts, "term").groupBy("query", "type").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "type"))
    best = each.withColumn("total", total).withColumn("rank", rank).where("rank = 1")
    return best.where((F.col("total") >= min_support) & (F.col("n") / F.col("total") >= min_share)).select("query", "type", "n", "total")


def inspect(vocab: DataFrame, n: int, needle: str) -> DataFrame:
    """(part, term, df, place): the n most and least frequent terms, and the n most frequent that contain the needle."""
    parts = {"head": (vocab, F.desc("df")), "tail": (vocab, F.asc("df")), "match": (vocab.where(F.col("term").contains(needle)), F.desc("df"))}
    out = None
    for name, (rows, order) in parts.items():
        # the limit runs in every task first; only its rows are numbered
        few = rows.select("term", "df").orderBy(order, "term").limit(n)
        few = few.select(F.lit(name).alias("part"), "term", "df", F.row_number().over(Window.orderBy(order, "term")).alias("place"))
        out = few if out is None else out.unionByName(few)
    return out
