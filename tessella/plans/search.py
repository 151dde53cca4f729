"""Text search, vectors, fusion and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import dense, filters, fusion, sparse
from ..sources.stage import written
from ..sources.tables import read_table
from .base import CATALOGUE, GRADES, POSTINGS, benchmark_terms, bm25_scores, catalogue, doc_postings, grades, query, ranked_sql, search_index, text_scores, tfidf_scores

_HYBRID = f"""WITH {POSTINGS}, a AS {ranked_sql("bms", 40)}, b AS {ranked_sql("tfs", 40)},
u AS (SELECT query, doc, round(sum(1.0 / (2 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM a UNION ALL SELECT query, doc, rank FROM b) GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, rank FROM {ranked_sql("u", 10)}"""


@query(_HYBRID)
def hybrid_search(spark, sf_dir) -> DataFrame:
    """BM25 and TF-IDF branches, each cut to the prefetch depth, fused by reciprocal rank."""
    scored = written(text_scores(spark, sf_dir), "scores")
    found = fusion.hybrid({m: scored.select("query", "doc", F.col(m).alias("score")).where("score > 0") for m in ("bm25", "tfidf")}, 10)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {POSTINGS} SELECT term, df FROM dfs")
def doc_frequency(spark, sf_dir):
    return sparse.document_frequency(doc_postings(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx, round(idf, 6) AS idf FROM voc")
def vocab_pruned(spark, sf_dir):
    return sparse.numbered(sparse.vocabulary(doc_postings(spark, sf_dir))).withColumn("idf", F.round("idf", 6))


@query(f"WITH {POSTINGS} SELECT doc, term, round(weight, 6) AS weight FROM tfi")
def tfidf_weights(spark, sf_dir):
    post = doc_postings(spark, sf_dir)
    return sparse.tfidf_weights(post, sparse.vocabulary(post, method="tfidf")).withColumn("weight", F.round("weight", 6))


@query(f"WITH {POSTINGS} SELECT round(avgdl, 6) AS avgdl FROM avgl")
def bm25_avgdl(spark, sf_dir):
    post = doc_postings(spark, sf_dir)
    return sparse.average_length(sparse.document_length(post, sparse.vocabulary(post))).select(F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {POSTINGS} SELECT doc, term, round(weight, 6) AS weight FROM bm")
def bm25_weights(spark, sf_dir):
    post = doc_postings(spark, sf_dir)
    return sparse.bm25_weights(post, sparse.vocabulary(post)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {POSTINGS} SELECT query, doc, round(score, 6) AS score, rank FROM {ranked_sql('bms', 10)}")
def bm25_topk(spark, sf_dir):
    return sparse.top_k(bm25_scores(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {POSTINGS} SELECT query, doc, round(score, 6) AS score, rank FROM {ranked_sql('tfs', 10)}")
def tfidf_topk(spark, sf_dir):
    return sparse.top_k(tfidf_scores(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {POSTINGS}, g AS (SELECT * FROM (VALUES (0.8::DOUBLE), (1.2), (1.5), (2.0)) a(k1), (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) b(b)),
s AS (SELECT k1, b, query, doc, round(sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 9) AS score FROM qt JOIN post USING (term) JOIN voc USING (term) JOIN dls USING (doc), avgl, g GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, query ORDER BY score DESC, doc) AS rank FROM s),
h AS (SELECT k1, b, query, min(rank) AS rank FROM r JOIN documents ON doc = doc_id JOIN benchmark ON query = item_id WHERE contains(documents.text, benchmark.text) GROUP BY 1, 2, 3)
SELECT k1, b, count(*) AS n_found, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(1.0 / rank), 6) AS mrr FROM h GROUP BY 1, 2""")
def bm25_grid(spark, sf_dir):
    """Parameters of BM25 by how early a document that holds the passage comes."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("dt"))
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("qt"))
    terms = written(benchmark_terms(spark, sf_dir).distinct(), "terms")
    # few pairs are left to look into texts for
    near = written(sparse.may_hold(doc_postings(spark, sf_dir), terms), "may-hold")
    holds = written(near.join(docs, "doc").join(bench, "query").where(F.col("dt").contains(F.col("qt"))).select("query", "doc").distinct(), "holds")
    h = sparse.grid_ranks(search_index(spark, sf_dir), terms, holds, [(k1, b) for k1 in (0.8, 1.2, 1.5, 2.0) for b in (0.25, 0.5, 0.75, 1.0)])
    return h.groupBy("k1", "b").agg(F.count("*").alias("n_found"), F.round(F.avg((F.col("rank") <= 10).cast("double")), 6).alias("recall_at_10"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


@query(f"""WITH {POSTINGS}, a AS {ranked_sql("bms", 10)}, b AS {ranked_sql("tfs", 10)}
SELECT coalesce(a.query, b.query) AS query, count(a.doc) AS n_bm25, count(b.doc) AS n_tfidf, count(CASE WHEN a.doc IS NOT NULL AND b.doc IS NOT NULL THEN 1 END) AS n_both
FROM a FULL JOIN b ON a.query = b.query AND a.doc = b.doc GROUP BY 1""")
def sparse_ab(spark, sf_dir):
    a = sparse.top_k(bm25_scores(spark, sf_dir), 10).select("query", "doc", F.lit(1).alias("a"))
    b = sparse.top_k(tfidf_scores(spark, sf_dir), 10).select("query", "doc", F.lit(1).alias("b"))
    return a.join(b, ["query", "doc"], "full").groupBy("query").agg(F.count("a").alias("n_bm25"), F.count("b").alias("n_tfidf"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


@query(f"""WITH {CATALOGUE}, e AS (SELECT DISTINCT item, product_type AS type, unnest(regexp_extract_all(lower(name), '[a-z]{{3,}}')) AS term FROM cat),
c AS (SELECT term, type, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY term) AS total FROM c QUALIFY total >= 5),
q AS (SELECT DISTINCT name AS query, unnest(regexp_extract_all(lower(name), '[a-z]{{3,}}')) AS term FROM cat),
s AS (SELECT query, type, sum(n) AS n FROM q JOIN k USING (term) GROUP BY 1, 2)
SELECT query, type, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY query) AS total, row_number() OVER (PARTITION BY query ORDER BY n DESC, type) AS r FROM s) WHERE r = 1 AND total >= 15 AND n / total >= 0.17""")
def term_majority_type(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    counts = sparse.term_types(cat, "item", F.col("name"), "product_type")
    terms = cat.select(F.col("name").alias("query"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("term")).distinct()
    return sparse.majority_type(terms, counts, min_share=0.17)


_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _knn_sql(where: str, k: int = 10) -> str:
    return f"""WITH {_EMB}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 20 = 0 AND {where})
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""


def _knn(spark, sf_dir, items=None, **options):
    e = read_table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    return dense.knn(e if items is None else items, asked, options.pop("k", 10), id_col="vec_id", vector_col="embedding", places=6, **options)


@query(_knn_sql("true"))
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_knn_sql("a.vec_id <> b.vec_id"))
def knn_exclude_self(spark, sf_dir):
    return _knn(spark, sf_dir, exclude_self=True)


@query(_knn_sql("a.vec_id <> b.vec_id AND a.label = b.label"))
def knn_filtered(spark, sf_dir):
    return _knn(spark, sf_dir, exclude_self=True, group_col="label", same_group=True)


@query(_knn_sql("a.label <> b.label"))
def knn_other_label(spark, sf_dir):
    return _knn(spark, sf_dir, group_col="label", same_group=False)


@query(f"""WITH {_EMB}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0 AND a.label = b.label)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def warm_twins(spark, sf_dir):
    """Cold items (every fourth) and their five nearest warm ones of the same slot."""
    e = read_table(spark, sf_dir, "embeddings")
    return dense.knn(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query"), 5, id_col="vec_id", vector_col="embedding", places=6, group_col="label", same_group=True)


@query(f"""WITH {_EMB}, s AS (SELECT a.vec_id AS item_a, b.vec_id AS item_b, round(list_dot_product(a.v, b.v), 9) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT item_a, item_b, CAST(greatest(floor(score * 1000), 0) AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b) AS rank FROM s) WHERE rank <= 20""")
def knn_graph(spark, sf_dir):
    return dense.knn_graph(read_table(spark, sf_dir, "embeddings"), 20, id_col="vec_id", vector_col="embedding")


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT label, i, round(sum(x), 9) AS x FROM x GROUP BY 1, 2)
SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM s""")
def centroid_vectors(spark, sf_dir):
    m = dense.mean_vector(read_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("vector").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_RGB = [("red", 200, 30, 40), ("blue", 40, 60, 190), ("green", 30, 140, 60), ("grey", 128, 128, 128)]


@query(f"""WITH {CATALOGUE}, p(name_, r, g, b) AS (VALUES {", ".join(map(str, _RGB))}), s AS (SELECT item, name_, (r - item % 256) * (r - item % 256) + (g - size * 5) * (g - size * 5) + (b - 90) * (b - 90) AS d FROM cat, p)
SELECT item, name_ AS colour, CAST(d AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d, name_) AS k FROM s) WHERE k = 1""")
def rgb_nearest(spark, sf_dir):
    palette = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for n, r, g, b in _RGB])
    mine = F.struct((F.col("item") % 256).alias("r"), (F.col("size") * 5).alias("g"), F.lit(90).alias("b"))
    best = F.array_min(F.transform(palette, lambda p: F.struct(V.rgb_distance(p, mine).alias("d"), p["name"].alias("name"))))
    return catalogue(spark, sf_dir).select("item", best["name"].alias("colour"), best["d"].alias("distance"))


def _ranked_union(spark, sf_dir, depth):
    scored = written(text_scores(spark, sf_dir), "scores")
    a, b = (sparse.top_k(scored.select("query", "doc", F.col(m).alias("score")).where("score > 0"), depth).withColumn("branch", F.lit(m)) for m in ("bm25", "tfidf"))
    return a.unionByName(b)


def _rrf_sql(k: int, base: int, depth: int = 50) -> str:
    return f"""WITH {POSTINGS}, a AS {ranked_sql("bms", depth)}, b AS {ranked_sql("tfs", depth)},
u AS (SELECT query, doc, round(sum(1.0 / ({k} + rank - 1 + {base})), 9) AS score FROM (SELECT query, doc, rank FROM a UNION ALL SELECT query, doc, rank FROM b) GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, rank FROM {ranked_sql("u", 10)}"""


def _rrf(spark, sf_dir, k, base):
    return fusion.rrf(_ranked_union(spark, sf_dir, 50), 10, k=k, base=base).withColumn("score", F.round("score", 6))


@query(_rrf_sql(2, 1))
def rrf_k2(spark, sf_dir):
    return _rrf(spark, sf_dir, 2, 1)


@query(_rrf_sql(60, 0))
def rrf_k60(spark, sf_dir):
    return _rrf(spark, sf_dir, 60, 0)


@query(_rrf_sql(60, 1))
def rrf_ablation_k60(spark, sf_dir):
    return _rrf(spark, sf_dir, 60, 1)


@query(f"""WITH {POSTINGS}, a AS (SELECT *, 'bm25' AS branch FROM {ranked_sql("bms", 50)}), b AS (SELECT *, 'tfidf' AS branch FROM {ranked_sql("tfs", 50)}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM u WINDOW w AS (PARTITION BY query, branch)),
s AS (SELECT query, doc, round(sum((score - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 0.5), 9) AS score FROM m GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, rank FROM {ranked_sql("s", 10)}""")
def minmax_convex(spark, sf_dir):
    return fusion.convex(_ranked_union(spark, sf_dir, 50), {"bm25": 0.5, "tfidf": 0.5}, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {POSTINGS}, q AS (SELECT query, count(*) AS nq FROM qt GROUP BY 1), a AS {ranked_sql("bms", 30)},
o AS (SELECT query, doc, count(*) AS common FROM qt JOIN post USING (term) GROUP BY 1, 2)
SELECT query, doc, rank, round(common / nq, 6) AS rescore, row_number() OVER (PARTITION BY query ORDER BY common / nq DESC, rank, doc) AS new_rank FROM a JOIN o USING (query, doc) JOIN q USING (query) QUALIFY new_rank <= 10""")
def rerank_overlap(spark, sf_dir):
    """A pool of 30 re-ranked by a deterministic scorer that stands for a cross-encoder."""
    pool = sparse.top_k(bm25_scores(spark, sf_dir), 30).select("query", "doc", "rank")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("dt"))
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("qt"))
    # only texts of the pool are cut into words
    rows = pool.join(docs, "doc").join(bench, "query")
    return fusion.rerank(rows, fusion.overlap_score(TX.words_alnum("qt"), TX.words_alnum("dt")), 10).select("query", "doc", "rank", F.round("rescore", 6).alias("rescore"), "new_rank")


_METHODS = f"""{POSTINGS}, {GRADES}, {_EMB}, near AS (SELECT item_id AS query, b.vec_id AS doc, round(list_dot_product(a.v, b.v), 9) AS score FROM benchmark JOIN e a ON a.vec_id = item_id, e b WHERE b.vec_id IN (SELECT doc_id FROM documents)),
d0 AS {ranked_sql("near", 50)}, s0 AS {ranked_sql("bms", 50)}, rf AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM (FROM d0 UNION ALL FROM s0) GROUP BY 1, 2), r0 AS {ranked_sql("rf", 50)},
mm AS (SELECT query, doc, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END AS part FROM (SELECT *, 1 AS m FROM d0 UNION ALL SELECT *, 2 FROM s0) WINDOW w AS (PARTITION BY query, m)),
cv AS (SELECT query, doc, round(sum(0.5 * part), 9) AS score FROM mm GROUP BY 1, 2), c0 AS {ranked_sql("cv", 50)},
al AS (SELECT 'dense' AS method, query, doc, rank FROM d0 UNION ALL SELECT 'sparse', query, doc, rank FROM s0 UNION ALL SELECT 'rrf', query, doc, rank FROM r0 UNION ALL SELECT 'convex', query, doc, rank FROM c0),
nq AS (SELECT query, count(*) AS nq FROM qt GROUP BY 1), ov AS (SELECT query, doc, count(*) AS common FROM qt JOIN post USING (term) GROUP BY 1, 2),
rr AS (SELECT al.*, row_number() OVER (PARTITION BY method, al.query ORDER BY coalesce(common, 0) / greatest(coalesce(nq, 0), 1) DESC, rank, al.doc) AS new_rank FROM al LEFT JOIN nq ON nq.query = al.query LEFT JOIN ov ON ov.query = al.query AND ov.doc = al.doc),
bl AS (SELECT *, row_number() OVER (PARTITION BY method, query ORDER BY round(1.0 / (59 + rank) + 1.0 / (59 + new_rank), 12) DESC, rank, doc) AS mixed FROM rr),
st AS (SELECT method, 'before' AS stage, query, doc, rank AS r FROM bl UNION ALL SELECT method, 'after', query, doc, new_rank FROM bl UNION ALL SELECT method, 'blend', query, doc, mixed FROM bl)"""


@query(f"WITH {_METHODS} SELECT method, stage, count(DISTINCT query) AS queries, round(sum((2 ** coalesce(grade, 0) - 1) / log2(r + 1)) / count(DISTINCT query), 5) AS dcg, round(count(CASE WHEN grade >= 1 THEN 1 END) / (10 * count(DISTINCT query)), 6) AS p1, round(count(CASE WHEN grade = 2 THEN 1 END) / (10 * count(DISTINCT query)), 6) AS p2 FROM st LEFT JOIN gr USING (doc) WHERE r <= 10 GROUP BY 1, 2")
def rerank_ablation(spark, sf_dir):
    """Dense, sparse and two ways to fuse them, each before and after a re-rank, and with both orders blended."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("dt"))
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("qt"))
    items = e.join(docs.select(F.col("doc").alias("vec_id")), "vec_id", "left_semi")
    asked = e.withColumnRenamed("vec_id", "query").join(bench.select("query"), "query", "left_semi")
    dense_ = dense.knn(items, asked, 50, id_col="vec_id", vector_col="embedding").select("query", F.col("id").alias("doc"), "score", "rank")
    lists = {"dense": written(dense_, "dense"), "sparse": written(sparse.top_k(bm25_scores(spark, sf_dir), 50).select("query", "doc", "score", "rank"), "sparse")}
    both = lists["dense"].withColumn("branch", F.lit("dense")).unionByName(lists["sparse"].withColumn("branch", F.lit("sparse")))
    lists |= {"rrf": fusion.rrf(both, 50, k=60, base=1), "convex": fusion.convex(both, {"dense": 0.5, "sparse": 0.5}, 50)}
    rows = None
    for method, found in lists.items():
        part = found.select("query", "doc", "rank", F.lit(method).alias("method"))
        rows = part if rows is None else rows.unionByName(part)
    # a pair is scored once, whatever lists it is in
    pairs = rows.select("query", "doc").distinct().join(docs, "doc").join(bench, "query")
    scored = pairs.select("query", "doc", fusion.overlap_score(TX.words_alnum("qt"), TX.words_alnum("dt")).alias("rescore"))
    keyed = rows.join(written(scored, "rescored"), ["query", "doc"]).select(F.struct("method", "query").alias("query"), "doc", "rank", F.col("rescore").alias("s"))
    after = written(fusion.rerank(keyed, F.col("s"), 50).select("query", "doc", "rank", "new_rank"), "reranked")
    mixed = fusion.blend(after, None).select("query", "doc", F.lit("blend").alias("stage"), F.col("rank").alias("r"))
    stages = after.select("query", "doc", F.explode(F.create_map(F.lit("before"), "rank", F.lit("after"), "new_rank")).alias("stage", "r")).unionByName(mixed)
    g = stages.where("r <= 10").join(grades(spark, sf_dir), "doc", "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    n = F.countDistinct("query.query")
    dcg = F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1))
    shares = [F.round(F.count_if(F.col("grade") >= least) / (10 * n), 6).alias(f"p{least}") for least in (1, 2)]
    return g.groupBy(F.col("query.method").alias("method"), "stage").agg(n.alias("queries"), F.round(dcg / n, 5).alias("dcg"), *shares)


@query(f"WITH {CATALOGUE} SELECT product_group AS grp, count(*) AS n, min(colour) AS colour, min(CASE WHEN size > 10 THEN garment END) AS garment, coalesce(string_agg(DISTINCT garment, '|' ORDER BY garment) FILTER (size > 10), '') AS garments FROM cat GROUP BY 1")
def hard_filter_lists(spark, sf_dir):
    """Filters with lists of values: the first that is not blank, and all that are not."""
    m = F.create_map(F.lit("colour"), F.sort_array(F.collect_set("colour")), F.lit("garment"), F.sort_array(F.collect_list(F.when(F.col("size") > 10, F.col("garment")).otherwise(" "))))
    x = catalogue(spark, sf_dir).groupBy(F.col("product_group").alias("grp")).agg(F.count("*").alias("n"), m.alias("m"))
    first = filters.first_values(F.col("m"))
    return x.select("grp", "n", first["colour"].alias("colour"), F.try_element_at(first, F.lit("garment")).alias("garment"), F.array_join(filters.all_non_blank(F.col("m")["garment"]), "|").alias("garments"))


def _filtered(sql_where: str):
    return f"WITH {CATALOGUE} SELECT item, name FROM cat WHERE {sql_where}"


@query(_filtered("product_type = 'ECONOMY' AND colour = 'red'"))
def must_filter(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return cat.where(filters.compile_filters({"product_type": "ECONOMY", "colour": "red", "size_name": ""}, {}, cat.columns)).select("item", "name")


@query(_filtered("colour IN ('red', 'blue')"))
def must_any(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return cat.where(filters.compile_filters({"colour": ["red", "blue", ""]}, {"absent": "x"}, cat.columns)).select("item", "name")


@query(_filtered("product_type = 'PROMO' AND colour NOT IN ('old', 'new')"))
def must_not_filter(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return cat.where(filters.compile_filters({"product_type": "PROMO"}, {"colour": ["old", "new"]}, cat.columns)).select("item", "name")


@query(_filtered("colour = 'hot' OR garment = 'hot' OR false"))
def alias_filter(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return cat.where(filters.compile_filters({"word": "hot"}, {}, cat.columns, {"word": ("colour", "garment")})).select("item", "name")


@query(_filtered("lower(product_type) = 'small' AND lower(colour) <> 'red'"))
def post_filter(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return cat.where(filters.post_filter({"product_type": " Small "}, {"colour": ["RED"]})).select("item", "name")


@query(f"""WITH {CATALOGUE}, k AS (SELECT *, size <= 2 AND colour = 'red' AS ok, count(CASE WHEN size <= 2 AND colour = 'red' THEN 1 END) OVER (PARTITION BY product_group, product_type) AS n FROM cat)
SELECT product_group || '/' || product_type AS grp, item FROM k WHERE ok OR n = 0""")
def keep_unless_empty(spark, sf_dir):
    cat = catalogue(spark, sf_dir).withColumn("grp", F.concat_ws("/", "product_group", "product_type"))
    return filters.unless_empty(cat, (F.col("size") <= 2) & (F.col("colour") == "red"), "grp").select("grp", "item")


@query(f"""WITH {CATALOGUE}, q AS (SELECT DISTINCT item AS query, product_type AS t, colour AS c, size AS s FROM cat WHERE item % 20 = 0),
x AS (SELECT query, item AS id, CAST(price AS DOUBLE) AS score, CASE WHEN product_type = t AND colour = c AND size = s THEN 1 WHEN product_type = t AND colour = c AND size > 45 THEN 2 WHEN product_type = t AND size > 40 THEN 3 END AS tier FROM q JOIN cat ON product_type = t WHERE item <> query),
y AS (SELECT *, min(tier) OVER (PARTITION BY query) AS least FROM x WHERE tier IS NOT NULL)
SELECT query, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM y WHERE tier = least) WHERE rank <= 5""")
def relaxation_cascade(spark, sf_dir):
    """The tightest of three filter tiers that has any item for a query."""
    cat = catalogue(spark, sf_dir)
    asked = cat.where("item % 20 = 0").withColumnRenamed("item", "query")
    items = cat.withColumnsRenamed({"item": "id", "price": "score"})
    tiers = [(["product_type", "colour", "size"], F.lit(True)), (["product_type", "colour"], F.col("size") > 45), (["product_type"], F.col("size") > 40)]
    return filters.cascade(asked, items, tiers, 5).select("query", "id", "tier", "rank")


@query(f"WITH {CATALOGUE} SELECT item, CASE WHEN colour = 'old' THEN 1 ELSE 2 END AS n_hard FROM cat")
def hard_filter_map(spark, sf_dir):
    m = F.create_map(F.lit("product_type"), F.col("product_type"), F.lit("colour_group"), F.when(F.col("colour") == "old", "").otherwise(F.col("colour")), F.lit("occasion"), F.col("garment"))
    return catalogue(spark, sf_dir).select("item", F.size(filters.only_keys(m)).alias("n_hard"))
