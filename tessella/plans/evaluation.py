"""Ranking metrics, splits, negatives, and table audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import audits, fusion, metrics, sparse
from ..sources.stage import written
from ..sources.tables import read_table
from .base import BASKETS, CATALOGUE, GRADES, POSTINGS, PURCHASES, baskets, bm25_scores, catalogue, cobuy, grades, purchases, query, ranked_sql, text_scores, tfidf_scores

_RUN = f"run AS {ranked_sql('bms', 20)}, tru AS (SELECT query, doc FROM tfsr WHERE rank <= 5)"
_EVAL = f"{POSTINGS}, tfsr AS {ranked_sql('tfs', 20)}, {_RUN}, nt AS (SELECT query, count(*) AS n_true FROM tru GROUP BY 1), jj AS (SELECT r.query, r.doc, r.rank, CASE WHEN t.doc IS NOT NULL THEN 1 ELSE 0 END AS hit, n_true FROM run r LEFT JOIN tru t ON r.query = t.query AND r.doc = t.doc JOIN nt ON nt.query = r.query)"


def _ranked(spark, sf_dir):
    """Twenty hits a query, written once: metrics read them several times."""
    return written(sparse.top_k(bm25_scores(spark, sf_dir), 20), "ranked")


def _truth(spark, sf_dir):
    """What the other weighting puts in its first five serves as the truth."""
    return sparse.top_k(tfidf_scores(spark, sf_dir), 5).select("query", "doc")


def _at_k_sql(column: str, k: int) -> str:
    expr = {
        "recall": "sum(hit) / max(n_true)",
        "hit": "CAST(max(hit) AS DOUBLE)",
        "average_precision": f"sum(hit * upto / rank) / least({k}, max(n_true))",
    }[column]
    return f"WITH {_EVAL} SELECT query, round({expr}, 6) AS {column} FROM (SELECT *, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS upto FROM jj WHERE rank <= {k}) GROUP BY 1"


def _at_k(spark, sf_dir, column, k):
    return metrics.at_k(_ranked(spark, sf_dir), _truth(spark, sf_dir), k).select("query", F.round(F.col(column).cast("double"), 6).alias(column))


@query(_at_k_sql("recall", 10))
def recall_at_k(spark, sf_dir):
    return _at_k(spark, sf_dir, "recall", 10)


@query(_at_k_sql("average_precision", 10))
def map_at_k(spark, sf_dir):
    return _at_k(spark, sf_dir, "average_precision", 10)


@query(_at_k_sql("hit", 1))
def hit_at_k(spark, sf_dir):
    return _at_k(spark, sf_dir, "hit", 1)


@query(f"WITH {BASKETS}, t AS (SELECT DISTINCT item AS query FROM bi), r AS (SELECT item_a AS query FROM cobuy UNION SELECT item_b FROM cobuy) SELECT count(*) AS n_truth, count(r.query) AS n_found, round(count(r.query) / count(*), 6) AS coverage FROM t LEFT JOIN r ON t.query = r.query")
def coverage(spark, sf_dir):
    """Items of baskets that have any neighbour."""
    from ..operators import graph

    t = graph.item_counts(baskets(spark, sf_dir)).select(F.col("item").alias("query"))
    r = graph.endpoints(cobuy(spark, sf_dir)).select(F.col("item").alias("query"))
    return metrics.coverage(r, t).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {PURCHASES}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM pur)) SELECT CAST(day AS VARCHAR) AS cutoff, n AS n_days FROM d WHERE r = greatest(CAST(floor(n * 0.8) AS BIGINT), 1)")
def temporal_split(spark, sf_dir):
    return metrics.temporal_cutoff(purchases(spark, sf_dir), "day").withColumn("cutoff", F.col("cutoff").cast("string"))


_NDCG = f"""WITH {_EVAL}, {GRADES}, d AS (SELECT query, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM run LEFT JOIN gr USING (doc) WHERE rank <= 10 GROUP BY 1),
i AS (SELECT sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, doc) AS r FROM gr) WHERE r <= 10)
SELECT query, round(dcg / idcg, 6) AS ndcg FROM d, i"""


@query(_NDCG)
def ndcg_at_10(spark, sf_dir):
    """Every query has the same grades: those of the documents."""
    run = _ranked(spark, sf_dir)
    g = grades(spark, sf_dir)
    # ten best grades are the ideal of every query; grades of ranked documents are looked up
    ideal = g.orderBy(F.desc("grade"), "doc").limit(10)
    queries = run.select("query").distinct()
    top = queries.crossJoin(F.broadcast(ideal))
    judged = run.where("rank <= 10").select("query", "doc").join(g, "doc").select("query", "doc", "grade")
    whole = top.unionByName(judged).distinct()
    return metrics.ndcg(run, whole, 10).withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH {_EVAL}, {GRADES} SELECT query, round(count(CASE WHEN grade = 2 THEN 1 END) / 10, 6) AS precision FROM run LEFT JOIN gr USING (doc) WHERE rank <= 10 GROUP BY 1")
def precision_strict_at_10(spark, sf_dir):
    run = _ranked(spark, sf_dir)
    g = run.select("query", "doc").join(grades(spark, sf_dir), "doc")
    return metrics.precision_at(run, g, 10, 2).withColumn("precision", F.round("precision", 6))


@query(f"WITH {_EVAL}, f AS (SELECT query, min(rank) AS r FROM jj WHERE hit = 1 GROUP BY 1) SELECT query, round(coalesce(1.0 / r, 0), 6) AS rr FROM nt LEFT JOIN f USING (query)")
def mrr(spark, sf_dir):
    return metrics.reciprocal_rank(_ranked(spark, sf_dir), _truth(spark, sf_dir)).withColumn("rr", F.round("rr", 6))


@query("WITH x AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), p AS (SELECT n_chars AS s FROM x WHERE quality = 1), n AS (SELECT n_chars AS s FROM x WHERE quality = 0) SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auc, (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives FROM p, n")
def auc_tie_aware(spark, sf_dir):
    """How well length alone tells good documents."""
    x = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.auc(x, "n_chars", "quality").withColumn("auc", F.round("auc", 6))


_NEGATIVE = f"""{CATALOGUE}, a AS (SELECT item AS anchor, product_type AS slot, size AS bin FROM cat), pool AS (SELECT item AS candidate, product_type AS slot, size AS bin, size FROM cat)"""


def draws_sql(asked: str, pool: str, on: str, k: int, by: str = "anchor", where: str = "true") -> str:
    """(by, candidate, r) of metrics.draw_negatives(), from relations (by, on) and (candidate, on)."""
    key = f"CAST({by} AS VARCHAR) || '|' || CAST({{}} AS VARCHAR) || '|42'"
    place = f"CAST('0x' || substr(md5({key.format('j')}), 1, 15) AS BIGINT) % n"
    return f"""(WITH z AS (SELECT {on}, count(*) AS n FROM {pool} GROUP BY 1), pl AS (SELECT *, row_number() OVER (PARTITION BY {on} ORDER BY candidate) - 1 AS place FROM {pool}),
listed AS (SELECT {by}, candidate, 1099511627776 AS j, md5({key.format('candidate')}) AS key FROM {asked} JOIN z USING ({on}) JOIN {pool} USING ({on}) WHERE n <= {4 * k}),
drawn AS (SELECT {by}, candidate, min(j) AS j, '' AS key FROM (SELECT {by}, {on}, j, {place} AS place FROM {asked} JOIN z USING ({on}), range(1, {6 * k + 1}) t(j) WHERE n > {4 * k}) JOIN pl USING ({on}, place) GROUP BY 1, 2)
SELECT {by}, candidate, row_number() OVER (PARTITION BY {by} ORDER BY j, key, candidate) AS r FROM (FROM listed UNION ALL FROM drawn) WHERE {by} <> candidate AND {where} QUALIFY r <= {k})"""


def _negative_sql(on: str) -> str:
    return f"WITH {_NEGATIVE} SELECT anchor, candidate FROM {draws_sql('a', 'pool', on, 100, where='candidate <> anchor + 1')}"


def _negatives(spark, sf_dir, on):
    cat = catalogue(spark, sf_dir).select("item", F.col("product_type").alias("slot"), F.col("size").alias("bin"))
    a = cat.withColumnRenamed("item", "anchor").select("anchor", on)
    pos = a.select("anchor", (F.col("anchor") + 1).alias("candidate"))
    return metrics.draw_negatives(a, cat.withColumnRenamed("item", "candidate").select("candidate", on), pos, on=[on]).select("anchor", "candidate")


@query(_negative_sql("slot"))
def negatives_same_slot(spark, sf_dir):
    """A hundred negatives for every item; the sample is the feature."""
    return _negatives(spark, sf_dir, "slot")


@query(_negative_sql("bin"))
def negatives_pop_matched(spark, sf_dir):
    return _negatives(spark, sf_dir, "bin")


@query(f"WITH {_NEGATIVE}, s AS (SELECT a.anchor, p.size AS p, n.size AS s FROM a JOIN pool p ON p.candidate = anchor + 1 JOIN pool n ON n.candidate > anchor + 1 AND n.candidate <= anchor + 40) SELECT anchor, round(count(CASE WHEN s > p THEN 1 END) + 1 + count(CASE WHEN s = p THEN 1 END) / 2, 6) AS rank, round((count(CASE WHEN s < p THEN 1 END) + count(CASE WHEN s = p THEN 1 END) / 2) / count(*), 6) AS auc FROM s GROUP BY 1")
def tie_rank(spark, sf_dir):
    """The rank of one positive among negatives, ties counting half."""
    cat = catalogue(spark, sf_dir).select("item", "size")
    steps = cat.select(F.col("item").alias("anchor"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("d"))
    # the estimate of steps knows nothing of the explode: left to it, all steps would be broadcast
    rows = steps.withColumn("item", F.col("anchor") + F.col("d")).hint("merge").join(cat, "item").select("anchor", F.col("size").cast("double").alias("score"), (F.col("d") == 1).cast("int").alias("label"))
    return metrics.against_negatives(rows, "anchor", "score", "label").select("anchor", F.round("rank", 6).alias("rank"), F.round("auc", 6).alias("auc"))


_FIELDS = f"""{CATALOGUE}, gold AS (SELECT item AS query, 'colour' AS field, colour AS value FROM cat UNION ALL SELECT item, 'garment', garment FROM cat WHERE size > 10),
pred AS (SELECT item AS query, 'colour' AS field, CASE WHEN item % 7 = 0 THEN 'red' ELSE colour END AS value FROM cat WHERE item % 5 <> 0 UNION ALL SELECT item, 'garment', garment FROM cat WHERE size > 20 OR size < 5)"""
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + (fp + fn) / 2 > 0 THEN tp / (tp + (fp + fn) / 2) ELSE 0 END, 6) AS f1"


def _rounded_prf(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in df.columns])


@query(f"WITH {_FIELDS}, c AS (SELECT coalesce(p.field, g.field) AS field, count(CASE WHEN p.value = g.value THEN 1 END) AS tp, count(CASE WHEN p.value IS NOT NULL AND coalesce(p.value <> g.value, true) THEN 1 END) AS fp, count(CASE WHEN g.value IS NOT NULL AND coalesce(p.value <> g.value, true) THEN 1 END) AS fn FROM pred p FULL JOIN gold g ON p.query = g.query AND p.field = g.field GROUP BY 1) SELECT *, {_PRF} FROM c")
def field_prf(spark, sf_dir):
    cat = catalogue(spark, sf_dir).withColumnRenamed("item", "query")
    f = lambda d, n, c: d.select("query", F.lit(n).alias("field"), c.alias("value"))
    gold = f(cat, "colour", F.col("colour")).unionByName(f(cat.where("size > 10"), "garment", F.col("garment")))
    pred = f(cat.where("query % 5 <> 0"), "colour", F.when(F.col("query") % 7 == 0, "red").otherwise(F.col("colour"))).unionByName(f(cat.where("size > 20 OR size < 5"), "garment", F.col("garment")))
    return _rounded_prf(metrics.field_scores(pred, gold))


_MODEL = f"WITH {CATALOGUE}, x AS (SELECT item, product_type AS truth, CASE WHEN item % 6 = 0 THEN 'SMALL' ELSE product_type END AS pred, name FROM cat)"


def _model(spark, sf_dir):
    return catalogue(spark, sf_dir).select("item", F.col("product_type").alias("truth"), F.when(F.col("item") % 6 == 0, "SMALL").otherwise(F.col("product_type")).alias("pred"), "name")


@query(f"{_MODEL} SELECT truth, pred, count(*) AS n FROM x GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_model(spark, sf_dir), "truth", "pred")


@query(f"{_MODEL}, k AS (SELECT DISTINCT truth AS class FROM x UNION SELECT pred FROM x), c AS (SELECT class, count(CASE WHEN truth = class AND pred = class THEN 1 END) AS tp, count(CASE WHEN truth <> class AND pred = class THEN 1 END) AS fp, count(CASE WHEN truth = class AND pred <> class THEN 1 END) AS fn FROM k, x GROUP BY 1) SELECT *, {_PRF} FROM c")
def class_report(spark, sf_dir):
    return _rounded_prf(metrics.class_report(_model(spark, sf_dir), "truth", "pred"))


@query(f"{_MODEL}, c AS (SELECT truth AS class, count(*) AS n FROM x GROUP BY 1) SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return metrics.class_weights(_model(spark, sf_dir), "truth").withColumn("weight", F.round("weight", 6))


@query("SELECT event_type, event_id, CASE WHEN r <= floor(n * 0.12) THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def stratified_split(spark, sf_dir):
    return metrics.stratified_split(read_table(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "event_id", "split")


@query("SELECT c_custkey, CAST('0x' || right(md5(CAST(c_custkey AS VARCHAR)), 1) AS INTEGER) % 2 AS half FROM customer")
def hash_halves(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", metrics.hash_parity(F.col("c_custkey")).alias("half"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '\\s+'), lambda x: x <> '')) AS n FROM documents),
b AS (SELECT doc_id, CASE WHEN n <= 0 THEN NULL WHEN n <= 4 THEN 'short' WHEN n <= 12 THEN 'medium' WHEN n <= 100 THEN 'long' END AS bucket FROM w)
SELECT coalesce(bucket, '(none)') AS bucket, count(*) AS n, round(avg(quality), 6) AS quality FROM b LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def len_bucket_accuracy(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(TX.length_bucket("text"), F.lit("(none)")).alias("bucket"))
    return docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@query("""WITH x AS (SELECT DISTINCT c, v FROM (SELECT 'p_brand' AS c, p_brand AS v FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part))
SELECT c AS "column", count(*) AS n_distinct, round(avg(length(v)), 6) AS mean_length, string_agg(v, '|' ORDER BY v) AS "values" FROM x GROUP BY 1""")
def unique_dump(spark, sf_dir):
    return audits.unique_dump(read_table(spark, sf_dir, "part"), ["p_brand", "p_name", "p_size"])


@query("SELECT coalesce(event_type, '(nan)') AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return audits.value_counts(read_table(spark, sf_dir, "events"), "event_type")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab(spark, sf_dir):
    return audits.crosstab(read_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def group_samples(spark, sf_dir):
    return audits.first_per_group(read_table(spark, sf_dir, "customer"), "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_mktsegment", "c_custkey")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    return audits.dedup_first(read_table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_resume(spark, sf_dir):
    return audits.not_done(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT count(CASE WHEN p_type = 'PROMO' AND p_brand = 'Brand#1' THEN 1 END) AS n_missing, count(*) AS n FROM part")
def all_missing(spark, sf_dir):
    return audits.all_missing(read_table(spark, sf_dir, "part"), ["p_type", "p_brand"], ("PROMO", "Brand#1"))


@query("SELECT source, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS kept, count(*) AS n, round(count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) / count(*), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def pass_rates(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return audits.pass_rates(rows, "source", (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("""WITH t AS (SELECT conv_id, role, length(text) > 60 AS ok FROM conversations), p AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'easy' ELSE 'hard' END AS tier, count(*) AS t, count(CASE WHEN ok THEN 1 END) AS p, bool_and(ok) AS w FROM t GROUP BY 1, 2)
SELECT tier, CAST(sum(t) AS BIGINT) AS turns, CAST(sum(p) AS BIGINT) AS turns_ok, count(*) AS conversations, count(CASE WHEN w THEN 1 END) AS conversations_ok FROM (SELECT * FROM p UNION ALL SELECT conv_id, 'all', t, p, w FROM p) GROUP BY 1""")
def conversation_summary(spark, sf_dir):
    t = read_table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "easy").otherwise("hard").alias("tier"), (F.length("text") > 60).alias("ok"))
    return audits.conversation_summary(t, "conv_id", "tier", "ok")


@query(f"""WITH {POSTINGS}, {GRADES}, a AS {ranked_sql("bms", 50)}, b AS {ranked_sql("tfs", 50)}, f AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2), c AS {ranked_sql("f", 10)},
u AS (SELECT 'bm25' AS method, query, doc, rank FROM a WHERE rank <= 10 UNION ALL SELECT 'tfidf', query, doc, rank FROM b WHERE rank <= 10 UNION ALL SELECT 'rrf', query, doc, rank FROM c)
SELECT method, count(*) AS n, round(avg(coalesce(grade, 0)), 6) AS mean_grade, round(sum(CASE WHEN grade = 2 THEN 1.0 / rank ELSE 0 END), 5) AS weighted FROM u LEFT JOIN gr USING (doc) GROUP BY 1""")
def fusion_ablation(spark, sf_dir):
    """Methods side by side under one key, in one aggregation."""
    scored = written(text_scores(spark, sf_dir), "scores")
    a, b = (sparse.top_k(scored.select("query", "doc", F.col(m).alias("score")).where("score > 0"), 50).withColumn("branch", F.lit(m)) for m in ("bm25", "tfidf"))
    c = fusion.rrf(a.unionByName(b), 10, k=60, base=1).withColumn("branch", F.lit("rrf"))
    u = a.unionByName(b).where("rank <= 10").select("branch", "doc", "rank").unionByName(c.select("branch", "doc", "rank"))
    g = u.join(grades(spark, sf_dir), "doc", "left")
    return g.groupBy(F.col("branch").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("grade", F.lit(0))), 6).alias("mean_grade"), F.round(F.sum(F.when(F.col("grade") == 2, 1.0 / F.col("rank")).otherwise(0.0)), 5).alias("weighted"))


@query(f"""{_MODEL} SELECT count(*) AS n, count(CASE WHEN pred = truth THEN 1 END) AS model_ok, count(CASE WHEN f = truth THEN 1 END) AS final_ok, count(CASE WHEN f = truth AND pred <> truth THEN 1 END) AS helped, count(CASE WHEN f <> truth AND pred = truth THEN 1 END) AS hurt, count(CASE WHEN f <> pred THEN 1 END) AS disagree,
round(avg(CASE WHEN pred = truth THEN c END), 6) AS right_mean, min(CASE WHEN pred = truth THEN c END) AS right_least, round(avg(CASE WHEN pred <> truth THEN c END), 6) AS wrong_mean, max(CASE WHEN pred <> truth THEN c END) AS wrong_most
FROM (SELECT *, CASE WHEN item % 9 = 0 THEN 'PROMO' ELSE pred END AS f, (item * 37 % 100) / 100.0 AS c FROM x)""")
def model_against_rules(spark, sf_dir):
    rows = _model(spark, sf_dir).withColumn("final", F.when(F.col("item") % 9 == 0, "PROMO").otherwise(F.col("pred"))).withColumn("confidence", F.col("item") * 37 % 100 / 100.0)
    return audits.model_against_rules(rows, "truth", "pred", "final", "confidence").withColumns({c: F.round(c, 6) for c in ("right_mean", "wrong_mean")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    t = read_table(spark, sf_dir, "lineitem")
    c = [F.col("l_returnflag"), F.col("l_linestatus")]
    return t.groupingSets([c, [c[1]], []], *c).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.grouping("l_returnflag").cast("long").alias("g"))


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube_rollup(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return read_table(spark, sf_dir, "customer").join(n, "c_nationkey").cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_operations(spark, sf_dir):
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    return c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).intersect(o.select("o_custkey")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_orderkey) OVER w AS after, ntile(4) OVER w AS quarter, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_suite(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("recent"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08) GROUP BY 1")
def semi_anti(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation").where("n_regionkey IN (1, 2)").select(F.col("n_nationkey").alias("s_nationkey"))
    big = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.08").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return s.join(n, "s_nationkey", "left_semi").join(big, "s_suppkey", "left_anti").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT event_id, user_id, ts, event_type FROM events) SELECT a.event_id, max_by(b.event_id, b.event_id) AS last_purchase FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.event_type = 'error' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) GROUP BY 1")
def asof_purchase(spark, sf_dir):
    """The last purchase of the user before each error: an as-of join as one window, without a range join. Ids follow time."""
    e = read_table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'error' AND last_purchase IS NOT NULL").select("event_id", "last_purchase")
