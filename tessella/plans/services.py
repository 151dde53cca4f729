"""Lookups, texts, resolution, dense branches, and the evaluations that compare methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import audits, dense, fusion, graph, metrics, nlu, ordering, profiles, rules, scoring, sparse
from ..sources import tables
from ..sources.stage import written
from ..sources.tables import read_table
from .base import BASKETS, CATALOGUE, POSTINGS, PURCHASES, baskets, catalogue, cobuy, doc_postings, purchases, query, ranked_sql, search_index, text_scores
from .evaluation import _EVAL, _FIELDS, draws_sql
from .graphs import _ADJ, _NPMI, _R, _SIDES, _TOP5, _TWINS, _WALK, _p3, _pairs, _twins
from .graphs import _rules as graph_rules
from .search import _EMB, _knn

_C = F.col
_any = lambda words, c: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


# lookups and texts


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def lookup_by_ids(spark, sf_dir):
    return tables.lookup_ids(_vectors(spark, sf_dir), "vec_id", read_table(spark, sf_dir, "labels").select("doc_id")).select("vec_id", "label")


_CLEAN = lambda c: f"CASE WHEN lower({c}) IN ({', '.join(repr(x) for x in TX.NO_VALUE)}) THEN '' ELSE {c} END"


@query(f"WITH {CATALOGUE}, p AS (SELECT item, {_CLEAN('name')} AS name, {_CLEAN('product_type')} AS product_type, {_CLEAN('colour')} AS colour_group FROM cat) SELECT lpad(CAST(item AS VARCHAR), 10, '0') AS article_id, coalesce(nullif(name, ''), product_type, '') AS name, product_type, colour_group, '/images/000/' || lpad(CAST(item AS VARCHAR), 10, '0') || '.jpg' AS image_path FROM p")
def result_cards(spark, sf_dir):
    """Payloads of the catalogue as result cards."""
    cat = catalogue(spark, sf_dir).withColumn("article_id", _C("item").cast("string"))
    p = tables.payload(cat, {"article_id": "article_id", "name": "name", "product_type": "product_type", "colour": "colour_group"})
    return p.select(*tables.card({"article_id": TX.normalize_article_id("article_id"), "name": _C("name"), "product_type": _C("product_type"), "colour_group": _C("colour_group")}))


_FRACTION = "(CAST('0x' || substr(md5(CAST(item AS VARCHAR) || '42'), 1, 8) AS BIGINT) / 4294967296.0)"


@query(f"""WITH {CATALOGUE}, x AS (SELECT *, {_FRACTION} AS r, CASE WHEN size > 25 THEN 'Summer' ELSE '' END AS season, lower(product_type) AS occasion FROM cat)
SELECT item, name || ' ' || product_type || ' ' || colour || '. ' || garment AS rerank, colour || ' ' || product_type || ' ' || array_to_string(list_slice(regexp_extract_all(name, '[A-Za-z]+'), 1, 12), ' ') AS self,
CASE WHEN r < 0.3 THEN colour || ' ' || garment || ' ' || product_type || ' for ' || occasion WHEN r < 0.5 AND season <> '' THEN season || ' ' || colour || ' ' || garment || ' ' || product_type ELSE colour || ' ' || garment || ' ' || product_type END AS asked FROM x""")
def query_texts(spark, sf_dir):
    """The text that a scorer reads, and two kinds of queries made from attributes."""
    c = catalogue(spark, sf_dir)
    season = F.when(_C("size") > 25, "Summer").otherwise("")
    return c.select("item", TX.rerank_text(["name", "product_type", "colour"], "garment").alias("rerank"), TX.self_query("colour", "product_type", "name").alias("self"), TX.attribute_query("item", "colour", F.lit(""), "garment", "product_type", F.lower("product_type"), season).alias("asked"))


@query(f"WITH {CATALOGUE}, x AS (SELECT item, CASE item % 3 WHEN 0 THEN 'Menswear' WHEN 1 THEN 'Ladieswear' ELSE 'Divided' END AS i, CASE WHEN size > 40 THEN 'Womens ' || name WHEN size < 5 THEN 'Men ' || name ELSE name END AS s FROM cat) SELECT item, CASE WHEN lower(i) = 'menswear' OR s LIKE 'Men %' THEN 'Men' WHEN contains(lower(i), 'ladies') OR s LIKE 'Womens %' THEN 'Women' ELSE '' END AS gender FROM x")
def gender_derivation(spark, sf_dir):
    index = F.element_at(F.array(F.lit("Menswear"), F.lit("Ladieswear"), F.lit("Divided")), (_C("item") % 3 + 1).cast("int"))
    section = F.when(_C("size") > 40, F.concat(F.lit("Womens "), "name")).when(_C("size") < 5, F.concat(F.lit("Men "), "name")).otherwise(_C("name"))
    return catalogue(spark, sf_dir).select("item", TX.gender_of(index, section).alias("gender"))


# vectors


# parameters from the data: a type pair's mask and relation from the means of its two labels, where the pair occurs twice
_PARAMS = f"""{_EMB}, x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), mn AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, round(avg(x), 9) AS x FROM x GROUP BY 1, 2) GROUP BY 1),
nb AS (SELECT a.vec_id, a.label AS ka, b.label AS kb, a.v AS va, b.v AS vb, a.vec_id % 4 AS ba, b.vec_id % 4 AS bb FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
mk AS (SELECT least(ka, kb) AS ka, greatest(ka, kb) AS kb FROM nb GROUP BY ALL HAVING count(*) >= 8), rl AS (SELECT ka, kb FROM nb GROUP BY ALL HAVING count(*) >= 5),
mks AS (SELECT mk.ka, mk.kb, [1 / (1 + exp(-(p[1] + p[2]))) FOR p IN list_zip(a.m, b.m)] AS gate FROM mk JOIN mn a ON a.label = mk.ka JOIN mn b ON b.label = mk.kb), rls AS (SELECT rl.ka, rl.kb, [p[2] - p[1] FOR p IN list_zip(a.m, b.m)] AS rel FROM rl JOIN mn a ON a.label = rl.ka JOIN mn b ON b.label = rl.kb),
y AS (SELECT vec_id % 4 AS band, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), bn AS (SELECT band, list(x ORDER BY i) AS m FROM (SELECT band, i, round(avg(x), 9) AS x FROM y GROUP BY 1, 2) GROUP BY 1)"""
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@query(f"""WITH {_PARAMS} SELECT nb.vec_id, round(list_sum([p[1] * p[2] * coalesce(p[3], 0.5) FOR p IN list_zip(va, vb, gate)]), 6) AS masked, round(-list_sum([(p[1] + coalesce(p[3], 0) - p[2]) * (p[1] + coalesce(p[3], 0) - p[2]) FOR p IN list_zip(va, vb, rel)]), 6) AS translated,
round(list_dot_product(va, vb) * ln(1 + exp(0.5)) + {_COS.format(a='la.m', b='lb.m')} * ln(1 + exp(1)) + {_COS.format(a='xa.m', b='xb.m')} * ln(1 + exp(-1)), 6) AS aspects, round(va[1] / sqrt(list_dot_product(va, va)), 6) AS first, len(va) + len(vb) AS size, gate IS NOT NULL AS has_mask, rel IS NOT NULL AS has_relation
FROM nb LEFT JOIN mks ON mks.ka = least(nb.ka, nb.kb) AND mks.kb = greatest(nb.ka, nb.kb) LEFT JOIN rls ON rls.ka = nb.ka AND rls.kb = nb.kb JOIN mn la ON la.label = nb.ka JOIN mn lb ON lb.label = nb.kb JOIN bn xa ON xa.band = ba JOIN bn xb ON xb.band = bb""")
def vector_scores(spark, sf_dir):
    """Scores of neighbouring ids in masked, translated and aspect spaces, and joined features.

    Masks, relations and aspect vectors are tables made from the data: the sum and the difference of two labels' means,
    and the means themselves. Pairs that are too rare have no mask or relation and take the default.
    """
    e = _vectors(spark, sf_dir).select("vec_id", _C("label").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (_C("vec_id") % 4).alias("band"))

    def means(by):
        each = e.select(_C(by).alias("value"), F.posexplode("v").alias("i", "x")).groupBy("value", "i").agg(F.round(F.avg("x"), 9).alias("x"))
        return each.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))

    labels = written(means("k"), "label-means")
    b = e.select((_C("vec_id") - 1).alias("vec_id"), _C("k").alias("kb"), _C("v").alias("vb"), _C("band").alias("bb"))
    rows = written(e.select("vec_id", _C("k").alias("ka"), _C("v").alias("va"), _C("band").alias("ba")).join(b, "vec_id"), "neighbours")

    def table(x, y, least, name, op):
        found = rows.groupBy(x.alias("kind_a"), y.alias("kind_b")).agg(F.count("*").alias("n")).where(_C("n") >= least)
        found = found.join(labels.select(_C("value").alias("kind_a"), _C("m").alias("p")), "kind_a").join(labels.select(_C("value").alias("kind_b"), _C("m").alias("q")), "kind_b")
        return found.select("kind_a", "kind_b", F.zip_with("p", "q", op).alias(name))

    masks = table(F.least("ka", "kb"), F.greatest("ka", "kb"), 8, "mask", lambda p, q: p + q)
    relations = table(_C("ka"), _C("kb"), 5, "relation", lambda p, q: q - p)
    known = lambda t, x, y, name: t.select(_C("kind_a").alias(x), _C("kind_b").alias(y), F.lit(True).alias(name))
    aspects = labels.select(F.lit("label").alias("aspect"), "value", _C("m").alias("vector")).unionByName(means("band").select(F.lit("band").alias("aspect"), "value", _C("m").alias("vector")))
    x = scoring.translated(scoring.masked(rows.withColumn("residual", V.dot(_C("va"), _C("vb"))), masks), relations)
    x = scoring.aspect_score(scoring.aspect_affinities(x, aspects, {"label": ("ka", "kb"), "band": ("ba", "bb")}), {"residual": 0.5, "label": 1.0, "band": -1.0})
    x = x.withColumn("low", F.least("ka", "kb")).withColumn("high", F.greatest("ka", "kb")).join(known(masks, "low", "high", "has_mask"), ["low", "high"], "left").join(known(relations, "ka", "kb", "has_relation"), ["ka", "kb"], "left")
    both = V.concat_features(_C("va"), _C("vb"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return x.select("vec_id", *[F.round(c, 6).alias(c) for c in ("masked", "translated", "aspects")], F.round(both[0], 6).alias("first"), F.size(both).cast("long").alias("size"), flag("has_mask"), flag("has_relation"))


@query(f"WITH {_EMB}, s AS (SELECT a.vec_id AS span, a.label AS field, b.vec_id AS value, round(list_dot_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 7 = 0 AND b.vec_id % 7 <> 0) SELECT span, value, score FROM s QUALIFY row_number() OVER (PARTITION BY span ORDER BY score DESC, value) = 1")
def span_nearest(spark, sf_dir):
    """The nearest canonical value of each span (every seventh vector) within its field."""
    e = _vectors(spark, sf_dir)
    near = dense.knn(e.where("vec_id % 7 <> 0"), e.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query"), 1, id_col="vec_id", vector_col="embedding", places=6, group_col="label", same_group=True)
    return near.select(_C("query").alias("span"), _C("id").alias("value"), "score")


_SLOT_NAMES = ("top", "bottom", "shoe", "accessory", "outerwear")
_ALLOWED = sorted({(a, b) for p in rules.SLOT_PAIRS for a, b in (p, p[::-1])})


@query(f"""WITH {_EMB}, z AS (SELECT vec_id, v, list_value({', '.join(repr(x) for x in _SLOT_NAMES)})[label % 5 + 1] AS slot FROM e), k(sa, sb) AS (VALUES {', '.join(map(str, _ALLOWED))}),
s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS score FROM z a JOIN k ON a.slot = sa JOIN z b ON b.slot = sb WHERE a.vec_id <> b.vec_id)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 8""")
def complements(spark, sf_dir):
    """For every item the nearest ones of slots that may be worn with its own."""
    slot = F.element_at(F.array(*[F.lit(x) for x in _SLOT_NAMES]), (_C("label") % 5 + 1).cast("int"))
    e = _vectors(spark, sf_dir).withColumn("slot", slot)
    return dense.knn(e, e.withColumnRenamed("vec_id", "query"), 8, id_col="vec_id", vector_col="embedding", places=6, group_col="slot", allowed=_ALLOWED, exclude_self=True)


def _filtered_sql(where: str, k: int = 5) -> str:
    return f"""WITH {_EMB}, {CATALOGUE}, z AS (SELECT vec_id, v, product_type, colour, product_group FROM e JOIN cat ON item = vec_id), s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS score FROM z a JOIN z b ON {where} WHERE a.vec_id <> b.vec_id)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""


def _filtered(spark, sf_dir, same, other=()):
    cat = catalogue(spark, sf_dir).select(_C("item").alias("vec_id"), "product_type", "colour", "product_group")
    e = _vectors(spark, sf_dir).select("vec_id", "embedding").join(cat, "vec_id")
    return dense.knn(e, e.withColumnRenamed("vec_id", "query"), 5, id_col="vec_id", vector_col="embedding", places=6, same=same, other=other, exclude_self=True)


@query(_filtered_sql("a.product_group = b.product_group AND a.colour = b.colour"))
def similar_same_colour(spark, sf_dir):
    """The nearest items of each item's own group and colour: both come from the anchor."""
    return _filtered(spark, sf_dir, ["product_group", "colour"])


@query(_filtered_sql("a.product_group = b.product_group AND a.colour <> b.colour"))
def similar_other_colour(spark, sf_dir):
    """The same group in another colour."""
    return _filtered(spark, sf_dir, ["product_group"], ["colour"])


@query(_filtered_sql("a.colour = b.colour AND a.product_group <> b.product_group AND a.product_type <> b.product_type"))
def similar_other_type(spark, sf_dir):
    """The same colour in another group and type."""
    return _filtered(spark, sf_dir, ["colour"], ["product_group", "product_type"])


_CENTRES = "x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), sm AS (SELECT label, i, round(sum(x), 9) AS x FROM x GROUP BY 1, 2), ce AS (SELECT label, list(x / n ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM sm) GROUP BY 1)"


@query(f"WITH {_EMB}, {_CENTRES}, s AS (SELECT e.vec_id, ce.label, round(list_dot_product(e.v, ce.v), 6) AS score FROM e, ce) SELECT vec_id, label, score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1")
def fuzzy_type_match(spark, sf_dir):
    """The type whose centre is nearest to each item, if it is near enough."""
    e = _vectors(spark, sf_dir)
    centres = dense.mean_vector(e, "label", "embedding").withColumnRenamed("vector", "embedding")
    near = dense.knn(centres, e.select(_C("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), 1, id_col="label", vector_col="embedding", places=6)
    return near.where("score >= 0.2").select(_C("query").alias("vec_id"), _C("id").cast("int").alias("label"), "score")


@query(f"""WITH {POSTINGS}, {_EMB}, docs AS (SELECT doc_id AS doc FROM documents WHERE source <> 'src0'), h AS (SELECT len(v) // 2 AS h FROM e LIMIT 1),
fb AS (SELECT bms.* FROM bms JOIN docs USING (doc) WHERE score > 0), ft AS (SELECT tfs.* FROM tfs JOIN docs USING (doc) WHERE score > 0),
dn2 AS (SELECT item_id AS query, b.vec_id AS doc, round(list_dot_product(list_slice(a.v, 1, h), list_slice(b.v, 1, h)), 9) AS im, round(list_dot_product(list_slice(a.v, h + 1, 2 * h), list_slice(b.v, h + 1, 2 * h)), 9) AS tx FROM benchmark JOIN e a ON a.vec_id = item_id, e b, h WHERE b.vec_id IN (SELECT doc FROM docs)),
im AS (SELECT query, doc, im AS score FROM dn2), tx AS (SELECT query, doc, tx AS score FROM dn2),
u AS (SELECT query, doc, rank FROM {ranked_sql("fb", 40)} UNION ALL SELECT query, doc, rank FROM {ranked_sql("ft", 40)} UNION ALL SELECT query, doc, rank FROM {ranked_sql("im", 40)} UNION ALL SELECT query, doc, rank FROM {ranked_sql("tx", 40)}),
f AS (SELECT query, doc, round(sum(1.0 / (2 + rank)), 9) AS score FROM u GROUP BY 1, 2) SELECT query, doc, round(score, 6) AS score, rank FROM {ranked_sql("f", 10)}""")
def hybrid_dense(spark, sf_dir):
    """Two sparse and two dense branches, a filter in each, fused: the halves of a vector stand for image and text."""
    docs = read_table(spark, sf_dir, "documents").where("source <> 'src0'").select(_C("doc_id").alias("doc"))
    scored = written(text_scores(spark, sf_dir).join(docs, "doc", "left_semi"), "scores")
    branches = {m: scored.select("query", "doc", _C(m).alias("score")).where("score > 0") for m in ("bm25", "tfidf")}
    e = _vectors(spark, sf_dir).select("vec_id", "embedding")
    items = e.join(docs.withColumnRenamed("doc", "vec_id"), "vec_id", "left_semi")
    asked = e.join(read_table(spark, sf_dir, "benchmark").select(_C("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query")
    half = F.floor(F.size("embedding") / 2).cast("int")
    for name, part in (("image", F.slice("embedding", F.lit(1), half)), ("text", F.slice("embedding", half + 1, half))):
        found = dense.knn(items.withColumn("v", part), asked.withColumn("v", part), 40, id_col="vec_id", vector_col="v")
        branches[name] = found.select("query", _C("id").alias("doc"), "score")
    return fusion.hybrid(branches, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_EMB}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS score, a.label = b.label AS same FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
i AS (SELECT query, max(score) AS best FROM s WHERE same GROUP BY 1), o AS (SELECT query, id, score * 10 AS score, id % 10 AS code FROM s WHERE NOT same), t AS (SELECT query, max(score) AS top FROM o GROUP BY 1),
w AS (SELECT t.query FROM t LEFT JOIN i USING (query) WHERE coalesce(best, '-inf'::DOUBLE) < 2 AND top - coalesce(best, '-inf'::DOUBLE) > 2), c AS (SELECT o.* FROM o JOIN w USING (query) QUALIFY row_number() OVER (PARTITION BY query, code ORDER BY score DESC, id) = 1)
SELECT query, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 4""")
def cross_category_suggestions(spark, sf_dir):
    """Items of other types for queries whose own type has no good hit."""
    # the best of the own type, and the best of every code among the others, decide
    near = _knn(spark, sf_dir, k=1, exclude_self=True, group_col="label", same_group=True).select("query", "id", "score")
    other = _knn(spark, sf_dir, k=1, group_col="label", same_group=False, items=_vectors(spark, sf_dir).withColumn("code", _C("vec_id") % 10), per="code").select("query", "id", (_C("score") * 10).alias("score"), "code")
    return fusion.suggest(near.withColumn("code", F.lit(0)), other).select("query", "id", F.round("score", 5).alias("score"), "rank")


# resolution of types, filters and spans


_TERMS = "unnest(list_distinct(regexp_extract_all(lower({}), '[a-z]{{3,}}')))"


@query(f"""WITH {CATALOGUE}, {_EMB}, {_CENTRES}, types AS (SELECT product_type AS type, row_number() OVER (ORDER BY product_type) - 1 AS number, count(*) OVER () AS n FROM (SELECT DISTINCT product_type FROM cat)),
asked AS (SELECT lower(product_type) AS value FROM cat UNION SELECT product_group FROM cat UNION SELECT colour FROM cat UNION SELECT garment FROM cat UNION SELECT name FROM cat UNION SELECT 'vec' || vec_id FROM e),
ex AS (SELECT value, type AS resolved, 1 AS tier FROM asked JOIN types ON lower(type) = lower(value)),
sn AS (SELECT product_group AS value, product_type AS resolved, 2 AS tier FROM (SELECT *, sum(n) OVER (PARTITION BY product_group) AS total FROM (SELECT product_group, product_type, count(*) AS n FROM cat GROUP BY 1, 2)) QUALIFY row_number() OVER (PARTITION BY product_group ORDER BY n DESC, product_type) = 1 AND n / total >= 0.25),
tc AS (SELECT term, type, count(*) AS n FROM (SELECT item, product_type AS type, {_TERMS.format('name')} AS term FROM cat) GROUP BY 1, 2 QUALIFY sum(n) OVER (PARTITION BY term) >= 5),
tq AS (SELECT value, type, sum(n) AS n FROM (SELECT value, {_TERMS.format('value')} AS term FROM asked) JOIN tc USING (term) GROUP BY ALL),
co AS (SELECT value, type AS resolved, 3 AS tier FROM (SELECT *, sum(n) OVER (PARTITION BY value) AS total, row_number() OVER (PARTITION BY value ORDER BY n DESC, type) AS r FROM tq) WHERE r = 1 AND total >= 15 AND n / total >= 0.2),
fz AS (SELECT 'vec' || vec_id AS value, type AS resolved, 4 AS tier FROM (SELECT e.vec_id, ce.label, round(list_dot_product(e.v, ce.v), 6) AS score FROM e, ce QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ce.label) = 1) JOIN types ON number = label % n WHERE score >= 0.2)
SELECT asked.value, arg_min(resolved, tier) AS resolved, coalesce(['exact', 'synonym', 'corpus', 'fuzzy'][min(tier)], 'unresolved') AS source, coalesce(min(tier) <= 3, false) AS hard
FROM asked LEFT JOIN (FROM ex UNION ALL FROM sn UNION ALL FROM co UNION ALL FROM fz) u ON u.value = asked.value GROUP BY 1""")
def type_resolution(spark, sf_dir):
    """Exact name, synonym, corpus majority, or the nearest centre, each for what the ones before have left; what is only near is no hard filter."""
    cat, e = catalogue(spark, sf_dir), _vectors(spark, sf_dir)
    columns = [F.lower("product_type"), _C("product_group"), _C("colour"), _C("garment"), _C("name")]
    asked = cat.select(F.explode(F.array(*columns)).alias("value")).unionByName(e.select(F.concat(F.lit("vec"), "vec_id").alias("value")))
    types = cat.select(_C("product_type").alias("value")).distinct()
    number = written(ordering.numbered(types, ["value"]), "types")
    n = F.count("*").over(Window.partitionBy("product_group", "product_type"))
    share = cat.select("product_group", "product_type", n.alias("n"), F.count("*").over(Window.partitionBy("product_group")).alias("total")).distinct()
    top = share.groupBy("product_group", "total").agg(F.min(F.struct((-_C("n")).alias("n"), "product_type")).alias("best")).where(-_C("best.n") / _C("total") >= 0.25)
    synonyms = top.select(_C("product_group").alias("surface"), _C("best.product_type").alias("value"))
    counts = sparse.term_types(cat, "item", _C("name"), "product_type")

    def corpus(rest):
        terms = rest.select(_C("value").alias("query"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("term"))
        return sparse.majority_type(terms, counts, min_share=0.2).select(_C("query").alias("value"), _C("type").alias("resolved"))

    size = number.agg(F.count("*").alias("n"))
    labels = dense.mean_vector(e, "label", "embedding").crossJoin(F.broadcast(size)).withColumn("idx", _C("label") % _C("n")).join(number.withColumnRenamed("value", "resolved"), "idx")
    vectors = e.select(F.concat(F.lit("vec"), "vec_id").alias("value"), _C("embedding").alias("vector"))
    stages = [
        ("exact", nlu.by_name(types, "value", "value")),
        ("synonym", nlu.by_name(synonyms)),
        ("corpus", corpus),
        ("fuzzy", nlu.by_vector(vectors, labels.select(_C("label").alias("id"), "resolved", "vector"), least=0.2)),
    ]
    return nlu.resolve_chain(asked, stages).withColumn("hard", ~_C("source").isin("fuzzy", "unresolved"))


@query(f"""WITH {CATALOGUE}, f AS (SELECT item AS query, 'colour' AS field, upper(colour) AS value FROM cat UNION ALL SELECT item, 'garment', CASE WHEN item % 3 = 0 THEN garment || 'x' ELSE garment END FROM cat),
v AS (SELECT DISTINCT 'colour' AS field, colour AS value FROM cat UNION SELECT 'garment', garment FROM cat) SELECT query, f.field, v.value, f.value AS asked, v.value IS NOT NULL AS kept FROM f LEFT JOIN v ON f.field = v.field AND lower(f.value) = lower(v.value)""")
def filter_validation(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    f = c.select(_C("item").alias("query"), F.explode(F.create_map(F.lit("colour"), F.upper("colour"), F.lit("garment"), F.when(_C("item") % 3 == 0, F.concat("garment", F.lit("x"))).otherwise(_C("garment")))).alias("field", "value"))
    v = c.select(F.explode(F.create_map(F.lit("colour"), _C("colour"), F.lit("garment"), _C("garment"))).alias("field", "value")).distinct()
    return nlu.valid_filters(f, v)


@query("SELECT vec_id, list_value('a', 'b', 'c', 'd')[list_position(list_slice(embedding, 1, 4), list_max(list_slice(embedding, 1, 4)))] AS label FROM embeddings")
def argmax_labels(spark, sf_dir):
    """The label of the largest of a model's scores."""
    return _vectors(spark, sf_dir).select("vec_id", nlu.argmax_label(F.slice("embedding", 1, 4), ["a", "b", "c", "d"]).alias("label"))


# the colour of a word, from the items that have it
_RGB_OF = "SELECT colour AS value, CAST(floor(avg(size) * 5) AS BIGINT) AS r, count(*) % 256 AS g, CAST(floor(avg(price)) AS BIGINT) % 256 AS b FROM cat GROUP BY 1"


@query(f"""WITH {CATALOGUE}, {_EMB}, rgb AS ({_RGB_OF}), canon AS (SELECT colour AS value FROM (SELECT colour, count(*) AS n, avg(count(*)) OVER () AS mean FROM cat GROUP BY 1) WHERE n > mean), cn AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS number, count(*) OVER () AS n FROM canon),
spans AS (SELECT DISTINCT colour AS value FROM cat UNION SELECT DISTINCT upper(name) FROM cat),
ex AS (SELECT s.value, c.value AS resolved, 1 AS tier FROM spans s JOIN canon c ON lower(s.value) = lower(c.value)),
wd AS (SELECT value, resolved, 2 AS tier FROM (SELECT s.value, c.value AS resolved, row_number() OVER (PARTITION BY s.value ORDER BY length(c.value) DESC, list_position(string_split(lower(s.value), ' '), lower(c.value)), c.value) AS r FROM spans s JOIN canon c ON list_contains(string_split(lower(s.value), ' '), lower(c.value))) WHERE r = 1),
nr AS (SELECT value, resolved, 3 AS tier FROM (SELECT x.value, y.value AS resolved, row_number() OVER (PARTITION BY x.value ORDER BY (x.r - y.r) ** 2 + (x.g - y.g) ** 2 + (x.b - y.b) ** 2, y.value) AS k FROM rgb x JOIN rgb y ON y.value IN (SELECT value FROM canon)) WHERE k = 1),
u AS (SELECT value, arg_min(resolved, tier) AS linked, ['exact', 'word', 'colour'][min(tier)] AS source FROM (FROM ex UNION ALL FROM wd UNION ALL FROM nr) GROUP BY 1),
own AS (SELECT vec_id AS item, cn.value AS colour FROM e JOIN cn ON number = label % n)
SELECT item, coalesce(own.colour, a.linked, cat.colour) AS colour, own.colour IS NOT NULL AS given, garment, a.linked AS linked, a.source AS source, coalesce(b.source, 'unresolved') AS span_source FROM cat LEFT JOIN own USING (item) LEFT JOIN u a ON a.value = cat.colour LEFT JOIN u b ON b.value = upper(name)""")
def fill_and_link(spark, sf_dir):
    """Spans linked to the catalogue's commoner colours: by name, by a word inside, by the nearest colour; then fields that a model left out are filled.

    The model's answers are the labels of the items that have a vector.
    """
    cat = catalogue(spark, sf_dir)
    n = cat.groupBy("colour").agg(F.count("*").alias("n"), F.floor(F.avg("size") * 5).alias("r"), (F.count("*") % 256).alias("g"), (F.floor(F.avg("price")) % 256).alias("b"))
    n = written(n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))), "colours")
    canon = n.where("n > mean").select(_C("colour").alias("surface"), _C("colour").alias("value"), "r", "g", "b")
    spans = cat.select(F.explode(F.array(_C("colour"), F.upper("name"))).alias("value"))
    stages = [("exact", nlu.by_name(canon)), ("word", nlu.by_word(canon)), ("colour", nlu.by_colour(n.select(_C("colour").alias("value"), "r", "g", "b"), canon.select(_C("value").alias("resolved"), "r", "g", "b")))]
    linked = written(nlu.resolve_chain(spans, stages), "linked")
    number = written(ordering.numbered(canon.select("value"), ["value"]), "canonical")
    size = number.agg(F.count("*").alias("n"))
    model = _vectors(spark, sf_dir).crossJoin(F.broadcast(size)).withColumn("idx", _C("label") % _C("n")).join(number, "idx").select(_C("vec_id").alias("item"), F.create_map(F.lit("colour"), "value").alias("own"))
    x = cat.join(model, "item", "left").join(linked.select(_C("value").alias("colour"), _C("resolved").alias("linked"), "source"), "colour").join(linked.select(_C("value").alias("span"), _C("source").alias("span_source")), F.upper("name") == _C("span"))
    own = F.coalesce("own", F.create_map().cast("map<string,string>"))
    m = nlu.fill_missing(own, F.create_map(F.lit("colour"), F.coalesce("linked", "colour"), F.lit("garment"), _C("garment")))
    return x.select("item", F.element_at(m, "colour").alias("colour"), F.map_contains_key(own, "colour").alias("given"), F.element_at(m, "garment").alias("garment"), "linked", "source", "span_source")


@query(f"""WITH {POSTINGS}, q2 AS (SELECT query, term FROM qt JOIN benchmark ON query = item_id WHERE term <> regexp_extract(lower(text), '[a-z0-9]+')),
b2 AS (SELECT query, doc, round(sum(weight), 9) AS score FROM q2 JOIN bm USING (term) GROUP BY 1, 2), tops AS (SELECT query, doc, rank FROM {ranked_sql("b2", 10)}), d AS (SELECT doc_id AS doc, lang FROM documents)
SELECT query, arg_min(doc, rank) AS doc, min(rank) AS rank FROM tops JOIN d USING (doc) WHERE lang <> 'en' GROUP BY 1""")
def anchor_search(spark, sf_dir):
    """The first hit of another slot (here: language) than the target's, for the query without the target's word."""
    first = F.array(F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0))
    asked = read_table(spark, sf_dir, "benchmark").select(_C("item_id"), TX.words_alnum("text").alias("w"), first.alias("gone"))
    terms = asked.select(_C("item_id").alias("query"), F.explode(F.array_except("w", "gone")).alias("term"))
    scored = search_index(spark, sf_dir).scores(terms).select("query", "doc", _C("bm25").alias("score")).where("score > 0")
    slots = read_table(spark, sf_dir, "documents").select(_C("doc_id").alias("doc"), _C("lang").alias("slot"))
    return fusion.first_of_other_slot(sparse.top_k(scored, 10), slots, asked.select(_C("item_id").alias("query"), F.lit("en").alias("slot")))


# rules, checks and reports


_UNWANTED = ("anvil", "gizmo")


@query(f"""WITH {BASKETS}, {CATALOGUE}, {_SIDES} SELECT item_a, item_b, NOT (gra IN ('anvil', 'gizmo') OR grb IN ('anvil', 'gizmo')) AS wanted, (ga = '' OR gb = '' OR ga = gb) AS same_index, ga = gb AS strict_index,
substr(lpad(CAST(item_a AS VARCHAR), 10, '0'), 1, 6) <> substr(lpad(CAST(item_b AS VARCHAR), 10, '0'), 1, 6) AS style, NOT (({_any(rules.WINTER, "ca")} AND {_any(rules.SUMMER, "cb")}) OR ({_any(rules.SUMMER, "ca")} AND {_any(rules.WINTER, "cb")})) AS season,
NOT ((ta = 'PROMO' AND tb = 'ECONOMY') OR (ta = 'ECONOMY' AND tb = 'PROMO')) AS section, NOT (gra IN ('anvil', 'gizmo') OR grb IN ('anvil', 'gizmo')) AND (ga = '' OR gb = '' OR ga = gb) AS minimal FROM pp""")
def rule_flags(spark, sf_dir):
    """The rules that the builder's modes ask for, each as a column."""
    c = _C
    r = {
        "wanted": rules.wanted_groups(c("garment_a"), c("garment_b"), _UNWANTED), "index": rules.same_index(c("product_group_a"), c("product_group_b")),
        "style": rules.different_style(c("item_a").cast("string"), c("item_b").cast("string")), "season": rules.seasons_compatible(c("colour_a"), c("colour_b")),
        "section": ~rules.sections_conflict(c("product_type_a"), c("product_type_b"), ["PROMO"], ["ECONOMY"]),
    }
    strict = rules.same_index(c("product_group_a"), c("product_group_b"), strict=True)
    return _pairs(spark, sf_dir).select("item_a", "item_b", r["wanted"].alias("wanted"), r["index"].alias("same_index"), strict.alias("strict_index"), r["style"].alias("style"), r["season"].alias("season"), r["section"].alias("section"), rules.content_filter(r, "minimal").alias("minimal"))


_STYLE = "substr(lpad(CAST(item_a AS VARCHAR), 10, '0'), 1, 9) <> substr(lpad(CAST(item_b AS VARCHAR), 10, '0'), 1, 9)"
_MODE_SQL = {
    "wanted": "NOT (gra IN ('anvil', 'gizmo') OR grb IN ('anvil', 'gizmo'))", "index": "(ga = '' OR gb = '' OR ga = gb)", "style": f"({_STYLE})", "strict_type": "ta <> tb",
    "season": f"NOT (({_any(rules.WINTER, 'ca')} AND {_any(rules.SUMMER, 'cb')}) OR ({_any(rules.SUMMER, 'ca')} AND {_any(rules.WINTER, 'cb')}))",
    "section": "NOT ((ta = 'PROMO' AND tb = 'ECONOMY') OR (ta = 'ECONOMY' AND tb = 'PROMO'))",
} | _R


@query(f"WITH {BASKETS}, {CATALOGUE}, {_SIDES} " + " UNION ALL ".join(f"SELECT '{mode}' AS mode, count(*) AS kept, sum(weight) AS weight FROM pp WHERE " + (" AND ".join(f"({_MODE_SQL[r]})" for r in needs) or "true") for mode, needs in rules.MODES.items()))
def filter_modes(spark, sf_dir):
    """How many edges, and what weight, each of the five modes of the content filter keeps, in one pass."""
    c = _C
    own = lambda x: F.substring(F.lpad(c(x).cast("string"), 10, "0"), 1, 9)
    flags = graph_rules() | {
        "wanted": rules.wanted_groups(c("garment_a"), c("garment_b"), _UNWANTED), "index": rules.same_index(c("product_group_a"), c("product_group_b")), "style": own("item_a") != own("item_b"),
        "season": rules.seasons_compatible(c("colour_a"), c("colour_b")), "section": ~rules.sections_conflict(c("product_type_a"), c("product_type_b"), ["PROMO"], ["ECONOMY"]), "strict_type": c("product_type_a") != c("product_type_b"),
    }
    modes = F.array(*[F.when(rules.content_filter(flags, m), F.lit(m)) for m in rules.MODES])
    return _pairs(spark, sf_dir).select("weight", F.explode(F.array_compact(modes)).alias("mode")).groupBy("mode").agg(F.count("*").alias("kept"), F.sum("weight").alias("weight"))


@query(f"""WITH {BASKETS}, {CATALOGUE}, {_ADJ}, s AS (SELECT item, product_type, CASE WHEN colour = 'hot' THEN 'Spring/Summer' WHEN colour = 'cold' THEN 'Autumn/Winter' ELSE '' END AS season FROM cat),
j AS (SELECT item_a, item_b, weight, b.product_type, row_number() OVER (PARTITION BY item_a, b.product_type ORDER BY weight DESC, item_b) AS r FROM adj JOIN s a ON item_a = a.item JOIN s b ON item_b = b.item WHERE NOT ((a.season = 'Spring/Summer' AND b.season = 'Autumn/Winter') OR (a.season = 'Autumn/Winter' AND b.season = 'Spring/Summer')))
SELECT item_a, item_b, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY weight DESC, item_b) AS rank FROM j WHERE r <= 2) WHERE rank <= 8""")
def diverse_in_season(spark, sf_dir):
    """Neighbours under caps, without those that clash in season."""
    meta = catalogue(spark, sf_dir).withColumn("season", F.when(_C("colour") == "hot", "Spring/Summer").when(_C("colour") == "cold", "Autumn/Winter").otherwise(""))
    return graph.diverse_neighbors(graph.adjacency(cobuy(spark, sf_dir)), meta, key="item", type_col="product_type", season_col="season")


@query(f"WITH {BASKETS}, {CATALOGUE}, {_SIDES} SELECT item_a, item_b, CASE WHEN NOT (contains(lower(ta), lower(tb)) OR contains(lower(tb), lower(ta))) THEN 0 WHEN ca = cb THEN 2 ELSE 1 END AS grade FROM pp")
def relevance_grades(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_a", "item_b", metrics.relevance_grade(metrics.lenient_match(_C("product_type_a"), _C("product_type_b")), _C("colour_a") == _C("colour_b")).alias("grade"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, count(CASE WHEN role IN ('user', 'assistant') THEN 1 END) AS known, count(CASE WHEN role = 'user' THEN 1 END) AS users, count(CASE WHEN role = 'system' THEN 1 END) AS systems, bool_or(turn = 1) AS second, arg_min(role, turn) AS first FROM conversations GROUP BY 1)
SELECT conv_id, n >= 3 AS enough, known = n AS all_known, systems = 0 AS no_system, users >= 0.5 * n AS half_user, lower(first) = 'user' AS starts, users > 0 AND n > users AS path, lower(first) = 'user' AS pairs FROM c""")
def exam_checks(spark, sf_dir):
    """Kinds of checks over the turns of each conversation, as columns."""
    turns = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    r = _C("r")
    first = F.get(r, F.lit(0))["role"]
    roles = F.transform(r, lambda x: x["role"])
    check = lambda kind, **o: audits.check_results(r, kind, **o)
    return turns.select(
        "conv_id", check("min", least=3).alias("enough"), check("all_in", field="role", values=["user", "assistant"]).alias("all_known"), check("none_in", field="role", values=["system"]).alias("no_system"),
        check("frac_in", field="role", values=["user"], least=0.5).alias("half_user"), audits.check_value(first, "equals", "user").alias("starts"),
        audits.check_path(F.transform(roles, lambda x: F.when(x == "user", "user").otherwise("other")), ["user", "other"]).alias("path"), audits.check_pairs(F.create_map(F.lit("first"), first), F.create_map(F.lit("first"), F.lit("user"))).alias("pairs"),
    )


@query("SELECT event_type AS label, CAST(user_id % 3 AS VARCHAR) AS bucket, count(*) AS rows, CAST(ceil(count(*) / 20) AS BIGINT) AS calls FROM events GROUP BY 1, 2")
def generation_plan(spark, sf_dir):
    t = read_table(spark, sf_dir, "events").groupBy(_C("event_type").alias("label"), (_C("user_id") % 3).cast("string").alias("bucket")).agg(F.count("*").alias("rows"))
    return audits.call_plan(t, 20)


@query(f"WITH {POSTINGS} SELECT * FROM (SELECT 'head' AS part, term, df, row_number() OVER (ORDER BY df DESC, term) AS place FROM dfs QUALIFY place <= 10 UNION ALL SELECT 'tail', term, df, row_number() OVER (ORDER BY df, term) AS place FROM dfs QUALIFY place <= 10 UNION ALL SELECT 'match', term, df, row_number() OVER (ORDER BY df DESC, term) AS place FROM dfs WHERE contains(term, 'th') QUALIFY place <= 10)")
def vocab_inspect(spark, sf_dir):
    return sparse.inspect(sparse.document_frequency(doc_postings(spark, sf_dir)), 10, "th")


@query(f"WITH {CATALOGUE}, o AS (SELECT item, row_number() OVER (PARTITION BY product_type ORDER BY price DESC, item) AS rank FROM cat QUALIFY rank <= 5) SELECT item, coalesce(rank, 1000000) AS rank FROM cat LEFT JOIN o USING (item)")
def rank_merge(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    order = c.withColumn("rank", F.row_number().over(Window.partitionBy("product_type").orderBy(F.desc("price"), "item"))).where("rank <= 5")
    return fusion.reorder(c.select("item"), order, "item")


# graphs


@query(f"WITH {BASKETS}, {_ADJ}, d AS (SELECT item_a AS item, count(*) AS degree FROM adj GROUP BY 1) SELECT item_a, item_b, round(1.0 / sqrt(a.degree * b.degree), 6) AS weight FROM cobuy JOIN d a ON item_a = a.item JOIN d b ON item_b = b.item")
def edge_sampling_weights(spark, sf_dir):
    e = cobuy(spark, sf_dir)
    d = graph.degrees(e)
    x = e.join(d.select(_C("item").alias("item_a"), _C("degree").alias("da")), "item_a").join(d.select(_C("item").alias("item_b"), _C("degree").alias("db")), "item_b")
    return x.select("item_a", "item_b", F.round(graph.sampling_weight(_C("da"), _C("db")), 6).alias("weight"))


@query(f"WITH {BASKETS}, {CATALOGUE}, w AS (SELECT item_a AS item FROM cobuy UNION SELECT item_b FROM cobuy), n AS (SELECT count(*) AS nodes, count(w.item) AS warm FROM cat LEFT JOIN w ON cat.item = w.item) SELECT nodes, warm, nodes - warm AS cold, round(100.0 * warm / nodes, 4) AS coverage, (SELECT min(weight) FROM cobuy) AS least, (SELECT median(weight) FROM cobuy) AS middle, (SELECT max(weight) FROM cobuy) AS most FROM n")
def compat_stats(spark, sf_dir):
    return graph.coverage_stats(cobuy(spark, sf_dir), catalogue(spark, sf_dir).select("item"))


@query(f"WITH {CATALOGUE}, n AS (SELECT product_type, count(*) AS n FROM cat GROUP BY 1) SELECT product_type, n, CAST(coalesce(sum(n) OVER (ORDER BY product_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def sampling_partitions(spark, sf_dir):
    return graph.partitions(catalogue(spark, sf_dir), "product_type")


_TWO = f"""{BASKETS}, {_ADJ}, {_EMB}, a5 AS (SELECT item_a AS item, item_b AS other, row_number() OVER (PARTITION BY item_a ORDER BY weight DESC, item_b) AS rank FROM adj QUALIFY rank <= 5),
k0 AS (SELECT a.vec_id AS item, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id), k5 AS (SELECT item, other, row_number() OVER (PARTITION BY item ORDER BY greatest(floor(s * 1000), 0) DESC, other) AS rank FROM k0 QUALIFY rank <= 5)"""


def _two(spark, sf_dir):
    a = graph.top_edges(graph.adjacency(cobuy(spark, sf_dir)), 5, "cobuy")
    return a, graph.top_edges(dense.knn_graph(_vectors(spark, sf_dir), 5, id_col="vec_id", vector_col="embedding", by_weight=True), 5, "vector")


@query(f"WITH {_TWO} SELECT 'cobuy' AS method, item, other, rank FROM a5 UNION ALL SELECT 'vector', item, other, rank FROM k5")
def side_by_side(spark, sf_dir):
    """The first five neighbours of every item by two methods."""
    a, b = _two(spark, sf_dir)
    return a.unionByName(b)


@query(f"WITH {_TWO} SELECT a5.item, a5.other AS one, k5.other AS two FROM a5 JOIN k5 ON a5.item = k5.item AND a5.rank = 1 AND k5.rank = 1 WHERE a5.other <> k5.other AND floor(a5.other / 10) <> floor(k5.other / 10)")
def method_disagreements(spark, sf_dir):
    """Items whose first neighbours differ by two methods, in another family of ids too."""
    a, b = _two(spark, sf_dir)
    return graph.disagreements(a, b, lambda x: F.floor(x / 10))


@query(f"WITH {BASKETS}, {_NPMI}, v AS (SELECT 'cobuy' AS variant, item_a, item_b, weight FROM cobuy UNION ALL SELECT 'npmi', item_a, item_b, v * 1000 FROM e WHERE v >= 0), n AS (SELECT variant, item_a AS i FROM v UNION SELECT variant, item_b FROM v) SELECT variant, count(*) AS edges, round(avg(weight), 4) AS mean_weight, (SELECT count(*) FROM n WHERE n.variant = v.variant) AS nodes FROM v GROUP BY 1")
def variant_profiles(spark, sf_dir):
    """Profiles of two ways to weigh edges, under one key."""
    b = baskets(spark, sf_dir)
    v = [graph.edges(b, method=m, min_count=2).select(F.lit(m).alias("variant"), "item_a", "item_b", "weight") for m in ("cobuy", "npmi")]
    v = v[0].unionByName(v[1])
    nodes = v.select("variant", F.explode(F.array("item_a", "item_b")).alias("i")).distinct().groupBy("variant").agg(F.count("*").alias("nodes"))
    return v.groupBy("variant").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("mean_weight")).join(nodes, "variant")


@query(f"""WITH {BASKETS}, {_ADJ}, {_TWINS}, tp AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, twin) AS place FROM tw),
b AS (SELECT item, item_b AS doc, max(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END) AS one, sum(similarity) AS al FROM tp JOIN adj ON twin = item_a WHERE item <> item_b GROUP BY 1, 2),
bt AS (SELECT item, doc, one, al, coalesce(0.01 * round(list_dot_product(x.v, y.v), 6), 0) AS extra FROM b LEFT JOIN e x ON x.vec_id = item LEFT JOIN e y ON y.vec_id = doc),
bm AS (SELECT 'one' AS method, item, doc, round(one + extra, 9) AS score FROM bt UNION ALL SELECT 'all', item, doc, round(al + extra, 9) FROM bt),
r AS (SELECT method, item, doc, row_number() OVER (PARTITION BY method, item ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 10), t AS (SELECT item_a AS item, item_b AS doc FROM adj WHERE item_a % 4 = 0), n AS (SELECT item, count(*) AS n FROM t GROUP BY 1)
SELECT method, n.item, round(count(t.doc) / max(n.n), 6) AS recall FROM r JOIN n USING (item) LEFT JOIN t ON t.item = r.item AND t.doc = r.doc GROUP BY 1, 2""")
def borrow_evaluation(spark, sf_dir):
    """How many of a cold item's true neighbours its twins' neighbours hold, by the closest twin or by all of them."""
    adj = graph.adjacency(cobuy(spark, sf_dir))
    vectors = _vectors(spark, sf_dir).select(_C("vec_id").alias("key"), _C("embedding").alias("vector"))
    b = written(graph.borrow_scores(_twins(spark, sf_dir), adj, F.round(V.dot(_C("own"), _C("other")), 6), vectors), "borrow-scores")
    truth = adj.where("item_a % 4 = 0").select(_C("item_a").alias("query"), _C("item_b").alias("doc"))
    found = []
    for method in ("one", "all"):
        ranked = sparse.top_k(b.select(_C("item").alias("query"), _C("neighbour").alias("doc"), _C(method).alias("score")), 10)
        found.append(metrics.at_k(ranked, truth, 10).select(F.lit(method).alias("method"), _C("query").alias("item"), F.round("recall", 6).alias("recall")))
    return found[0].unionByName(found[1])


_FIT = f"""z AS (SELECT vec_id, v, list_value({', '.join(repr(x) for x in _SLOT_NAMES)})[label % 5 + 1] AS slot FROM e), al(sa, sb) AS (VALUES {', '.join(map(str, _ALLOWED))}),
cp AS (SELECT a.vec_id AS item, b.vec_id AS candidate, round(list_dot_product(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM z a JOIN al ON a.slot = sa JOIN z b ON b.slot = sb WHERE a.vec_id <> b.vec_id QUALIFY rank <= 20)"""


@query(f"""WITH {BASKETS}, {_ADJ}, {_WALK.removeprefix(PURCHASES + ", ")}, {_TWINS}, {_FIT}, own AS (SELECT vec_id AS item FROM e),
bo AS (SELECT item, item_b AS candidate, round(sum(similarity), 9) AS score FROM tw JOIN adj ON twin = item_a WHERE item <> item_b GROUP BY 1, 2),
rk AS (SELECT item, candidate, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS rank FROM bo UNION ALL SELECT item, candidate, rank FROM cp),
p4 AS (SELECT item_a AS item, item_b AS candidate, weight AS score FROM p3 UNION ALL SELECT item_b, item_a, weight FROM p3),
c AS (SELECT item_a AS item, item_b AS candidate, weight AS score, 1 AS tier FROM adj UNION ALL SELECT item, candidate, round(sum(1.0 / (59 + rank)), 9), 2 FROM rk GROUP BY 1, 2 UNION ALL SELECT *, 3 FROM p4 UNION ALL SELECT *, 4 FROM bo UNION ALL SELECT item, candidate, score, 5 FROM cp),
ti AS (SELECT c.*, min(tier) OVER (PARTITION BY item) AS least FROM c JOIN own USING (item))
SELECT item, candidate, round(score, 5) AS score, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS rank FROM ti WHERE tier = least) WHERE rank <= 8""")
def cold_tiers(spark, sf_dir):
    """Co-buy; else borrowed and complements fused; else the walk; else borrowed; else complements: the first that has any."""
    # read for the neighbours of twins and as the first tier
    adj = written(graph.adjacency(cobuy(spark, sf_dir)), "adjacency")
    own = _vectors(spark, sf_dir).select(_C("vec_id").alias("item"))
    three = lambda d, a, b, s: d.select(_C(a).alias("item"), _C(b).alias("candidate"), _C(s).alias("score"))
    borrowed = written(three(graph.borrowed_neighbors(_twins(spark, sf_dir), adj), "item", "neighbour", "score"), "borrowed")
    slot = F.element_at(F.array(*[F.lit(x) for x in _SLOT_NAMES]), (_C("label") % 5 + 1).cast("int"))
    e = _vectors(spark, sf_dir).withColumn("slot", slot)
    fit = written(dense.knn(e, e.withColumnRenamed("vec_id", "query"), 20, id_col="vec_id", vector_col="embedding", places=6, group_col="slot", allowed=_ALLOWED, exclude_self=True), "complements")
    first = sparse.top_k(borrowed.withColumnRenamed("item", "query"), None, item="candidate")
    ranked = first.select("query", _C("candidate").alias("doc"), "rank").unionByName(fit.select("query", _C("id").alias("doc"), "rank"))
    fused = three(fusion.rrf(ranked, None, k=60, base=0), "query", "doc", "score")
    found = written(graph.first_tier([t.join(own, "item", "left_semi") for t in (three(adj, "item_a", "item_b", "weight"), fused)]), "tiers")
    # later tiers are for the items that the first two have left, and not made if those have left none
    left = written(own.join(found.select("item"), "item", "left_anti"), "left")
    if not left.isEmpty():
        walk = three(graph.both_ways(_p3(spark, sf_dir)), "item_a", "item_b", "weight")
        rest = graph.first_tier([t.join(left, "item", "left_semi") for t in (walk, borrowed, three(fit, "query", "id", "score"))])
        found = found.unionByName(rest.withColumn("tier", _C("tier") + 2))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("item", "candidate", F.round("score", 5).alias("score"), "tier", "rank")


# evaluation


def _lines_near(spark, sf_dir, asked):
    """The purchases (customer, day, item) of the customers and days that bought any of asked (query): few, where few are asked."""
    lines = read_table(spark, sf_dir, "lineitem").select(_C("l_orderkey").alias("key"), _C("l_partkey").alias("item"))
    orders = read_table(spark, sf_dir, "orders").select(_C("o_orderkey").alias("key"), _C("o_custkey").alias("customer"), _C("o_orderdate").cast("date").alias("day"))
    # written tables have a known size, by which the optimiser joins them to what it scans
    hit = written(lines.join(asked, _C("item") == _C("query"), "left_semi").select("key").distinct(), "orders-hit")
    days = written(orders.join(hit, "key", "left_semi").select("customer", "day").distinct(), "days-hit")
    near = written(orders.join(days, ["customer", "day"], "left_semi"), "orders-near")
    return lines.join(near, "key").select("customer", "day", "item")


@query(f"WITH {_EVAL}, {BASKETS}, f AS (SELECT query, min(rank) AS r FROM jj WHERE hit = 1 GROUP BY 1), rr AS (SELECT query, coalesce(1.0 / r, 0) AS rr FROM nt LEFT JOIN f USING (query)), g AS (SELECT CASE WHEN query IN (SELECT item_a FROM cobuy UNION SELECT item_b FROM cobuy) THEN 'warm' ELSE 'cold' END AS grp, rr FROM rr UNION ALL SELECT 'overall', rr FROM rr) SELECT grp, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN rr >= 0.2 THEN 1.0 ELSE 0 END), 6) AS hit_at_5 FROM g GROUP BY 1")
def mrr_by_group(spark, sf_dir):
    """Reciprocal ranks of warm queries, whose item is in the co-buy graph, of cold ones, and of all."""
    # both rankings in one pass over the postings
    both = F.explode(F.create_map(F.lit("bm25"), F.col("bm25"), F.lit("tfidf"), F.col("tfidf"))).alias("method", "score")
    scored = text_scores(spark, sf_dir).select("query", "doc", both).where("score > 0")
    w = Window.partitionBy("method", "query").orderBy(F.desc("score"), "doc")
    top = written(scored.withColumn("rank", F.row_number().over(w)).where("rank <= 20"), "ranked")
    ranked, truth = top.where("method = 'bm25'"), top.where("method = 'tfidf' AND rank <= 5")
    asked = written(truth.select("query").distinct(), "asked")
    warm = graph.bought_together(_lines_near(spark, sf_dir, asked), asked).select(_C("item").alias("query"), F.lit("warm").alias("grp"))
    rr = metrics.reciprocal_rank(ranked, truth).join(warm, "query", "left").fillna("cold", ["grp"])
    return metrics.with_overall(rr, "grp").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg((_C("rr") >= 0.2).cast("double")), 6).alias("hit_at_5"))


@query(f"WITH {BASKETS}, {CATALOGUE}, {_SIDES} SELECT item_a, item_b FROM pp WHERE ta <> '' AND ta <> tb")
def cross_type_truth(spark, sf_dir):
    return metrics.cross_type(_pairs(spark, sf_dir), "product_type_a", "product_type_b").select("item_a", "item_b")


@query(f"WITH {BASKETS} SELECT customer, CAST(day AS VARCHAR) AS day FROM bas ORDER BY md5(CAST(customer AS VARCHAR) || '|' || CAST(day AS VARCHAR) || '42'), CAST(customer AS VARCHAR) || '|' || CAST(day AS VARCHAR) LIMIT 300")
def test_baskets(spark, sf_dir):
    """A sample of baskets to evaluate on; the same on every run."""
    b = baskets(spark, sf_dir).select("customer", _C("day").cast("string").alias("day"))
    return audits.hash_sample(b, F.concat_ws("|", _C("customer").cast("string"), "day"), 300)


@query(f"""WITH {_EMB}, {CATALOGUE}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT query, id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10)
SELECT query, round(count(CASE WHEN q.colour = i.colour THEN 1 END) / 10, 6) AS colour, round(count(CASE WHEN q.product_type = i.product_type THEN 1 END) / 10, 6) AS product_type, max(CASE WHEN q.colour = i.colour AND q.product_type = i.product_type THEN 1 ELSE 0 END) AS hit FROM r JOIN cat q ON q.item = query JOIN cat i ON i.item = id GROUP BY 1""")
def failsafe_at_10(spark, sf_dir):
    """Colour, type and both of the first ten neighbours."""
    near = _knn(spark, sf_dir, exclude_self=True)
    return metrics.attribute_shares(near, catalogue(spark, sf_dir).withColumnRenamed("item", "id"), ["colour", "product_type"])


@query(f"""WITH {CATALOGUE}, a AS (SELECT item AS anchor, product_type, 0 AS every FROM cat), pool AS (SELECT item AS candidate, product_type, 0 AS every FROM cat)
SELECT anchor, candidate, 'random' AS kind FROM {draws_sql('a', 'pool', 'every', 50, where='candidate <> anchor + 1')} UNION ALL SELECT anchor, candidate, 'hard' FROM {draws_sql('a', 'pool', 'product_type', 50, where='candidate <> anchor + 1')}""")
def negatives_hard_random(spark, sf_dir):
    """Half of the negatives from the anchor's slot, half from anywhere."""
    cat = catalogue(spark, sf_dir).select("item", "product_type")
    anchors, pool = cat.withColumnRenamed("item", "anchor"), cat.withColumnRenamed("item", "candidate")
    positives = anchors.select("anchor", (_C("anchor") + 1).alias("candidate"))
    found = [metrics.draw_negatives(anchors, pool, positives, on=on, k=50).select("anchor", "candidate", F.lit(kind).alias("kind")) for kind, on in (("random", []), ("hard", ["product_type"]))]
    return found[0].unionByName(found[1])


@query(f"""WITH {PURCHASES}, c AS (SELECT item, CAST(floor(log2(count(*) + 1)) AS INTEGER) AS band FROM pur GROUP BY 1), s AS (SELECT band, count(*) AS size FROM c GROUP BY 1),
near AS (SELECT item AS target, band FROM c JOIN s USING (band) WHERE size > 20), far AS (SELECT item AS target, 0 AS every FROM c JOIN s USING (band) WHERE size <= 20), pool AS (SELECT item AS candidate, band, 0 AS every FROM c)
SELECT target, candidate FROM {draws_sql('near', 'pool', 'band', 20, 'target')} UNION ALL SELECT target, candidate FROM {draws_sql('far', 'pool', 'every', 20, 'target')}""")
def personal_negatives(spark, sf_dir):
    """Negatives from a target's band of popularity; from all items where the band is small."""
    n = purchases(spark, sf_dir).groupBy("item").agg(graph.degree_bin(F.count("*")).alias("band"))
    return metrics.banded_negatives(n.withColumnRenamed("item", "target"), n.withColumnRenamed("item", "candidate"), "band", k=20).select("target", "candidate")


@query(f"""WITH {_FIELDS}, backup AS (SELECT item AS query, 'colour' AS field, colour AS value FROM cat WHERE item % 10 = 0 UNION ALL SELECT item, 'garment', garment FROM cat WHERE size BETWEEN 5 AND 20),
en AS (SELECT * FROM pred UNION ALL SELECT b.* FROM backup b LEFT JOIN pred p ON b.query = p.query AND b.field = p.field WHERE p.query IS NULL),
m AS (SELECT 'recognition' AS scoring, query, field, 'x' AS value, 'p' AS side FROM pred UNION ALL SELECT 'recognition', query, field, 'x', 'g' FROM gold UNION ALL SELECT 'value', *, 'p' FROM pred UNION ALL SELECT 'value', *, 'g' FROM gold UNION ALL SELECT 'ensemble', *, 'p' FROM en UNION ALL SELECT 'ensemble', *, 'g' FROM gold),
j AS (SELECT scoring, query, field, max(CASE WHEN side = 'p' THEN value END) AS p, max(CASE WHEN side = 'g' THEN value END) AS g FROM m GROUP BY 1, 2, 3),
c AS (SELECT scoring, count(CASE WHEN p = g THEN 1 END) AS tp, count(CASE WHEN p IS NOT NULL AND coalesce(p <> g, true) THEN 1 END) AS fp, count(CASE WHEN g IS NOT NULL AND coalesce(p <> g, true) THEN 1 END) AS fn FROM j GROUP BY 1)
SELECT scoring, tp, fp, fn, round(tp / (tp + (fp + fn) / 2), 6) AS f1 FROM c""")
def three_f1(spark, sf_dir):
    """Recognition, values, and values with a backup."""
    cat = catalogue(spark, sf_dir).withColumnRenamed("item", "query")
    f = lambda d, n, c: d.select("query", F.lit(n).alias("field"), c.alias("value"))
    gold = f(cat, "colour", _C("colour")).unionByName(f(cat.where("size > 10"), "garment", _C("garment")))
    pred = f(cat.where("query % 5 <> 0"), "colour", F.when(_C("query") % 7 == 0, "red").otherwise(_C("colour"))).unionByName(f(cat.where("size > 20 OR size < 5"), "garment", _C("garment")))
    backup = f(cat.where("query % 10 = 0"), "colour", _C("colour")).unionByName(f(cat.where("size BETWEEN 5 AND 20"), "garment", _C("garment")))
    return metrics.three_scores(pred, backup, gold).select("scoring", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query(f"""WITH {_TOP5}, sh AS (SELECT customer, field, value, share FROM r WHERE rank <= 5), pc2 AS (SELECT DISTINCT customer, item, colour, product_type FROM pur JOIN cat USING (item)), k AS (SELECT item, count(*) AS n FROM pur GROUP BY 1), pop AS (SELECT item, ln(1 + n) / ln(1 + max(n) OVER ()) AS pop FROM k)
SELECT p.customer, p.item, round((coalesce(a.share, 0) + coalesce(b.share, 0)) / 2, 6) AS preference, round(0.3 + 0.5 * (coalesce(a.share, 0) + coalesce(b.share, 0)) / 2 + 0.2 * pop, 6) AS blend FROM pc2 p JOIN pop USING (item)
LEFT JOIN sh a ON a.customer = p.customer AND a.field = 'colour' AND a.value = p.colour LEFT JOIN sh b ON b.customer = p.customer AND b.field = 'product_type' AND b.value = p.product_type""")
def blend_scores(spark, sf_dir):
    """How an item's values agree with a customer's profile, and the fixed blend with popularity."""
    pur = purchases(spark, sf_dir)
    rows = pur.select("customer", "item").join(catalogue(spark, sf_dir).select("item", "colour", "product_type"), "item")
    maps = profiles.share_maps(profiles.top_shares(rows, "customer", ["colour", "product_type"])).groupBy("customer").agg(*[F.max(F.when(_C("field") == f, F.to_json("shares"))).alias(f"j_{f}") for f in ("colour", "product_type")])
    x = rows.distinct().join(maps, "customer", "left").join(profiles.popularity(pur, "item").select("item", "score"), "item")
    shares = [(F.from_json(f"j_{f}", "map<string,double>"), _C(f)) for f in ("colour", "product_type")]
    x = x.withColumn("preference", profiles.category_preference(shares))
    return x.select("customer", "item", F.round("preference", 6).alias("preference"), F.round(profiles.fixed_blend(F.lit(0.5), _C("preference"), _C("score")), 6).alias("blend"))
