"""Registered queries of the corpus operators: each reads its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, collocations, decontaminate, language_id, near_dedup, packing, quality, ranked_search, secret_scan, substring_dedup, token_output, topk_search, url_filter
from .shared import ASCII_LOWER, ASCII_UPPER

#: Sites that the URL filter blocks where no rule fits.
LISTED_SITES = (
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
)  # fmt: skip
URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED_SITES], "site string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, listed).drop("listed")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    n = {k: F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS}
    return found.select("doc_id", *n.values(), F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query, with its whole text, against all documents."""
    return topk_search.top_k(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


#: The folder of public vocabulary files.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PACK_CAPACITY = 2048


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=PACK_CAPACITY)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_tokens(_table(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", capacity=PACK_CAPACITY)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(_table(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_quality_classifier, op3_minhash_near_dedup, op4_best_fit_packing, op5_url_filter, op6_secret_scan, op7_decontaminate, op8_language_id, op9_token_output, op10_suffix_dedup, op11_bpe_codec, op12_ranked_search, op13_collocations)}

_UPPER, _LOWER = ASCII_UPPER, ASCII_LOWER
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN = ", ".join(f"'{x}'" for x in LISTED_SITES)
ORACLES = {
    "op5_url_filter": f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') IN ({_IN}) THEN 'block' ELSE 'allow' END AS verdict FROM d
""",
    "op12_ranked_search": rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, nn),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
parts AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l))) AS s
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus),
scores AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores
QUALIFY rank <= 50
""",
    "op13_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?
-]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 6) t(k))),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL),
cand AS (SELECT lang, k, p, f AS a FROM f WHERE k > 1 AND f >= 100),
inner_ AS (SELECT lang, list_slice(p, i, i + j - 1) AS p, max(a) AS g
  FROM (SELECT lang, p, a, j, unnest(range(1, k - j + 2)) AS i FROM cand, range(2, 5) t(j) WHERE j < k) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_ i USING (lang, p) WHERE g IS NULL OR 100 * g < 100 * a),
cuts AS (SELECT lang, p, a, c, list_slice(p, 1, c) AS left_, list_slice(p, c + 1, k) AS right_ FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (SELECT u.lang, u.p, u.a, u.c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * u.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.p = u.left_ JOIN f y ON y.lang = u.lang AND y.p = u.right_ JOIN totals t ON t.lang = u.lang),
best AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n, score FROM best
QUALIFY rank <= 2000
""",
}
