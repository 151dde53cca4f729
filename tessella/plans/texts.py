"""Identifiers, words and lines of the tables' own texts, leaks between text sets, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import audits, nlu
from ..sources import tables
from ..sources.stage import shared_dir
from ..sources.tables import read_table
from .base import PURCHASES, catalogue, purchases, query

_C = F.col
_STOP = ("the", "of", "and", "de", "la", "der", "die", "el")
_IN = ", ".join(f"'{w}'" for w in _STOP)


@query("SELECT o_orderkey, lpad(CAST(100000000 + o_orderkey AS VARCHAR), 10, '0') AS article_id, CAST(o_custkey AS BIGINT) AS customer, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders")
def ids_in_texts(spark, sf_dir):
    """Ids found in sentences, and numbers told from texts: whole ones and decimals."""
    o = read_table(spark, sf_dir, "orders")
    said = F.concat(F.lit("about order #"), (_C("o_orderkey") + 100_000_000).cast("string"), F.lit(" of "), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", TX.extract_article_id(said).alias("article_id"), TX.numeric_id(F.concat(F.lit(" "), _C("o_custkey").cast("string"))).alias("customer"), TX.numeric_id(F.format_string("%.2f", "o_totalprice")).alias("price"))


@query(f"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT (w[i] IN ({_IN}))) AS kept FROM w)
SELECT doc_id, CASE WHEN len(kept) = 0 OR kept IS NULL THEN 0 ELSE kept[len(kept)] - kept[1] + 1 END AS n, coalesce(w[kept[1]], '') AS first, coalesce(w[kept[len(kept)]], '') AS last FROM k""")
def trimmed_words(spark, sf_dir):
    """Every document's words without the stop words at either end: how many, and the first and last."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    x = read_table(spark, sf_dir, "documents").select("doc_id", TX.trim_edges(words, _STOP).alias("w"))
    return x.select("doc_id", F.size("w").cast("long").alias("n"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.try_element_at("w", F.lit(-1)), F.lit("")).alias("last"))


@query(f"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '{TX.DIACRITICS}') AS plain FROM documents")
def plain_letters(spark, sf_dir):
    """Documents without any of the folded accents."""
    return read_table(spark, sf_dir, "documents").select("doc_id", TX.english_only("text").alias("plain"))


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS with_price, CAST(sum(CASE WHEN value > 10 THEN event_id ELSE 0 END) AS BIGINT) AS ids FROM events GROUP BY 1")
def json_arrays(spark, sf_dir):
    """Each user's events as one fenced JSON array in a text, and the objects of it that have all they need."""
    e = read_table(spark, sf_dir, "events")
    one = F.to_json(F.struct("event_id", F.when(_C("value") > 10, F.round("value", 2)).alias("price")))
    said = e.groupBy("user_id").agg(F.count("*").alias("n"), F.concat(F.lit("Here it is:\n```json\n["), F.array_join(F.collect_list(one), ", "), F.lit("]\n```")).alias("t"))
    rows = TX.json_rows("t", "event_id bigint, price double", ["event_id", "price"])
    return said.select("user_id", "n", rows.alias("r")).select("user_id", "n", F.size("r").cast("long").alias("with_price"), F.aggregate("r", F.lit(0).cast("bigint"), lambda s, x: s + x["event_id"]).alias("ids"))


@query("SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND lower(text) NOT IN (SELECT lower(text) FROM benchmark WHERE text IS NOT NULL UNION SELECT lower(text) FROM documents WHERE text IS NOT NULL)")
def turns_without_leaks(spark, sf_dir):
    """Turns whose text, whatever its case, is neither an item of the benchmark nor a document."""
    held = read_table(spark, sf_dir, "benchmark").select("text").unionByName(read_table(spark, sf_dir, "documents").select("text"))
    return audits.without_leaks(read_table(spark, sf_dir, "conversations").where("text IS NOT NULL"), held.where("text IS NOT NULL"), "text").select("conv_id", "turn")


@query("SELECT p_partkey AS item, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS garment FROM part")
def bio_pairs(spark, sf_dir):
    """Two fields of every name tagged over its words, and both spans read back from the tags alone."""
    c = catalogue(spark, sf_dir)
    t = F.split("name", " ")
    a, b = nlu.bio_tags(t, F.array("colour"), "COLOUR"), nlu.bio_tags(t, F.array("garment"), "GARMENT")
    tags = F.zip_with(a, b, lambda x, y: F.when(x != "O", x).otherwise(y))
    rows = c.select("item", F.posexplode(F.arrays_zip(t.alias("token"), tags.alias("tag"))).alias("pos", "x")).select("item", "pos", "x.token", "x.tag")
    field = lambda name: F.max(F.when(_C("field") == name.upper(), _C("surface"))).alias(name)
    return nlu.bio_spans(rows, "item").groupBy("item").agg(field("colour"), field("garment"))


_FILES = f"""WITH {PURCHASES}, n AS (SELECT item, count(*) AS n, round(sum(price), 2) AS total FROM pur GROUP BY 1) SELECT kind, lpad(CAST(item AS VARCHAR), 10, '0') AS article_id, n, total FROM n, (VALUES ('csv'), ('json'), ('lines'), ('blocks')) k(kind)"""


@query(_FILES)
def written_files(spark, sf_dir):
    """A table as CSV, as JSON lines and as blocks of JSON, written and read again with ids as text."""
    rows = purchases(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")).select(_C("item").cast("string").alias("article_id"), "n", "total")
    top = f"{shared_dir(spark)}/tessella/files-{uuid.uuid4().hex}"
    schema = "article_id string, n long, total double"
    rows.write.option("header", True).csv(f"{top}/csv")
    tables.write_jsonl(rows, f"{top}/lines")
    # one object a file's line, with a blank line behind it
    rows.select(F.concat(F.to_json(F.struct("article_id", "n", "total"), {"pretty": "true"}), F.lit("\n")).alias("value")).write.text(f"{top}/blocks")
    rows.select(F.to_json(F.struct("article_id", "n", "total")).alias("value")).repartition(1 + spark.sparkContext.defaultParallelism).write.text(f"{top}/json")
    read = {
        "csv": tables.read_csv(spark, f"{top}/csv", ["article_id", "n", "total"], id_col="article_id"),
        "json": tables.read_jsonl(spark, f"{top}/json", schema),
        "lines": tables.read_jsonl(spark, f"{top}/lines", schema),
        "blocks": tables.read_blocks(spark, f"{top}/blocks", schema),
    }
    out = None
    for kind, found in read.items():
        part = found.select(F.lit(kind).alias("kind"), TX.normalize_article_id("article_id").alias("article_id"), _C("n").cast("long").alias("n"), _C("total").cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out
