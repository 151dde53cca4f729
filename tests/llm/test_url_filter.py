import random
import re

from tessella.llm import queries
from tessella.llm import url_filter as uf


def judge(url, rules, listed, labels=3):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    hit = bool(host) and ".".join(host.split(".")[-labels:]) in listed
    return host, path, rule.text if rule else None, rule.action if rule else "block" if hit else "allow"


def test_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://example.net", "x://example.net?q", "x://notexample.net/en/", "ftp://o.example.com/de/1://2", "h://w.bad.example.org/fr/", "h://w.bad.example.org/", "h://bad.example.org#f", "h://É.example.org/fr/é", "h://net/", "h://" + "a." * 3000 + "bad.example.org/" + "p" * 40000]
    urls += urls[4:6]
    listed = {"bad.example.org", "never.seen.org"}
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:5] for r in uf.filter_urls(pages, queries.URL_RULES, spark.createDataFrame([(x,) for x in listed], "s string")).collect()}
    assert got == {i: judge(u, queries.URL_RULES, listed) for i, u in enumerate(urls)}
    none = spark.createDataFrame([], "s string")
    assert uf.filter_urls(pages.limit(0), queries.URL_RULES, none).collect() == []
    assert all(r["verdict"] == "allow" for r in uf.filter_urls(pages, [], none).collect())


def test_cascade_is_exact(spark):
    rng = random.Random(1)
    keys = [f"k{rng.randrange(10**9)}" for _ in range(6000)]
    listed = set(keys[:2500]) | {"absent"}
    universe = spark.createDataFrame([(k,) for k in keys], "k string")
    cascade = uf.BloomCascade(spark.createDataFrame([(k,) for k in listed], "k string"), universe)
    from pyspark.sql import functions as F

    assert len(cascade.levels) > 1
    assert all(r["hit"] == (r["k"] in listed) for r in universe.select("k", cascade.contains(F.col("k")).alias("hit")).collect())
