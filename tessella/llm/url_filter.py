"""URL filtering by ordered host/path rules and an exact Bloom filter cascade.

The cascade stores a set R of listed keys against a universe U of all keys of the corpus. Level 0 is a Bloom filter of
R; the keys of U outside R that it accepts go into level 1, the listed keys that level 1 accepts go into level 2, and so
on until a level accepts none of the other side. Membership of any key of U is then exact: the first level that rejects
the key decides, by the parity of its depth. Every level is an array of 64-bit words that reaches the rows as a scalar
subquery, so no row is joined or shuffled to be judged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize

#: A cascade beyond this many bytes is refused: it reaches every executor.
MAX_CASCADE_BYTES = 64 << 20
MAX_LEVELS = 24


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL. Null, or no "://": both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def site_key(host: Column, labels: int) -> Column:
    """The last labels of the host: the key a list names, covering every host below it. Null for an empty host."""
    return F.when(host != "", F.substring_index(host, ".", -labels))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(64 * level + i)), F.lit(bits)).cast("long") for i in range(hashes)]


def _word(pos: Column) -> Column:
    return F.shiftright(pos, 6).cast("int")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: DataFrame  # one row, one array<bigint>


class BloomCascade:
    """Exact membership of a listed set among a known universe of keys.

    listed and universe are one-column frames of strings; nulls and repeats are ignored, and listed keys need not occur
    in the universe. An empty listed set accepts nothing. Keys outside listed and universe get the usual Bloom answer.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        spark = listed.sparkSession
        key = F.col("key")
        inside = materialize(listed.toDF("key").where(key.isNotNull()).distinct(), "cascade-listed")
        n = inside.count()
        self.levels: list[Level] = []
        if not n:
            return
        outside, size = None, n
        for depth in range(MAX_LEVELS):
            if depth == 0:
                other = max(universe.select(F.approx_count_distinct(universe.columns[0])).first()[0], 1)
                # the first level's rate balances the sizes of the first two levels
                rate = min(0.5, max(1e-6, 0.7 * n / other))
            else:
                rate = 0.5
            bits = 64 * ceil(max(1.0, 1.44 * size * log(1 / rate, 2) / 64))
            hashes = max(1, round(log(1 / rate, 2)))
            if sum(x.bits for x in self.levels) / 8 + bits / 8 > MAX_CASCADE_BYTES:
                raise ValueError(f"the cascade of {n} listed keys would take more than {MAX_CASCADE_BYTES} bytes")
            self.levels.append(self._build(spark, inside, depth, bits, hashes))
            if outside is None:
                candidates = universe.toDF("key").where(key.isNotNull() & self._accepts(key, depth)).distinct()
                outside = candidates.join(inside, "key", "left_anti")
            else:
                outside = outside.where(self._accepts(key, depth))
            outside = materialize(outside, "cascade-level")
            size = outside.count()
            if not size:
                return
            inside, outside = outside, inside
        raise ValueError("the cascade did not end; are the keys of one set also in the other?")

    def _build(self, spark, keys: DataFrame, level: int, bits: int, hashes: int) -> Level:
        pos = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        some = pos.select(_word(F.col("p")).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        none = spark.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
        words = some.unionByName(none).groupBy("w").agg(F.bit_or("b").alias("b"))
        one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        return Level(bits, hashes, materialize(one, "cascade-words"))

    def _accepts(self, key: Column, level: int) -> Column:
        x = self.levels[level]
        words = x.words.scalar()
        tests = [
            F.call_function("shiftright", F.get(words, _word(p)), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
            for p in _positions(key, level, x.bits, x.hashes)
        ]
        return reduce(lambda a, b: a & b, tests)

    def contains(self, key: Column) -> Column:
        """True where the first level that rejects the key has odd depth; the last level's acceptance stands."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            out = F.when(self._accepts(key, depth), out).otherwise(F.lit(depth % 2 == 1))
        return out


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, *, key_labels: int = 3, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed.

    The longest fitting rule gives the verdict. Without one, a page is blocked if the last key_labels labels of its host
    are a listed key, by the cascade over the site keys of all these pages. Null or malformed URLs have empty host and
    path, fit no rule and are allowed; repeated pages are judged alike; other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    key = site_key(F.col("host"), key_labels)
    cascade = BloomCascade(listed, parsed.select(key.alias("key")))
    hit = F.coalesce(cascade.contains(key), F.lit(False)) if cascade.levels else F.lit(False)
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(hit, "block").otherwise("allow"))
    return parsed.select(F.col(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), hit.alias("listed"))
