"""Secret scanning with corpus-wide ownership frequency, in built-in functions only.

Every candidate value is hashed; a hash that many owners or repositories hold is an example that people copy, while a
value that stays with its owner looks live. Only hashes are shuffled, and they are pre-aggregated to distinct
(hash, owner, repository) rows before they are counted, so a value copied everywhere costs one row per pair and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

# Fixed patterns of the base scan, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ with 18 characters or more: a run's first AKIA is its longest match
HEX = r"[0-9a-f]{16,}"  # as [0-9a-f]+ with 16 characters or more: matches are whole runs
ASSIGN_VALUE_MIN = 12
#: Further candidates: long mixed tokens, kept only where the corpus shows them to be one owner's and no one else's.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def find_spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, kind, value) in code points, end exclusive.

    The parts between matches and the matches themselves alternate, so running sums of their lengths are positions.
    """
    all_ = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    value = (lambda m: m) if not value_group else (lambda m: F.regexp_extract(m, f"^(?:{pattern})", value_group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, pair):
        m, gap = pair["m"], pair["gap"]
        at = acc["at"] + F.length(gap)
        end = at + F.length(m)
        one = F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value(m).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).cast(SPAN).alias("out"))

    pairs = F.arrays_zip(all_.alias("m"), F.slice(gaps, 1, F.size(all_)).alias("gap"))
    # no match: nothing is split
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    assign = find_spans(text, "assign", ASSIGN, 2)
    return {
        "assign": F.filter(assign, lambda s: F.length(s["value"]) >= ASSIGN_VALUE_MIN),
        "access": find_spans(text, "access", ACCESS),
        "hex": find_spans(text, "hex", HEX),
    }


def _mixed(value: Column) -> Column:
    """Letters and digits both, and not one character over and over."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (chars >= 8)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rank(kind: Column) -> Column:
    return F.when(kind == "assign", 0).when(kind == "access", 1).when(kind == "hex", 2).otherwise(3)


def sort_spans(spans: Column) -> Column:
    """By start, then by kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def ownership(candidates: DataFrame, *, max_owners: int, max_repos: int) -> DataFrame:
    """(hash, owners, repos, live) of candidates (hash, owner, repo). Null owners or repositories count as one each."""
    pairs = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    found = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    return found.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str | None = "source",
    repo_col: str | None = "doc_id",
    max_owners: int = 1,
    max_repos: int = 3,
) -> DataFrame:
    """One row per input row: id, base (array of spans), spans (base and added ones), n_live, n_copied.

    Base spans always stay. Opaque tokens outside them are added where the whole corpus holds their hash with at most
    max_owners owners and max_repos repositories. n_live and n_copied count a row's spans by that verdict. Null text
    is empty and has no span; a null owner or repository is one like any other; repeated rows are rows of their own and
    count once as a repository; extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col(owner_col).cast("string") if owner_col else F.lit("")
    repo = F.col(repo_col).cast("string") if repo_col else F.lit("")
    found = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), text.alias("t"))
    found = found.select("id", "owner", "repo", *[c.alias(k) for k, c in base_spans(F.col("t")).items()], find_spans(F.col("t"), "opaque", OPAQUE).alias("opaque"))
    base = sort_spans(F.concat("assign", "access", "hex"))
    found = found.select("id", "owner", "repo", base.alias("base"), "opaque")
    free = F.filter("opaque", lambda s: _mixed(s["value"]) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    found = found.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", "base", free.alias("more"))
    found = materialize(found, "secret-spans")
    each = found.select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("s")).withColumn("hash", F.xxhash64(F.col("s.value")))
    owned = ownership(each, max_owners=max_owners, max_repos=max_repos)
    judged = each.select("row", "hash", "s").join(owned.select("hash", "live"), "hash")
    # a row's own spans meet again: as many as its text holds
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("s.kind") == "opaque") & F.col("live"), F.col("s"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    out = found.join(per_row, "row", "left")
    spans = sort_spans(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans become one mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
