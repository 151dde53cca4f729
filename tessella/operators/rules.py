"""Pairing rules as column predicates over two sides of a pair, and their ablations in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import style_family

# The unordered pairs of outfit slots that may be worn together.
SLOT_PAIRS = (
    ("top", "bottom"), ("top", "outerwear"), ("top", "shoe"), ("top", "accessory"),
    ("bottom", "outerwear"), ("bottom", "shoe"), ("bottom", "accessory"),
    ("outerwear", "shoe"), ("outerwear", "accessory"),
    ("dress", "outerwear"), ("dress", "shoe"), ("dress", "accessory"),
    ("shoe", "accessory"), ("swim", "shoe"), ("swim", "accessory"), ("accessory", "accessory"),
)
NO_PAIRING_SLOTS = ("other", "nightwear", "inner")

# Words that tell a season.
WINTER = ("winter", "fall", "snow", "cold", "chill")
SUMMER = ("summer", "beach", "heat", "hot")
ALL_SEASONS = ("all-season", "all-year", "any season", "transition")
SEASON_CLASH = ("Spring/Summer", "Autumn/Winter")


@dataclass(frozen=True)
class Palette:
    """Colour families: neutrals and navies go with all, members of a family with each other, neighbours across two."""

    neutral: tuple[str, ...] = ()
    navy: tuple[str, ...] = ()
    families: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    neighbours: tuple[tuple[str, str], ...] = (("brown", "green"), ("brown", "yellow"), ("blue", "pink"))
    denim: tuple[str, ...] = ("Trousers Denim",)


# The colour names of the catalogue by family.
COLOURS = Palette(
    neutral=("Black", "White", "Off White", "Grey", "Light Grey", "Dark Grey", "Beige", "Light Beige", "Greyish Beige", "Silver", "Gold", "Transparent"),
    navy=("Dark Blue", "Navy"),
    families={
        "blue": ("Blue", "Light Blue", "Other Blue", "Turquoise", "Light Turquoise", "Dark Turquoise"),
        "green": ("Green", "Light Green", "Dark Green", "Greenish Khaki", "Other Green", "Olive"),
        "pink": ("Red", "Light Red", "Dark Red", "Pink", "Light Pink", "Dark Pink", "Other Red", "Other Pink", "Burgundy"),
        "yellow": ("Orange", "Light Orange", "Dark Orange", "Yellow", "Light Yellow", "Dark Yellow", "Other Yellow", "Other Orange", "Bronze/Copper"),
        "brown": ("Brown", "Dark Brown", "Yellowish Brown"),
    },
)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """A small table of constants as a map expression; null where the key is missing."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def slot_of(product_type: Column, group: Column, garment: Column, name: Column, *, by_type: Mapping[str, str], by_group: Mapping[str, str], by_garment: Mapping[str, str], mixed: Sequence[str] = (), name_words: Sequence[tuple[str, Sequence[str]]] = (), section: Column | None = None, section_words: Sequence[str] = ()) -> Column:
    """The outfit slot, from the first tier that knows: type, group, garment group; "other" if none does.

    Mixed garment groups are decided by words of the name, then of the section (which hint at underwear).
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    hint = F.lit(None).cast("string")
    for slot, words in reversed(list(name_words)):
        hint = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), slot).otherwise(hint)
    if section is not None and section_words:
        inner = reduce(lambda a, b: a | b, [F.lower(section).contains(w) for w in section_words])
        hint = F.coalesce(hint, F.when(inner, "inner"))
    third = F.when(garment.isin(*mixed), hint).otherwise(lookup(by_garment, garment)) if mixed else lookup(by_garment, garment)
    return F.coalesce(lookup(by_type, product_type), lookup(by_group, group), third, F.lit("other"))


def slot_from_table(items: DataFrame, table: DataFrame, tiers: Mapping[str, str], *, id_col: str, words: Column | None = None, default: str = "other") -> DataFrame:
    """items with slot and tier: the first tier whose table knows the item's key, one join for each; default if none does.

    table is (version, tier, key, rank, value), and its newest version counts. tiers names the column of each tier by
    key, in order. A last tier, word, looks up the words (an array) of what is left, and the least rank wins.
    """
    newest = table.agg(F.max("version").alias("version"))
    rows = table.join(F.broadcast(newest), "version").where(F.col("value").isNotNull())
    out = items.withColumn("slot", F.lit(None).cast("string")).withColumn("tier", F.lit(None).cast("string"))
    for name, column in tiers.items():
        known = rows.where(F.col("tier") == name).groupBy(F.col("key").alias(column)).agg(F.min(F.struct("rank", "value"))["value"].alias("__found"))
        hit = F.col("slot").isNull() & F.col("__found").isNotNull()
        out = out.join(known, column, "left").withColumn("tier", F.when(hit, name).otherwise(F.col("tier"))).withColumn("slot", F.coalesce("slot", "__found")).drop("__found")
    if words is not None:
        left = out.where("slot IS NULL").select(id_col, F.explode(F.array_distinct(words)).alias("key"))
        found = left.join(rows.where("tier = 'word'").select("key", "rank", "value"), "key").groupBy(id_col).agg(F.min(F.struct("rank", "value"))["value"].alias("__found"))
        out = out.join(found, id_col, "left")
        out = out.withColumn("tier", F.coalesce("tier", F.when(F.col("__found").isNotNull(), "word"))).withColumn("slot", F.coalesce("slot", "__found")).drop("__found")
    return out.select(*items.columns, F.coalesce("slot", F.lit(default)).alias("slot"), F.coalesce("tier", F.lit("default")).alias("tier"))


def expand_families(filters: DataFrame, families: DataFrame) -> DataFrame:
    """(query, field, value): a filter's generic value gives way to the members of its family; others stay.

    families is (field, generic, member).
    """
    f = families.select("field", F.col("generic").alias("value"), "member").distinct()
    return filters.join(f, ["field", "value"], "left").select("query", "field", F.coalesce("member", "value").alias("value"))


def slot_pair_allowed(a: Column, b: Column) -> Column:
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return key.isin(*["|".join(sorted(p)) for p in SLOT_PAIRS])


def same_family(a: Column, b: Column, families: Mapping[str, str]) -> Column:
    x, y = lookup(families, a), lookup(families, b)
    return F.coalesce(x.isNotNull() & (x == y), F.lit(False))


def same_index(a: Column, b: Column, *, strict: bool = False) -> Column:
    """Equal; blanks pass unless strict, where a blank equals only a blank."""
    return (a == b) if strict else ((a == "") | (b == "") | (a == b))


def different_type(type_a: Column, type_b: Column, group_a: Column, exempt: Sequence[str]) -> Column:
    return group_a.isin(*exempt) | (type_a == "") | (type_a != type_b)


def different_group(group_a: Column, group_b: Column, garment_a: Column, garment_b: Column, exempt: Sequence[str]) -> Column:
    return group_a.isin(*exempt) | (group_a != group_b) | (garment_a != garment_b)


def wanted_groups(a: Column, b: Column, unwanted: Sequence[str]) -> Column:
    """Neither side is of an unwanted garment group."""
    return ~(a.isin(*unwanted) | b.isin(*unwanted))


def different_style(a: Column, b: Column) -> Column:
    return style_family(a) != style_family(b)


def colours_compatible(a: Column, b: Column, garment_a: Column, garment_b: Column, palette: Palette = COLOURS, *, blank_passes: bool = True) -> Column:
    easy = (*palette.neutral, *palette.navy)
    tests = [a == b, garment_a.isin(*palette.denim) | garment_b.isin(*palette.denim)]
    if easy:
        tests.append(a.isin(*easy) | b.isin(*easy))
    if blank_passes:
        tests.append((a == "") | (b == ""))
    tests += [a.isin(*f) & b.isin(*f) for f in palette.families.values()]
    for x, y in palette.neighbours:
        if x in palette.families and y in palette.families:
            p, q = palette.families[x], palette.families[y]
            tests += [(a.isin(*p) & b.isin(*q)) | (b.isin(*p) & a.isin(*q))]
    return reduce(lambda s, t: s | t, tests)


def _has(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda s, t: s | t, [F.lower(c).contains(w) for w in words])


def seasons_compatible(a: Column, b: Column) -> Column:
    clash = (_has(a, WINTER) & _has(b, SUMMER)) | (_has(a, SUMMER) & _has(b, WINTER))
    return _has(a, ALL_SEASONS) | _has(b, ALL_SEASONS) | ~clash


def season_clash(a: Column, b: Column) -> Column:
    s, w = SEASON_CLASH
    return F.coalesce(((a == s) & (b == w)) | ((a == w) & (b == s)), F.lit(False))


def sections_conflict(a: Column, b: Column, sport: Sequence[str], formal: Sequence[str]) -> Column:
    return (a.isin(*sport) & b.isin(*formal)) | (a.isin(*formal) & b.isin(*sport))


#: The rules that each mode asks for, by the names of a rule table.
# The rules that each mode of the content filter asks for.
MODES: Mapping[str, tuple[str, ...]] = {
    "none": (),
    "minimal": ("wanted", "index"),
    "standard": ("wanted", "index", "type", "group", "style"),
    "legacy": ("wanted", "index", "type", "group", "style", "colour", "season", "section"),
    "redesigned": ("wanted", "index", "slot", "strict_type", "family", "style", "colour"),
}


def content_filter(rules: Mapping[str, Column], mode: str) -> Column:
    return reduce(lambda a, b: a & b, [rules[r] for r in MODES[mode]], F.lit(True))


def two_sided(pairs: DataFrame, meta: DataFrame, key: str, a: str = "item_a", b: str = "item_b") -> DataFrame:
    """Pairs with both sides' metadata as columns ending in _a and _b; missing values are empty."""
    out = pairs
    for side, end in ((a, "_a"), (b, "_b")):
        cols = meta.select(F.col(key).alias(side), *[F.col(c).cast("string").alias(c + end) for c in meta.columns if c != key])
        out = out.join(cols, side, "left")
    return out.fillna("", subset=[c + e for c in meta.columns if c != key for e in ("_a", "_b")])


def ablate(pairs: DataFrame, rules: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """(kind, rule, kept, total, and the mean of every measure over kept pairs) in one pass.

    individual: each rule alone; cumulative: the rules up to it; without: all but it; all: every rule.
    """
    names = list(rules)
    sets = [("individual", n, [n]) for n in names] + [("cumulative", n, names[: i + 1]) for i, n in enumerate(names)]
    sets += [("without", n, [m for m in names if m != n]) for n in names] + [("all", "all", names)]
    flagged = pairs.select(*[r.alias(f"__r{i}") for i, r in enumerate(rules.values())], *[m.cast("double").alias(n) for n, m in measures.items()])
    at = {n: F.col(f"__r{i}") for i, n in enumerate(names)}
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), reduce(lambda a, b: a & b, [at[m] for m in members], F.lit(True)).alias("ok")) for kind, rule, members in sets]
    each = flagged.select(*measures, F.explode(F.array(*rows)).alias("x"))
    ok = F.col("x.ok")
    return each.groupBy(F.col("x.kind").alias("kind"), F.col("x.rule").alias("rule")).agg(
        F.count_if(ok).alias("kept"), F.count("*").alias("total"), *[F.round(F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.0)), 6).alias(m) for m in measures]
    )
