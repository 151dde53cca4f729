"""Column functions over text and identifiers. All stay inside the JVM but last_json_object()."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accented letters that are folded, and what they become. Others (ç, ö, ü, ñ) stay.
ACCENTED = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
FOLDED = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"

# What counts as no value.
NO_VALUE = ("", "unknown", "nan", "none", "null", "unspecified", "unspecified/other", "other")
DIACRITICS = "[" + ACCENTED + ACCENTED.upper() + "]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c: Column | str) -> Column:
    """Without white space at either end; null is empty."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"^\s+|\s+$", "")


def normalize_text(c: Column | str) -> Column:
    """Stripped, lower case, with the folded accents."""
    return F.translate(F.lower(strip(c)), ACCENTED, FOLDED)


def normalize_article_id(c: Column | str, width: int = 10) -> Column:
    """Digits padded with zeros on the left to the width; longer ids and others stay."""
    s = strip(_c(c).cast("string"))
    return F.when(s.rlike(r"^\d+$") & (F.length(s) < width), F.lpad(s, width, "0")).otherwise(s)


def extract_article_id(c: Column | str) -> Column:
    """The first id of 9 or 10 digits at a word's end, normalised; empty without one."""
    return normalize_article_id(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"#?([0-9]{9,10})\b", 1))


def numeric_id(c: Column | str) -> Column:
    """The id as a long; decimals lose their fraction, anything else is null."""
    s = strip(_c(c).cast("string"))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def clean_value(c: Column | str) -> Column:
    s = strip(_c(c).cast("string"))
    return F.when(F.lower(s).isin(*NO_VALUE), "").otherwise(s)


def words_by_space(c: Column | str) -> Column:
    """Normalised text cut at white space."""
    return F.filter(F.split(normalize_text(c), r"\s+"), lambda w: w != "")


def words_alnum(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the normalised text."""
    return F.regexp_extract_all(normalize_text(c), F.lit("([a-z0-9]+)"), F.lit(1))


def join_present(columns: Iterable[Column | str], separator: str, most: int | None = None) -> Column:
    """The non-empty values, joined; at most the first few."""
    found = F.filter(F.array(*[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]), lambda v: v != "")
    return F.array_join(F.slice(found, 1, most) if most else found, separator)


def dense_text(name: Column | str, description: Column | str, detail: Column | str, fields: Sequence[Column | str], most: int = 6) -> Column:
    """Name, description (or the detail where it is empty) and the first few present fields."""
    text = F.coalesce(F.nullif(_c(description), F.lit("")), _c(detail))
    return join_present([name, text, join_present(fields, ". ", most)], ". ")


def sparse_text(name: Column | str, kind: Column | str, description: Column | str, fields: Sequence[Column | str]) -> Column:
    """Name and type count twice, then the description and every present field."""
    return join_present([name, name, kind, kind, description, *fields], " ")


def rerank_text(fields: Sequence[Column | str], description: Column | str) -> Column:
    return strip(F.concat(join_present(fields, " "), F.lit(". "), F.coalesce(_c(description), F.lit(""))))


def shorten(c: Column | str, limit: int = 160) -> Column:
    """Longer texts end after the last whole word within the limit, with dots."""
    cut = F.substring(_c(c), 1, limit)
    return F.when(F.length(_c(c)) > limit, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("..."))).otherwise(_c(c))


def self_query(colour: Column | str, kind: Column | str, description: Column | str, most: int = 12) -> Column:
    """A query that the item itself should answer: colour, type, and the description's first words."""
    words = F.regexp_extract_all(F.coalesce(_c(description), F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    return join_present([colour, kind, F.array_join(F.slice(words, 1, most), " ")], " ")


def seeded_fraction(id_: Column | str, seed: str) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat(_c(id_).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def attribute_query(id_: Column | str, colour: Column | str, pattern: Column | str, fit: Column | str, kind: Column | str, occasion: Column | str, season: Column | str, seed: str = "42") -> Column:
    """A short request from attributes; three in ten name the occasion, two in ten start with the season."""
    r = seeded_fraction(id_, seed)
    base = join_present([colour, pattern, fit, kind], " ")
    return F.when((r < 0.3) & (_c(occasion) != ""), F.concat_ws(" ", base, F.lit("for"), _c(occasion))).when((r >= 0.3) & (r < 0.5) & (_c(season) != ""), F.concat_ws(" ", _c(season), base)).otherwise(base)


@F.pandas_udf(T.StringType())
def last_json_object(text: pd.Series) -> pd.Series:
    """The last balanced {...} of a text that parses as an object, as JSON; null without one."""

    def find(s: str | None) -> str | None:
        found, depth, begin = None, 0, 0
        for i, c in enumerate(s or ""):
            if c == "{":
                begin = i if depth == 0 else begin
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    try:
                        found = json.dumps(json.loads(s[begin : i + 1]), sort_keys=True)
                    except ValueError:
                        continue
        return found

    return text.map(find)


def json_rows(c: Column | str, schema: str, required: Sequence[str]) -> Column:
    """Objects of the JSON array in a text (code fences allowed) that have all the required keys."""
    body = F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, f"array<struct<{schema}>>")
    found = F.coalesce(rows, F.array().cast(f"array<struct<{schema}>>"))
    for k in required:
        found = _having(found, k)
    return found


def _having(rows: Column, key: str) -> Column:
    return F.filter(rows, lambda r: r.getField(key).isNotNull())


def english_only(c: Column | str) -> Column:
    return ~F.coalesce(_c(c), F.lit("")).rlike(DIACRITICS)


def length_bucket(c: Column | str) -> Column:
    """short up to 4 words, medium up to 12, long up to 100."""
    n = F.size(F.filter(F.split(strip(c), r"\s+"), lambda w: w != ""))
    return F.when(n <= 0, None).when(n <= 4, "short").when(n <= 12, "medium").when(n <= 100, "long")


def trim_edges(words: Column, stop: Sequence[str]) -> Column:
    """Words without the stop words at either end."""
    keep = F.transform(words, lambda w, i: F.when(~w.isin(*stop), i))
    first, last = F.array_min(keep), F.array_max(keep)
    return F.when(first.isNull(), F.slice(words, 1, 0)).otherwise(F.slice(words, first + 1, last - first + 1))


def style_family(id_: Column | str) -> Column:
    return F.substring(normalize_article_id(id_), 1, 6)


def image_path(id_: Column | str) -> Column:
    a = normalize_article_id(id_)
    return F.when(a == "", "").otherwise(F.concat(F.lit("/images/"), F.substring(a, 1, 3), F.lit("/"), a, F.lit(".jpg")))


def history_lines(turns: Column) -> Column:
    """An array of structs (role, text) as lines."""
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n")


def gender_of(index: Column | str, section: Column | str) -> Column:
    """Men, Women or empty, from the names of index and section."""
    i, s = normalize_text(index), normalize_text(section)
    first = F.coalesce(F.get(F.split(s, r"\s+"), F.lit(0)), F.lit(""))
    women = i.contains("ladies") | first.isin("womens", "ladies", "mama") | s.contains("women")
    return F.when((i == "menswear") | (first == "men"), "Men").when(women, "Women").otherwise("")


def without_words(text: Column | str, words: Column) -> Column:
    """The text without the words of an array, in lower case and cut at spaces; the whole text if nothing is left."""
    kept = F.filter(F.split(_c(text), " "), lambda w: ~F.array_contains(words, F.lower(F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", ""))))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_c(text))
