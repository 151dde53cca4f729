"""Checks of tables and of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_dump(rows: DataFrame, columns: Sequence[str], *, long_mean: int = 80, most: int = 400) -> DataFrame:
    """(column, n_distinct, mean_length, values): the first values of each column in order; none where they are long."""
    each = rows.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "value")).where("value IS NOT NULL").distinct()
    sizes = each.groupBy("column").agg(F.count("*").alias("n_distinct"), F.round(F.avg(F.length("value")), 6).alias("mean_length"))
    # each task cuts its values to the first ones before they meet
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("r") <= most)
    out = sizes.join(first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("v")), "column")
    return out.select("column", "n_distinct", "mean_length", F.when(F.col("mean_length") <= long_mean, F.array_join("v", "|")).otherwise("").alias("values"))


def value_counts(rows: DataFrame, column: str, missing: str = "(nan)") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def crosstab(rows: DataFrame, a: str, b: str, missing: str = "(nan)") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(a).cast("string"), F.lit(missing)).alias(a), F.coalesce(F.col(b).cast("string"), F.lit(missing)).alias(b)).agg(F.count("*").alias("n"))


def first_per_group(rows: DataFrame, by: str, order: Sequence[Column | str], n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def dedup_first(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; which one is first is stated, never left to chance."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run has not written yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def without_leaks(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Training rows whose text, whatever its case, is in no test row."""
    t = test.select(F.lower(text).alias("__k")).distinct()
    return train.withColumn("__k", F.lower(text)).join(t, "__k", "left_anti").drop("__k")


def all_missing(rows: DataFrame, columns: Sequence[str], missing: Sequence[str] = ("", "Unknown", "Unspecified")) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.coalesce(F.col(c).cast("string"), F.lit("")).isin(*missing)
    return rows.agg(F.count_if(cond).alias("n_missing"), F.count("*").alias("n"))


def pass_rates(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(ok).alias("kept"), F.count("*").alias("n")).withColumn("rate", F.round(F.col("kept") / F.col("n"), 6))


def call_plan(targets: DataFrame, per_call: int) -> DataFrame:
    """(label, bucket, rows, calls) of (label, bucket, rows): how many calls of per_call rows reach each target."""
    return targets.withColumn("calls", F.ceil(F.col("rows") / per_call).cast("long"))


def conversation_summary(turns: DataFrame, conversation: str, tier: str, ok: str) -> DataFrame:
    """(tier, turns, turns_ok, conversations, conversations_ok), with a line for all; a conversation passes with all its turns."""
    per = turns.groupBy(conversation, tier).agg(F.count("*").alias("t"), F.count_if(F.col(ok)).alias("p"), F.bool_and(ok).alias("whole"))
    each = per.withColumn("tier", F.explode(F.array(F.col(tier).cast("string"), F.lit("all"))))
    return each.groupBy("tier").agg(F.sum("t").alias("turns"), F.sum("p").alias("turns_ok"), F.count("*").alias("conversations"), F.count_if("whole").alias("conversations_ok"))


def model_against_rules(rows: DataFrame, gold: str, model: str, final: str, confidence: str | None = None) -> DataFrame:
    """One row: accuracy of the model and after the rules, how often the rules helped or hurt, and, with a confidence,
    its mean and least where the model is right, and its mean and greatest where it is wrong (0 if there are none)."""
    m, f = F.col(model) == F.col(gold), F.col(final) == F.col(gold)
    found = [F.count("*").alias("n"), F.count_if(m).alias("model_ok"), F.count_if(f).alias("final_ok"), F.count_if(f & ~m).alias("helped"), F.count_if(m & ~f).alias("hurt"), F.count_if(F.col(model) != F.col(final)).alias("disagree")]
    if confidence:
        right, wrong = F.when(m, F.col(confidence)), F.when(~m, F.col(confidence))
        parts = {"right_mean": F.avg(right), "right_least": F.min(right), "wrong_mean": F.avg(wrong), "wrong_most": F.max(wrong)}
        found += [F.coalesce(c, F.lit(0.0)).alias(name) for name, c in parts.items()]
    return rows.agg(*found)


def check_results(results: Column, kind: str, *, field: str = "", values: Sequence[str] = (), least: float = 0.0) -> Column:
    """A predicate over an array of result structs: min, all_in, none_in or frac_in."""
    n = F.size(results)
    inside = F.size(F.filter(results, lambda r: r.getField(field).isin(*values))) if field else F.lit(0)
    return {"min": n >= int(least), "all_in": (n > 0) & (inside == n), "none_in": inside == 0, "frac_in": (n > 0) & (inside >= least * n)}[kind]


def check_value(actual: Column, kind: str, expected: str = "") -> Column:
    a = F.coalesce(actual, F.lit(""))
    return {"equals": F.lower(a) == expected.lower(), "contains": F.lower(a).contains(expected.lower()), "present": a != "", "absent": a == ""}[kind]


def check_pairs(actual: Column, expected: Column) -> Column:
    """A predicate over maps: every expected key has its value."""
    return F.size(F.map_filter(expected, lambda k, v: ~F.coalesce(F.try_element_at(actual, k) == v, F.lit(False)))) == 0


def check_path(actual: Column, expected: Sequence[str]) -> Column:
    """A predicate over an array of steps: all expected ones were taken."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in expected]), actual)) == 0


def hash_sample(rows: DataFrame, key: Column, n: int, seed: str = "42") -> DataFrame:
    """The first n rows by a hash of the key and the seed; sampling is the feature."""
    return rows.withColumn("__h", F.md5(F.concat(key, F.lit(seed)))).orderBy("__h", key).limit(n).drop("__h")


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """(line) of a table in Markdown; write it as text. Its rows are a report's, in the order of the columns."""
    cells = lambda cols: F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    body = rows.select(F.lit(1).alias("k"), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, f"## {title}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}")], "k int, line string")
    return head.unionByName(body).orderBy("k", "line").select("line")
