"""Conversation state as window folds over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS

TTL, CAPACITY, HISTORY = f"{SETTINGS.session_ttl_hours} hours", SETTINGS.session_capacity, SETTINGS.history_turns


def last_known(value: Column, by: str, order: str) -> Column:
    """The latest non-null value up to and with this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def session_id(c: Column, row_key: Column) -> Column:
    """Blank sessions are private: each row one of its own."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("anon-"), row_key.cast("string"))).otherwise(c)


def bounded_history(turns: DataFrame, by: str, order: str, text: str, *, most: int = HISTORY) -> DataFrame:
    """The last non-blank turns of each conversation."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    kept = turns.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return kept.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)


def sessionize(events: DataFrame, by: str, ts: str, gap: str = TTL) -> DataFrame:
    """With session: numbered from 1 for each user; a gap longer than the limit starts a new one."""
    w = Window.partitionBy(by).orderBy(ts, *[c for c in ("event_id",) if c in events.columns])
    new = (F.lag(ts).over(w).isNull() | (F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}"))).cast("int")
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def evict(sessions: DataFrame, updated: str, key: str, *, now: Column, ttl: str = TTL, capacity: int = CAPACITY) -> DataFrame:
    """Sessions within their time to live, the newest capacity of them. The order is global, over capacity rows at most."""
    alive = sessions.where(F.col(updated) >= now - F.expr(f"INTERVAL {ttl}"))
    return alive.orderBy(F.desc(updated), key).limit(capacity)


def fold_turns(turns: DataFrame, by: str, order: str) -> DataFrame:
    """The state after each turn of (by, order, anchor, clear, intent, type).

    An anchor set explicitly stays until another is set or it is cleared; intent and type are inherited by turns
    without. A clear counts before an anchor of its own turn.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.sum(F.coalesce(F.col("clear"), F.lit(False)).cast("int")).over(w)
    out = turns.withColumn("epoch", epoch)
    in_epoch = Window.partitionBy(by, "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        *[c for c in turns.columns if c not in ("anchor", "clear", "intent", "type")],
        F.last(F.nullif(F.col("anchor"), F.lit("")), ignorenulls=True).over(in_epoch).alias("anchor"),
        F.last(F.nullif(F.col("intent"), F.lit("")), ignorenulls=True).over(w).alias("last_intent"),
        F.last(F.nullif(F.col("type"), F.lit("")), ignorenulls=True).over(w).alias("last_type"),
    )
