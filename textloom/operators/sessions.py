"""Conversations in batch: the last messages, running history, idle sessions, what sticks to a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST, IDLE = 5, 3600


def last_messages(messages: DataFrame, session: str, order: str, n: int = LAST) -> DataFrame:
    """The last ``n`` messages of each session. With one row for each turn, ranks are pruned before the shuffle."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def running_history(messages: DataFrame, session: str, order: str, text: str, n: int = LAST) -> DataFrame:
    """Each message with those up to it, the last ``n`` at most."""
    seen = Window.partitionBy(session).orderBy(order).rowsBetween(1 - n, 0)
    return messages.withColumn("history", F.collect_list(text).over(seen))


def read_history(history: Column | str, n: int) -> Column:
    h = F.col(history) if isinstance(history, str) else history
    return F.slice(h, F.greatest(F.size(h) - n + 1, F.lit(1)), n)


def idle_sessions(events: DataFrame, key: str, ts: str, seconds: int = IDLE) -> DataFrame:
    """key, session_start, session_end, n: a session ends when nothing follows for ``seconds``."""
    out = events.groupBy(key, F.session_window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("session_end"))
    return out.select(key, F.col("w.start").alias("session_start"), "session_end", "n")


def expired(last_active: DataFrame, now: float, seconds: int = IDLE) -> DataFrame:
    return last_active.where(F.lit(now) - F.col("last_active") > seconds)


def merged_entities(updates: DataFrame, session: str, name: str, value: str, order: str) -> DataFrame:
    """The last value of each entity of a session."""
    return updates.groupBy(session, name).agg(F.max_by(value, order).alias(value))


def sticky(messages: DataFrame, session: str, order: str, found: str) -> DataFrame:
    """What a message names, else what the session named last."""
    past = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("sticky", F.last(found, ignorenulls=True).over(past))


def cleared(messages: DataFrame, session: str, name) -> DataFrame:
    """The messages without those of one session."""
    return messages.where(~F.col(session).eqNullSafe(name))


def summary(messages: DataFrame, session: str) -> DataFrame:
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("role").alias("roles"))
