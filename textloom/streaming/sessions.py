"""Conversation state in Structured Streaming: the last messages and entities of a session, dropped when it is idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAST, IDLE = 5, 3600
OUT = "session string, n long, history array<string>, expired boolean"
STATE = "n long, history array<string>"


def _update(expire: bool):
    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, history = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "n": [n], "history": [list(history)], "expired": [True]})
            return
        n, history = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
        history = [*history, *rows["text"].tolist()][-LAST:]
        n += len(rows)
        state.update((n, history))
        if expire:
            state.setTimeoutDuration(IDLE * 1000)
        yield pd.DataFrame({"session": [key[0]], "n": [n], "history": [history], "expired": [False]})

    return update


def histories(messages: DataFrame, session: str, order: str, text: str, expire: bool = True) -> DataFrame:
    """Per batch and session the number of messages so far and the last ``LAST``; sessions idle for ``IDLE`` seconds are
    reported once more as expired and forgotten. Order holds within a batch. A stream that is to end by itself must not
    ``expire``: its sessions would keep it waiting."""
    rows = messages.select(F.col(session).cast("string").alias("session"), F.col(order).cast("long").alias("ord"), F.col(text).alias("text"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return rows.groupBy("session").applyInPandasWithState(_update(expire), OUT, STATE, "update", timeout)


def idle_windows(events: DataFrame, key: str, ts: str, seconds: int = IDLE, late: str = "10 minutes") -> DataFrame:
    """Sessions by gaps in event time, each given once no late event can change it."""
    out = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{seconds} seconds").alias("w"))
    return out.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
