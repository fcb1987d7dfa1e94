"""The whole state of a conversation in one streaming operator: its last messages, what it is about, clearing and expiry.

Events of a session are messages, entities and clears. The state keeps the last messages by event time, the latest value of
each entity, how many messages there were, when the session was last active and when it was cleared. Rows may come late:
what is kept goes by event time and number, not by arrival. A session that nothing follows for the idle time is reported as
expired once the watermark has passed that, and forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.sessions import IDLE, LAST

EVENTS = ("session string", "at timestamp", "seq long", "kind string", "name string", "value string")
OUT = "session string, event string, version long, seq long, n long, history array<string>, entities map<string,string>, resolved string, last_active double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionProcessor(StatefulProcessor):
    """``sticky`` names the entity that a message without its own takes from the session."""

    def __init__(self, sticky: str, last: int = LAST, idle: int = IDLE) -> None:
        self.sticky, self.last, self.idle = sticky, last, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "at double, seq long, text string")
        self.entities = handle.getMapState("entities", "name string", "at double, seq long, value string")
        self.totals = handle.getValueState("totals", "n long, version long, active double, cleared double, cleared_seq long")

    def _row(self, key, event: str, seq, n: int, version: int, history, entities, resolved, active: float) -> dict:
        return {"session": key[0], "event": event, "version": version, "seq": seq, "n": n, "history": [h[2] for h in history], "entities": {k: v[2] for k, v in entities.items()}, "resolved": resolved, "last_active": active}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame["at"] = frame["at"].map(lambda t: t.timestamp())
        frame = frame.sort_values(["at", "seq"], kind="stable")
        n, version, active, cleared = 0, 0, 0.0, (0.0, -1)
        if self.totals.exists():
            n, version, active, at, seq = self.totals.get()
            cleared = (at, seq)
        history = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        entities = {k[0]: tuple(v) for k, v in self.entities.iterator()} if self.entities.exists() else {}
        before, out = set(entities), []
        for r in frame.itertuples():
            when = (r.at, int(r.seq))
            if active and r.at - active > self.idle:
                version += 1
                out.append(self._row(key, "expired", None, n, version, history, entities, None, active))
                n, history, entities = 0, [], {}
            active = max(active, r.at)
            if when <= cleared:
                continue  # late, from before the session was cleared
            if r.kind == "clear":
                cleared, n = when, n - sum(h[:2] <= when for h in history) if history and max(history)[:2] > when else 0
                history = [h for h in history if h[:2] > when]
                entities = {k: v for k, v in entities.items() if v[:2] > when}
            elif r.kind == "entity":
                if r.name_ and r.value is not None and when >= entities.get(r.name_, (0.0, -1))[:2]:
                    entities[r.name_] = (*when, r.value)
            else:
                n += 1
                history = sorted([*history, (*when, r.value)], key=lambda h: h[:2])[-self.last :]
                known = entities.get(self.sticky)
                version += 1
                out.append(self._row(key, "message", int(r.seq), n, version, history, entities, known[2] if known and known[:2] <= when else None, active))
        version += 1
        out.append(self._row(key, "state", None, n, version, history, entities, None, active))
        self.totals.update((n, version, active, *cleared))
        self.history.put(history) if history else self.history.clear()
        for k in before - set(entities):
            self.entities.removeKey((k,))
        for k, v in entities.items():
            self.entities.updateValue((k,), v)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((active + self.idle) * 1000) + 1)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, version, active, *_ = self.totals.get()
        history = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        entities = {k[0]: tuple(v) for k, v in self.entities.iterator()} if self.entities.exists() else {}
        for state in (self.history, self.entities, self.totals):
            state.clear()
        yield pd.DataFrame([self._row(key, "expired", None, n, version + 1, history, entities, None, active)])

    def close(self) -> None:
        pass


def session_states(events: DataFrame, sticky: str = "school", late: str = "10 minutes", last: int = LAST, idle: int = IDLE) -> DataFrame:
    """For each batch of ``events`` (see ``EVENTS``) a row ``message`` for each message, with what it is about (``resolved``:
    the sticky entity so far), a row ``state`` for each session, and a row ``expired`` for each that has ended. Entities and
    messages of one moment go by seq, entities first if theirs is lower. Needs the RocksDB state store (``STORE``)."""
    rows = events.select("session", "at", F.coalesce("seq", F.lit(0)).alias("seq"), "kind", F.col("name").alias("name_"), "value").where("session is not null and at is not null")
    processor = SessionProcessor(sticky, last, idle)
    return rows.withWatermark("at", late).groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def run_to_end(stream: DataFrame, at: str) -> DataFrame:
    """Runs a stream over what there is and reads its rows back. A batch that is run again after a failure replaces its rows;
    called again with the same folder it goes on where it stopped."""
    spark = stream.sparkSession
    keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).parquet(f"{at}/out")


def latest(rows: DataFrame) -> DataFrame:
    """The last row ``state`` of each session."""
    return rows.where("event = 'state'").groupBy("session").agg(F.max_by(F.struct("n", "history", "entities", "last_active"), "version").alias("s")).select("session", "s.*")
