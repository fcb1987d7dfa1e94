import random
from datetime import datetime, timedelta, timezone

import pytest

from textloom.streaming import state

SCHEMA = ", ".join(state.EVENTS)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def moment(seconds):
    return START + timedelta(seconds=seconds)


def plain(events, last=5):
    """The state that all events in their order leave, and what each message resolves to."""
    out, resolved = {}, {}
    for session, at, seq, kind, name, value in sorted(events, key=lambda e: (e[1], e[2])):
        n, history, entities, active = out.get(session, (0, [], {}, None))
        if kind == "clear":
            n, history, entities = 0, [], {}
        elif kind == "entity":
            entities = entities | {name: value}
        else:
            n, history = n + 1, [*history, value][-last:]
            resolved[session, seq] = entities.get("school")
        out[session] = (n, history, entities, at.timestamp())
    return out, resolved


def made(seed, n=160, clears=True):
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.choice(["message"] * 5 + ["entity"] * 2 + ["clear"] * (clears and r.random() < 0.2))
        out.append((f"s{r.randrange(6)}", moment(i * 20), i, kind, r.choice(["school", "program"]) if kind == "entity" else None, f"v{i}"))
    return out


def write(spark, events, path):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, at, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return state.run_to_end(state.session_states(stream, **kw), at)


def states(rows):
    return {r.session: (r.n, r.history, r.entities, r.last_active) for r in state.latest(rows).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_events_in_order_after_a_restart(spark, tmp_path, seed):
    events, at = made(seed), f"file://{tmp_path}/run"
    for part in (events[:50], events[50:90]):
        write(spark, part, f"{tmp_path}/in")
    run(spark, f"{tmp_path}/in", at)
    write(spark, events[90:], f"{tmp_path}/in")
    rows = run(spark, f"{tmp_path}/in", at)
    want, resolved = plain(events)
    assert states(rows) == want
    assert {(r.session, r.seq): r.resolved for r in rows.where("event = 'message'").collect()} == resolved


def test_late_rows_take_their_places(spark, tmp_path):
    events = made(3, clears=False)
    shuffled = events[:]
    random.Random(4).shuffle(shuffled)
    for k in range(0, len(shuffled), 60):
        write(spark, shuffled[k : k + 60], f"{tmp_path}/in")
    assert states(run(spark, f"{tmp_path}/in", f"file://{tmp_path}/run", late="2 hours")) == plain(events)[0]


def test_idle_sessions_expire_once_and_start_anew(spark, tmp_path):
    first = [("a", moment(0), 0, "message", None, "x"), ("a", moment(1), 1, "entity", "school", "q"), ("b", moment(3000), 2, "message", None, "y")]
    for part in (first, [("b", moment(5000), 3, "message", None, "z")], [("a", moment(9000), 4, "message", None, "w")]):
        write(spark, part, f"{tmp_path}/in")
    rows = run(spark, f"{tmp_path}/in", f"file://{tmp_path}/run", late="0 seconds").collect()
    gone = [(r.session, r.n, r.history, r.entities) for r in rows if r.event == "expired"]
    assert ("a", 1, ["x"], {"school": "q"}) in gone and len({g[0] for g in gone}) == len(gone)
    assert [(r.n, r.resolved) for r in rows if r.event == "message" and r.seq == 4] == [(1, None)]
