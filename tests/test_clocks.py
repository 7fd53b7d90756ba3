"""Streams that act on time: expiry by timers, sliding passes, the tick loop."""

import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mobilis.operators import lifecycle
from mobilis.sources.folders import landed, new_folder
from mobilis.streaming import commands, expiry, jobs, lookback, worker

T0 = datetime(2024, 3, 1)
RECS = "incident_id long, evidence_hash string, decided boolean, at timestamp, place long"


def hours(h):
    return T0 + timedelta(hours=h)


def fed(spark, slices, schema, job):
    feed, folder = new_folder(spark, "landed"), new_folder(spark, "jobs")
    for rows in slices:
        part = spark.createDataFrame(rows, schema)
        landed(part, feed)
        out = job(jobs.files(spark, feed, part.schema), folder)
        yield out


def test_recommendations_expire_without_a_row_of_their_own(spark):
    slices = [
        [(1, "a", False, hours(0), 1), (2, "b", True, hours(0), 2), (3, "c", False, hours(1), 3), (3, "d", False, hours(2), 4), (3, "d", False, hours(3), 5)],
        [(9, "x", False, hours(7), 6)],  # time goes on by another incident's row
        [(1, "e", False, hours(9), 7), (2, "b", False, hours(9), 8), (3, "f", False, hours(9), 9), (9, None, True, hours(9), 10)],
        [(8, "y", True, hours(30), 11)],
    ]
    told = [sorted(map(tuple, out.drop("expires_at").collect()), key=repr) for out in fed(spark, slices, RECS, expiry.expiring)]
    one = [(1, 1, "a", "awaiting_approval", hours(0)), (2, 1, "b", "decided", hours(0)), (3, 1, "c", "awaiting_approval", hours(1)), (3, 1, "d", "awaiting_approval", hours(2))]
    assert told[0] == sorted(one, key=repr)
    # at hour 7 only the first is six hours old; the third was written again at hour 2
    two = [*one, (9, 1, "x", "awaiting_approval", hours(7)), (1, 1, "a", "expired", hours(6))]
    assert told[1] == sorted(two, key=repr)
    # an expired one is superseded, a decided one with the same hash stays, an unknown hash is one of its own
    three = [*two, (3, 1, "d", "expired", hours(8)), (1, 2, "e", "awaiting_approval", hours(9)), (3, 2, "f", "awaiting_approval", hours(9)), (9, 1, None, "decided", hours(9))]
    assert told[2] == sorted(three, key=repr)
    four = [*three, (8, 1, "y", "decided", hours(30)), (1, 2, "e", "expired", hours(15)), (3, 2, "f", "expired", hours(15))]
    assert told[3] == sorted(four, key=repr)


def test_passes_keep_state_for_their_hours_only(spark, monkeypatch):
    # one file an hour, a batch each: the state must not grow with the stream
    sizes, held = [], []
    plain = jobs.run_to_end

    def watched(writer, folder):
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))

    monkeypatch.setattr(lookback, "run_to_end", watched)
    schema = "key string, hit boolean, received_at timestamp, observed_at timestamp"
    slices = []
    for h in range(0, 48, 4):
        rows = [("k", True, hours(h + d) + timedelta(minutes=m), hours(h + d) + timedelta(minutes=m)) for d in range(4) for m in (10, 40)]
        rows += [("k", True, hours(h + 3), hours(h - 1)), ("k", True, hours(h + 3), hours(h - 5)), ("k", False, hours(h), hours(h))]
        held += rows
        slices.append(rows)
    for out in fed(spark, slices, schema, lambda stream, folder: lookback.look_back(stream, F.col("hit"), ["key"], folder)):
        got = {r.pass_at: (r.n, r.n_late) for r in out.collect()}
    assert plain is not watched and max(sizes[3:]) <= 8 and len(sizes) == 12
    for at, (n, n_late) in got.items():
        seen = [r for r in held if r[1] and at - timedelta(hours=6) < r[3] and r[2] <= at]
        late = [r for r in seen if any(r[3] <= p < r[2] for p in (at - timedelta(hours=k) for k in range(7)))]
        assert (n, n_late) == (len(seen), len(late))
    assert len(got) >= 40 and sum(x[1] for x in got.values()) > 0


def test_the_tick_loop_never_overlaps_and_outlives_failures(spark):
    heartbeat, folder = worker.Heartbeat(), new_folder(spark, "jobs")
    spark.streams.addListener(heartbeat)
    window, running, most, ticks = {"open": False}, [0], [0], []
    lock = threading.Lock()

    def slow():
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.8)
        with lock:
            running[0] -= 1

    take = worker.intake(lambda: window["open"], {"feed": slow}, lambda: None)

    def tick(n):
        ticks.append(n)
        if len(ticks) == 2:
            raise ValueError("no answer")
        window["open"] = len(ticks) > 2
        return take(n)

    query = worker.start(spark, "intake", folder, tick, 0.3, heartbeat)
    until = time.time() + 60
    while len(ticks) < 5 and time.time() < until:
        time.sleep(0.1)
    query.stop()
    time.sleep(1)
    spark.streams.removeListener(heartbeat)
    assert len(ticks) >= 5 and most[0] == 1
    heartbeat.flush(spark, f"{folder}/progress")
    progress = spark.read.schema(worker.PROGRESS).parquet(f"{folder}/progress")
    outcomes = [r.outcome for r in progress.where("outcome IS NOT NULL").orderBy("at").collect()]
    assert outcomes[:4] == ["paused", "failed", "ingested", "ingested"]
    assert progress.where("outcome = 'failed'").first().error == "no answer"
    assert progress.select("worker").distinct().count() == 1
    kinds = {r.kind for r in progress.collect()}
    assert {"started", "progress", "terminated"} <= kinds
    now = F.current_timestamp()
    assert worker.liveness(progress, now, 0.3).first().status == "stopped"
    assert worker.liveness(progress.where("kind <> 'terminated'"), now + F.expr("INTERVAL 1 HOUR"), 0.3).first().status == "silent"


@pytest.mark.parametrize("seconds, status", [(0, "live"), (99, "paused"), (100, "silent")])
def test_five_intervals_make_a_worker_silent(spark, seconds, status):
    signs = [("w", T0, "started", None, None, None)] + ([("w", T0, "progress", 1, "paused", None)] if seconds else [])
    progress = spark.createDataFrame(signs, worker.PROGRESS)
    got = worker.liveness(progress, F.lit(T0 + timedelta(seconds=seconds)), 20).first()
    assert (got.status, got.alive) == (status, status != "silent")


def test_sources_run_side_by_side():
    met = threading.Barrier(3, timeout=20)
    assert jobs.isolated({n: met.wait for n in "abc"}, lambda: None) == {}


def test_a_key_is_remembered_for_a_day_from_when_it_was_applied(spark):
    rows = [(1, "a", "x", hours(0)), (2, "a", "x", hours(20)), (3, "a", "y", hours(23)), (4, "a", "x", hours(25)), (5, "a", "x", hours(40)), (6, "b", None, hours(1)), (7, "b", None, hours(2)), (8, "b", "z", hours(25)), (9, "b", "z", hours(50))]
    want = {1: "applied", 2: "replayed", 3: "conflict", 4: "applied", 5: "replayed", 6: "applied", 7: "replayed", 8: "applied", 9: "applied"}
    schema = "command_id long, key string, body string, at timestamp"
    batch = lifecycle.once(spark.createDataFrame(rows, schema), ["key"], "at", body="body")
    assert {r.command_id: r.outcome for r in batch.collect()} == want
    slices = [[r for r in rows if a <= r[3] < b] for a, b in ((hours(0), hours(22)), (hours(22), hours(26)), (hours(26), hours(99)))]
    *_, out = fed(spark, slices, schema, lambda stream, folder: commands.answered(stream, ["key"], folder))
    assert {r.command_id: r.outcome for r in out.collect()} == want
