"""Streams end where the batch operators end, go on after a restart, and fail feed by feed."""

from datetime import datetime

from pyspark.sql import functions as F

from mobilis.operators import lifecycle
from mobilis.plans import stream_queries
from mobilis.plans.common import evidence
from mobilis.sources.folders import landed, new_folder
from mobilis.sources.store import Store
from mobilis.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_incident_stream_is_the_batch_step_repeated(spark):
    ev = evidence(spark, SF).withColumnRenamed("source_event_id", "external_key").cache()
    state = ev.select("connector_code", "external_key", F.lit("new").alias("status"), F.lit(0).cast("long").alias("version")).limit(0)
    edges = ["2000-01-01", "2024-01-11", "2024-01-21", "2100-01-01"]
    for a, b in zip(edges, edges[1:]):
        part = ev.where(f"observed_at >= timestamp_ntz'{a}' AND observed_at < timestamp_ntz'{b}'")
        state = lifecycle.incident_step(state, part.where("cents > 8000"), part).drop("change")
    want = sorted(map(tuple, state.collect()))
    got = sorted(map(tuple, stream_queries.stream_incident_state(spark, SF).collect()))
    assert want and got == want
    assert {r[2] for r in got} == {"active", "resolved"}


def test_a_job_goes_on_where_it_ended(spark):
    feed, folder = new_folder(spark, "landed"), new_folder(spark, "jobs")
    ev = evidence(spark, SF)
    for n in range(4):
        landed(ev.where(F.col("evidence_id") % 4 == n), feed)
        # a new start each time: what was taken in before is not read again
        got = jobs.outcome_stream(jobs.files(spark, feed, ev.schema), folder)
        assert got.count() == ev.where(F.col("evidence_id") % 4 <= n).count()
    store = Store(spark, f"{folder}/state", {})
    assert store.state().facts == {"batch": "3"} and sorted(map(int, store._names("pointers"))) == [3, 4]  # older states are gone
    assert jobs.outcome_stream(jobs.files(spark, feed, ev.schema), folder).count() == ev.count()


def test_commands_run_once_a_day(spark):
    feed, folder = new_folder(spark, "landed"), new_folder(spark, "jobs")
    schema = "command_id long, key string, at timestamp"
    rows = []
    for made in ([(1, "a", datetime(2024, 1, 1, 8)), (2, "b", datetime(2024, 1, 1, 9))], [(3, "a", datetime(2024, 1, 1, 20)), (4, "c", datetime(2024, 1, 1, 21))]):
        landed(spark.createDataFrame(made, schema), feed)
        once = jobs.commands_once(jobs.files(spark, feed, spark.createDataFrame([], schema).schema), ["key"], "at")
        jobs.run_to_end(once.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder)
        rows = sorted(r.command_id for r in spark.read.parquet(f"{folder}/out").collect())
    assert rows == [1, 2, 4]


def test_a_feed_that_fails_does_not_stop_the_others():
    done = []

    def broken():
        raise ValueError("no answer")

    failed = jobs.isolated({"a": lambda: done.append("a"), "b": broken, "c": lambda: done.append("c")}, lambda: done.append("detection"))
    assert done == ["a", "c", "detection"] and failed == {"b": "no answer"}


def test_a_batch_touches_the_buckets_of_its_keys_only(spark):
    feed, folder = new_folder(spark, "landed"), new_folder(spark, "jobs")
    ev = evidence(spark, SF)
    landed(ev, feed)
    jobs.upsert_stream(jobs.files(spark, feed, ev.schema), folder)
    store = Store(spark, f"{folder}/state", {})
    before = store.state()
    landed(ev.limit(1).withColumn("content_hash", F.lit("new")).withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 90 DAYS")), feed)
    out = jobs.upsert_stream(jobs.files(spark, feed, ev.schema), folder)
    after = store.state()
    assert len(before.keyed["state"]) == 16
    assert sum(before.keyed["state"][b] != c for b, c in after.keyed["state"].items()) == 1
    assert out.where("content_hash = 'new'").count() == 1 and out.count() == ev.select("connector_code", "source_event_id").distinct().count()
