"""Continuous jobs: the batch operators inside Structured Streaming.

A job owns a folder that all executors share: its checkpoint, its tables and its state.
State that joins across keys lies in a store, in buckets of keys: a micro-batch reads and
rewrites the buckets that its keys touch, and its number is published with them, so a
batch that runs again changes nothing.  A job that is started again on its folder goes on
where it ended, whatever became of the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mobilis.operators import evidence as ev_ops
from mobilis.operators import lifecycle
from mobilis.sources.folders import stored
from mobilis.sources.store import State, Store


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the files of a folder: what is new there is a micro-batch of each run."""
    return spark.readStream.schema(schema).parquet(path)


def run_to_end(writer, folder: str) -> None:
    """Go on with a job until what is there now is taken in."""
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def folded(stream: DataFrame, store: Store, take: Callable[[Store, State, DataFrame, int], None], folder: str) -> None:
    """Fold micro-batches into a store by ``take(store, state, batch, number)``, which commits ``done(number)`` with what it changes."""

    def once(batch: DataFrame, n: int) -> None:
        state = store.state()
        if int(state.facts.get("batch", "-1")) < n:
            take(store, state, stored(batch), n)

    run_to_end(stream.writeStream.foreachBatch(once), folder)


def done(n: int) -> dict[str, str]:
    return {"batch": str(n)}


def _keyed(stream: DataFrame, folder: str, schema: StructType, key: list[str], step: Callable[[DataFrame, DataFrame, int], DataFrame], buckets: int) -> DataFrame:
    """Fold micro-batches into one table: ``step`` gives the touched buckets after a batch."""
    store = Store(stream.sparkSession, f"{folder}/state", {"state": (schema, key)}, buckets)

    def take(store: Store, state: State, batch: DataFrame, n: int) -> None:
        touched = store.touched("state", batch, state)
        new = step(store.read("state", state, touched), batch, n)
        store.commit(state, {"state": (new, touched)}, facts=done(n))

    folded(stream, store, take, folder)
    return store.read("state")


def _schema(rows: DataFrame, columns: list[str], more: str) -> StructType:
    return StructType([rows.schema[c] for c in columns] + StructType.fromDDL(more).fields)


def upsert_stream(observations: DataFrame, folder: str, buckets: int = 16) -> DataFrame:
    """Current evidence, one row a key: each batch's newest observation on the state before."""
    newest = [F.desc("observed_at"), F.desc("evidence_id")]
    schema = _schema(observations, [*ev_ops.KEY, "content_hash", "received_at"], "version long")

    def step(old: DataFrame, batch: DataFrame, n: int) -> DataFrame:
        return ev_ops.upsert(old, ev_ops.latest_per(batch, ev_ops.KEY, newest)).drop("change")

    return _keyed(observations, folder, schema, ev_ops.KEY, step, buckets)


def incident_stream(observations: DataFrame, matched: Column, folder: str, buckets: int = 16) -> DataFrame:
    """Incidents by (connector_code, external_key); rows where ``matched`` holds are a batch's matches.

    A pass looks at the open incidents, which it may resolve, and at the past ones that
    match again; past ones are in buckets of their own, of which it touches few.
    """
    key = ["connector_code", "external_key"]
    schema = _schema(observations, key, "status string, version long")
    store = Store(observations.sparkSession, f"{folder}/state", {"open": (schema, key), "past": (schema, key)}, buckets)
    every = list(range(buckets))

    def take(store: Store, state: State, batch: DataFrame, n: int) -> None:
        matches = batch.where(matched).select(*key).distinct()
        again = store.read("past", state, store.touched("past", matches, state)).join(matches, key, "left_semi")
        now = stored(lifecycle.incident_step(store.read("open", state).unionByName(again), matches, batch).drop("change"))
        is_open = F.col("status").isin(lifecycle.OPEN_INCIDENT)
        touched = store.touched("past", now.where(~is_open).select(*key).unionByName(again.select(*key)), state)
        kept = store.read("past", state, touched).join(now.select(*key), key, "left_anti")
        store.commit(state, {"open": (now.where(is_open), every), "past": (kept.unionByName(now.where(~is_open)), touched)}, facts=done(n))

    folded(observations, store, take, folder)
    state = store.state()
    return store.read("open", state).unionByName(store.read("past", state))


def recommendation_stream(projected: DataFrame, folder: str, hours: int = 6, buckets: int = 16) -> DataFrame:
    """The newest recommendation of each incident: its version, state and when it expires.

    Rows have incident_id, evidence_hash, decided and at; a batch brings one row an
    incident.  Another hash rewrites an open recommendation and supersedes a decided one
    by the next version; each write lives ``hours`` from its time.
    """
    written = StructType([projected.schema["incident_id"], projected.schema["evidence_hash"], projected.schema["decided"], StructField("expires_at", projected.schema["at"].dataType), StructField("version", LongType())])

    def step(old: DataFrame, batch: DataFrame, n: int) -> DataFrame:
        expires = F.col("at") + F.expr(f"INTERVAL {hours} HOURS")
        new = batch.select("incident_id", F.struct("evidence_hash", "decided", expires.alias("expires_at")).alias("new"))
        met = old.select("incident_id", F.struct("evidence_hash", "decided", "expires_at").alias("old"), "version").join(new, "incident_id", "full")
        same = F.col("new").isNull() | (F.col("version").isNotNull() & F.col("old.evidence_hash").eqNullSafe(F.col("new.evidence_hash")))
        supersede = ~same & F.coalesce(F.col("old.decided"), F.lit(False))
        row = F.when(same, F.col("old")).otherwise(F.col("new"))
        version = F.when(F.col("version").isNull(), F.lit(1).cast("long")).otherwise(F.col("version") + supersede.cast("long"))
        return met.select("incident_id", row.alias("row"), version.alias("version")).select("incident_id", "row.*", "version")

    return _keyed(projected, folder, written, ["incident_id"], step, buckets)


def outcome_stream(observations: DataFrame, folder: str, buckets: int = 16) -> DataFrame:
    """Each observation with what taking it in did (a duplicate only confirms), and its content's number.

    The state is the last content of each key.  A batch is compared in order with the
    row before it, across its own rows by a window and across batches by the state.
    """
    held_schema = _schema(observations, [*ev_ops.KEY, "content_hash"], "version long")
    told_schema = _schema(observations, ["evidence_id"], "outcome string, version long")
    store = Store(observations.sparkSession, f"{folder}/state", {"held": (held_schema, ev_ops.KEY), "outcomes": (told_schema, [])}, buckets)

    def take(store: Store, state: State, batch: DataFrame, n: int) -> None:
        rows = batch.select(*ev_ops.KEY, "evidence_id", "observed_at", "content_hash")
        touched = store.touched("held", rows, state)
        held = store.read("held", state, touched).select(*ev_ops.KEY, F.struct("content_hash", "version").alias("held"))
        w = Window.partitionBy(*ev_ops.KEY).orderBy("observed_at", "evidence_id")
        met = rows.join(held, ev_ops.KEY, "left").withColumn("place", F.row_number().over(w))
        before = F.when(F.col("place") == 1, F.col("held.content_hash")).otherwise(F.lag("content_hash").over(w))
        fresh = (~before.eqNullSafe(F.col("content_hash"))) | ((F.col("place") == 1) & F.col("held").isNull())
        told = met.withColumn("fresh", fresh).withColumn("version", F.coalesce("held.version", F.lit(0)) + F.sum(F.col("fresh").cast("long")).over(w))
        out = stored(told.select("evidence_id", F.when(F.col("fresh"), "accepted").otherwise("duplicate").alias("outcome"), "version", *ev_ops.KEY, "content_hash", "observed_at"))
        last = out.groupBy(*ev_ops.KEY).agg(F.max_by(F.struct("content_hash", "version"), F.struct("observed_at", "evidence_id")).alias("now"))
        both = held.join(last, ev_ops.KEY, "full").select(*ev_ops.KEY, F.coalesce("now", "held").alias("row")).select(*ev_ops.KEY, "row.*")
        store.commit(state, {"held": (both, touched)}, {"outcomes": out}, done(n))

    folded(observations, store, take, folder)
    return store.read("outcomes")


def change_feed(log: DataFrame, folder: str) -> DataFrame:
    """An append-only log as files that later readers follow: each row exactly once."""
    spark = log.sparkSession
    run_to_end(log.writeStream.format("parquet").option("path", f"{folder}/feed").outputMode("append"), folder)
    return spark.read.schema(log.schema).parquet(f"{folder}/feed")


def cadence_stream(observations: DataFrame, folder: str, width: str = "1 hour", buckets: int = 16) -> DataFrame:
    """Observations by connector and tumbling window; late ones count, whatever their age.

    Each batch is counted by itself and added to the windows that it touches, so what the
    stream keeps in memory does not grow with the windows there have been.
    """
    at = observations.schema["observed_at"].dataType
    schema = StructType([observations.schema["connector_code"], StructField("opens", at), StructField("n", LongType())])

    def step(old: DataFrame, batch: DataFrame, n: int) -> DataFrame:
        return old.unionByName(batch).groupBy("connector_code", "opens").agg(F.sum("n").alias("n"))

    counted = observations.select("connector_code", F.window("observed_at", width)["start"].alias("opens"), F.lit(1).cast("long").alias("n"))
    return _keyed(counted, folder, schema, ["connector_code", "opens"], step, buckets)


def commands_once(commands: DataFrame, key: list[str], at: str, hours: int = 24) -> DataFrame:
    """A stream of commands without those whose key came within ``hours`` before (``at`` is a TIMESTAMP)."""
    return commands.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark(key)


def isolated(sources: dict[str, Callable[[], None]], after: Callable[[], None], at_once: int = 16) -> dict[str, str]:
    """Run the intake of all sources side by side, then ``after`` (detection) whatever failed; the failures by source.

    One feed that fails or is slow does not hold up the others: its error is told, its
    checkpoint stays where it was, and its next run goes on from there.
    """
    failed: dict[str, str] = {}
    with ThreadPoolExecutor(max(1, min(at_once, len(sources)))) as pool:
        started = {name: pool.submit(take_in) for name, take_in in sources.items()}
        for name, run in started.items():
            if error := run.exception():
                failed[name] = str(error)
    after()
    return failed
