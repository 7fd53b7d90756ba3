"""The tick loop of intake, and whether it lives."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from mobilis.streaming.jobs import isolated

#: Intervals without a sign after which a worker is not merely slow.
SILENT_AFTER = 5
PROGRESS = "worker string, at timestamp, kind string, tick long, outcome string, error string"


def _now() -> datetime:
    return datetime.now(timezone.utc).astimezone().replace(tzinfo=None)


class Heartbeat(StreamingQueryListener):
    """Signs of life of named queries, kept until ``flush`` appends them to a table.

    Signs are started, progress (with the outcome of the tick that it ends), idle and
    terminated.  Only a query that has a name is a worker.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._rows: list[tuple] = []
        self._names: dict[str, str] = {}
        self.outcomes: dict[tuple[str, int], tuple[str, str | None]] = {}

    def _sign(self, worker: str | None, kind: str, tick: int | None = None, outcome: str | None = None, error: str | None = None) -> None:
        if worker:
            with self._lock:
                self._rows.append((worker, _now(), kind, tick, outcome, error))

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        if event.name:
            self._names[str(event.id)] = event.name
        self._sign(event.name, "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        outcome, error = self.outcomes.pop((p.name, p.batchId), (None, None))
        self._sign(p.name, "progress" if outcome else "idle", p.batchId, outcome, error)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._sign(self._names.get(str(event.id)), "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._sign(self._names.get(str(event.id)), "terminated", error=event.exception)

    def flush(self, spark: SparkSession, path: str) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)


def start(spark: SparkSession, name: str, folder: str, tick: Callable[[int], str], seconds: float, heartbeat: Heartbeat) -> StreamingQuery:
    """Call ``tick(number)`` every ``seconds``, never two at once; its outcome is a sign of life.

    A tick that takes longer delays the next.  One that fails is told as ``failed`` with
    its error and does not end the loop.  The loop ends by ``stop`` on what is returned.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 10).load()

    def once(_: DataFrame, n: int) -> None:
        try:
            outcome, error = tick(n), None
        except Exception as problem:  # noqa: BLE001 - the loop outlives whatever a tick throws
            outcome, error = "failed", str(problem)
        heartbeat.outcomes[name, n] = (outcome, error)

    writer = clock.writeStream.queryName(name).foreachBatch(once).option("checkpointLocation", f"{folder}/clock")
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def intake(active: Callable[[], bool], sources: dict[str, Callable[[], None]], after: Callable[[], None]) -> Callable[[int], str]:
    """A tick that takes in all sources while an operating window is active, and pauses otherwise."""

    def tick(_: int) -> str:
        if not active():
            return "paused"
        failed = isolated(sources, after)
        return "partial" if failed else "ingested"

    return tick


def liveness(progress: DataFrame, now: Column, seconds: float) -> DataFrame:
    """worker, ticks, last_at, last_outcome, last_error, alive and status, from signs of life up to ``now``.

    A worker lives if its last sign is less than ``SILENT_AFTER`` intervals old and does not
    say that it ended.  ``status`` is stopped, silent, paused, failing or live; a worker
    that has not finished a tick is live, as it has only started.
    """
    signs = progress.where(F.col("at") <= now)
    done = F.col("outcome").isNotNull()
    order = F.struct("at", F.coalesce("tick", F.lit(-1)))
    last = signs.groupBy("worker").agg(
        F.count_if(done).alias("ticks"),
        F.max("at").alias("last_at"),
        F.max_by("kind", order).alias("last_kind"),
        F.max_by(F.struct("outcome", "error"), F.when(done, order)).alias("last"),
    )
    silent = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp")) >= seconds * SILENT_AFTER * 1_000_000
    outcome = F.col("last.outcome")
    status = (
        F.when(F.col("last_kind") == "terminated", "stopped").when(silent, "silent").when(outcome == "paused", "paused").when(outcome == "failed", "failing").otherwise("live")
    )
    alive = (F.col("last_kind") != "terminated") & ~silent
    return last.select("worker", "ticks", "last_at", outcome.alias("last_outcome"), F.col("last.error").alias("last_error"), alive.alias("alive"), status.alias("status"))
