"""Recommendations that expire by themselves: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from mobilis.streaming.jobs import run_to_end

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Instants are microseconds inside the state, so that no time zone is taken from a worker.
_TOLD = "incident_id long, version long, evidence_hash string, state string, at long, expires_at long"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """While a query with timers starts, state is kept where timers can be."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Recommendations(StatefulProcessor):
    """The newest recommendation of one incident; tells each write and each expiry.

    A write with another evidence hash rewrites a recommendation that awaits approval and
    supersedes a decided or expired one by the next version; each lives ``life``
    microseconds from its write.  A write with the same hash changes nothing.
    """

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "evidence_hash string, version long, state string, written long")

    def _told(self, incident: int, version: int, evidence: str, state: str, at: int, written: int) -> Row:
        return Row(incident_id=incident, version=version, evidence_hash=evidence, state=state, at=at, expires_at=written + self.life)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        # a micro-batch holds one row of an incident for each detection pass in it
        held = self.newest.get() if self.newest.exists() else None
        now = tuple(held) if held else None
        for row in sorted(rows, key=lambda r: (r.micros, r.place)):
            at = row.micros
            if now and now[2] == "awaiting_approval" and at >= now[3] + self.life:
                now = (now[0], now[1], "expired", now[3])
                yield self._told(key[0], now[1], now[0], "expired", now[3] + self.life, now[3])
            if now and now[0] == row.evidence_hash:
                continue
            version = now[1] + (now[2] != "awaiting_approval") if now else 1
            now = (row.evidence_hash, version, "decided" if row.decided else "awaiting_approval", at)
            yield self._told(key[0], version, row.evidence_hash, now[2], at, at)
        self.newest.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[2] == "awaiting_approval":
            self.handle.registerTimer(-(-(now[3] + self.life) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        evidence, version, state, written = self.newest.get()
        if state == "awaiting_approval":
            self.newest.update((evidence, version, "expired", written))
            yield self._told(key[0], version, evidence, "expired", written + self.life, written)

    def close(self) -> None:
        pass


def expiring(projected: DataFrame, folder: str, hours: int = 6, lateness: str = "0 seconds") -> DataFrame:
    """The log of recommendations: each write, and ``expired`` once ``hours`` have gone by since the last.

    Rows have incident_id, evidence_hash, decided, at (a TIMESTAMP) and place, which orders
    rows of one instant.  No row of an incident is needed for it to expire: a timer does it
    when rows of others have moved event time on.  State is one row an incident; it and the
    timers are in the checkpoint, so a job that starts again goes on with both.  Rows that
    come more than ``lateness`` behind the newest of earlier batches are left out.
    """
    spark = projected.sparkSession
    rows = projected.select("incident_id", "evidence_hash", "decided", "at", "place", F.unix_micros("at").alias("micros")).withWatermark("at", lateness)
    told = rows.groupBy("incident_id").transformWithState(Recommendations(hours * 3_600_000_000), StructType.fromDDL(_TOLD), "Append", "EventTime")
    told = told.withColumns({c: F.timestamp_micros(c) for c in ("at", "expires_at")})
    with timers(spark):
        run_to_end(told.writeStream.format("parquet").option("path", f"{folder}/log").outputMode("append"), folder)
    return spark.read.schema(told.schema).parquet(f"{folder}/log")
