"""Commands that run once: keyed state that forgets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from mobilis.streaming.expiry import timers
from mobilis.streaming.jobs import run_to_end

_TOLD = "command_id long, outcome string, at long"


class Requests(StatefulProcessor):
    """The request that a key stands for, for ``life`` microseconds from when it was applied."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "body string, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        now = tuple(self.known.get()) if self.known.exists() else None
        for row in sorted(rows, key=lambda r: (r.micros, r.command_id)):
            if now and row.micros < now[1] + self.life:
                outcome = "replayed" if now[0] == row.body else "conflict"
            else:
                outcome, now = "applied", (row.body, row.micros)
            yield Row(command_id=row.command_id, outcome=outcome, at=row.micros)
        self.known.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(now[1] + self.life) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def answered(commands: DataFrame, key: list[str], folder: str, hours: int = 24, lateness: str = "0 seconds") -> DataFrame:
    """command_id, outcome (applied, replayed, conflict) and at of each command, as in :func:`mobilis.operators.lifecycle.once`.

    Commands have command_id, the key, body and at (a TIMESTAMP).  A key is forgotten
    ``hours`` after its request was applied, so the state holds the keys of that time only.
    Commands that come more than ``lateness`` behind the newest of earlier batches are left out.
    """
    spark = commands.sparkSession
    rows = commands.select(*key, "command_id", "body", "at", F.unix_micros("at").alias("micros")).withWatermark("at", lateness)
    told = rows.groupBy(*key).transformWithState(Requests(hours * 3_600_000_000), StructType.fromDDL(_TOLD), "Append", "EventTime")
    told = told.withColumn("at", F.timestamp_micros("at"))
    with timers(spark):
        run_to_end(told.writeStream.format("parquet").option("path", f"{folder}/outcomes").outputMode("append"), folder)
    return spark.read.schema(told.schema).parquet(f"{folder}/outcomes")
