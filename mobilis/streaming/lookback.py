"""A sliding look-back over a stream: what each pass of detection sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.streaming.jobs import run_to_end

_HOUR = 3_600_000_000


def _passes(at: Column, slide: int) -> Column:
    """The first pass at ``at`` or after, in steps of ``slide`` microseconds."""
    return F.ceil(F.unix_micros(at).cast("decimal(20,0)") / slide).cast("long")


def seen_by_passes(evidence: DataFrame, matched: Column, hours: int = 6, slide_minutes: int = 60) -> DataFrame:
    """A row for each pass that sees a matching row: its ``pass_at``, and whether it was ``late``.

    A pass runs every ``slide_minutes`` and sees what was received by then and observed
    within ``hours`` before.  A row that came too late for a pass that it belongs to is
    flagged as late in the passes that are left to it; it is not dropped.
    """
    slide = slide_minutes * 60_000_000
    could, can = _passes(F.col("observed_at"), slide), _passes(F.greatest("observed_at", "received_at"), slide)
    last = _passes(F.col("observed_at") + F.make_dt_interval(hours=F.lit(hours)), slide) - 1
    rows = evidence.where(matched).withColumns({"_could": could, "_can": can, "_last": last}).where("_can <= _last")
    each = rows.withColumn("_pass", F.explode(F.sequence("_can", "_last")))
    return each.withColumns({"pass_at": F.timestamp_micros(F.col("_pass") * slide), "late": F.col("_could") < F.col("_can")}).drop("_could", "_can", "_last", "_pass")


def look_back(evidence: DataFrame, matched: Column, keys: list[str], folder: str, hours: int = 6, slide_minutes: int = 60) -> DataFrame:
    """Matches by pass and ``keys``: n, n_late and the newest observation; a pass is told once, when it is over.

    ``evidence`` has observed_at and received_at as TIMESTAMP.  A pass is over when event
    time, which is ``hours`` behind the newest pass that a row reaches, has come to it; its
    state goes then, so there is state for the passes of ``hours`` only, however long the
    stream runs.
    """
    spark = evidence.sparkSession
    seen = seen_by_passes(evidence, matched, hours, slide_minutes).withWatermark("pass_at", f"{hours} hours")
    passes = seen.groupBy("pass_at", *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.max("observed_at").alias("newest_at"))
    run_to_end(passes.writeStream.format("parquet").option("path", f"{folder}/passes").outputMode("append"), folder)
    return spark.read.schema(passes.schema).parquet(f"{folder}/passes")
