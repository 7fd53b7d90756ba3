"""The evidence table: identity, upsert, freshness and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import canonical_hash
from mobilis.functions.time import cadence_bucket

KEY = ["connector_code", "source_event_id"]


def hashed(observations: DataFrame, content: list[str]) -> DataFrame:
    """Add ``content_hash`` over the columns that make two observations differ."""
    return observations.withColumn("content_hash", canonical_hash(*[F.col(c) for c in content]))


def outcomes(observations: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Each observation of a log with what taking it in does: accepted or duplicate.

    An observation that brings the hash its key already has is a duplicate; it only
    confirms.  The comparison is with the row before, not with the newest content,
    so an older version that comes late overwrites a newer one.
    """
    w = Window.partitionBy(*key).orderBy(*(order or ["observed_at", "evidence_id"]))
    before = F.lag("content_hash").over(w)
    return observations.withColumn("outcome", F.when(before.eqNullSafe(F.col("content_hash")), "duplicate").otherwise("accepted"))


def current(observations: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """The state that a log of observations leaves: one row a key, with its version.

    ``version`` counts accepted contents, ``received_at`` is the last confirmation.
    One shuffle by key: the window and the grouping share it.
    """
    order = order or ["observed_at", "evidence_id"]
    ranked = outcomes(observations, key, order)
    last = F.struct(*order)
    return ranked.groupBy(*key).agg(
        F.max_by("evidence_id", last).alias("evidence_id"),
        F.max_by("content_hash", last).alias("content_hash"),
        F.max("observed_at").alias("received_at"),
        F.count_if(F.col("outcome") == "accepted").alias("version"),
    )


def upsert(state: DataFrame, batch: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``state`` after ``batch`` (one row a key): new, confirmed, overwritten or untouched.

    Both have content_hash and received_at, ``state`` also version.  ``change`` says
    what happened; the caller writes the result beside the old table and swaps.
    """
    old = state.select(*key, *[F.col(c).alias(f"old_{c}") for c in ("content_hash", "received_at", "version")])
    new = batch.select(*key, "content_hash", "received_at")
    met = old.join(new, key, "full")
    same = F.col("old_content_hash").eqNullSafe(F.col("content_hash"))
    change = F.when(F.col("content_hash").isNull(), "untouched").when(F.col("old_content_hash").isNull(), "inserted").when(same, "confirmed").otherwise("overwritten")
    return met.select(
        *key,
        F.coalesce("content_hash", "old_content_hash").alias("content_hash"),
        F.coalesce("received_at", "old_received_at").alias("received_at"),
        (F.coalesce("old_version", F.lit(0)) + change.isin("inserted", "overwritten").cast("long")).alias("version"),
        change.alias("change"),
    )


def claims(runs: DataFrame, source: str, at: str, seconds: int) -> DataFrame:
    """One run per source and cadence bucket: the earliest claims it, the others see it taken."""
    bucket = cadence_bucket(F.col(at), seconds)
    w = Window.partitionBy(source, "bucket").orderBy(at, "run_id")
    return runs.withColumn("bucket", bucket).withColumn("claimed", F.row_number().over(w) == 1)


def latest_per(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (a lateral top-1)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def window_top(evidence: DataFrame, connectors: list[str], as_of: Column, hours: int = 6, most: int = 800) -> DataFrame:
    """The newest evidence of a window over confirmations, capped over all connectors together.

    The cap comes before rules see anything, so a busy feed can crowd out a quiet
    one; ties are broken by evidence_id.
    """
    fresh = evidence.where(F.col("connector_code").isin(connectors) & (F.col("received_at") > as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("received_at") <= as_of))
    return fresh.orderBy(F.desc("observed_at"), "evidence_id").limit(most)


def source_health(evidence: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Each source with its last observation, lag and health; silent sources are unavailable."""
    from mobilis.functions.time import lag_seconds

    last = evidence.groupBy("connector_code").agg(F.max("observed_at").alias("last_observed_at"), F.count(F.lit(1)).alias("n_rows"))
    met = sources.join(last, "connector_code", "left").withColumn("lag_seconds", lag_seconds(F.col("last_observed_at"), as_of))
    health = F.when(F.col("last_observed_at").isNull(), "unavailable").when(F.col("lag_seconds") > F.col("stale_after_seconds"), "delayed").otherwise("healthy")
    return met.withColumn("lag_seconds", F.when(F.col("last_observed_at").isNotNull(), F.col("lag_seconds"))).withColumn("health", health)


def validated(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): ``rejected`` has the name of the first check that fails."""
    reason = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
