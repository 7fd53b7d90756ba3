"""Writes as DataFrames: each takes what is stored and what comes, and gives what is stored then.

There is no row-wise UPDATE here; the caller writes the result beside the old table and
swaps.  Keys are not null, and a batch has one row a key unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.operators.numbering import numbered


def replaced(state: DataFrame, batch: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """``state`` with the rows of ``batch``; columns of ``keep`` stay as stored where the key is known."""
    columns = [c for c in state.columns if c not in key]
    old = state.select(*key, F.struct(*columns).alias("_old"))
    new = batch.select(*key, F.struct(*columns).alias("_new"))
    met = old.join(new, key, "full")

    def pick(c: str) -> Column:
        if c in (keep or []):
            return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))

    return met.select(*key, *[pick(c).alias(c) for c in columns]).select(*state.columns)


def added(state: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """``state`` and those rows of ``batch`` whose key it lacks, each key once."""
    return state.unionByName(batch.dropDuplicates(key).join(state.select(*key), key, "left_anti"))


def synced(state: DataFrame, wanted: DataFrame, scope: str, key: list[str]) -> DataFrame:
    """Links after a sync: a ``scope`` that ``wanted`` names has its rows and no other; others stay.

    Rows that were there keep what is stored.
    """
    scopes = wanted.select(scope).distinct()
    elsewhere = state.join(scopes, scope, "left_anti")
    stay = state.join(wanted.select(*key).distinct(), key, "left_semi")
    return elsewhere.unionByName(added(stay, wanted, key))


def without_orphans(rows: DataFrame, parents: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): rows whose key no parent has are deleted."""
    named = parents.select(*key).distinct()
    return rows.join(named, key, "left_semi"), rows.join(named, key, "left_anti")


def links_of_event(batch: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links (event_id, subject_id, evidence_id) to evidence of the same event; others drop out."""
    return batch.join(evidence.select("event_id", "evidence_id").distinct(), ["event_id", "evidence_id"], "left_semi")


def run_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources after their runs (several a source, in the order of completed_at, run_id).

    A run that succeeded or partly did sets last_success_at and clears the failures; a
    failed one adds one.  last_observed_at moves only where a run observed something.
    """
    order = F.struct("completed_at", "run_id")
    ok = F.col("status").isin("succeeded", "partial")
    by = runs.groupBy("source_code").agg(
        F.max(F.when(ok, order)).alias("ok"), F.max(order).alias("last"), F.max_by("status", order).alias("last_status"), F.max_by("observed_at", F.when(F.col("observed_at").isNotNull(), order)).alias("seen")
    )
    # failures count from the last success on: one value a source goes back to the runs
    failed = runs.where(~ok).join(by.select("source_code", "ok"), "source_code").where(F.col("ok").isNull() | (order > F.col("ok")))
    since = failed.groupBy("source_code").agg(F.count(F.lit(1)).alias("since"))
    met = sources.join(by, "source_code", "left").join(since, "source_code", "left")
    n = F.coalesce("since", F.lit(0).cast("long"))
    failures = F.when(F.col("last").isNull(), F.col("failures")).when(F.col("ok").isNull(), F.col("failures") + n).otherwise(n)
    return met.select(
        "source_code",
        F.coalesce("ok.completed_at", "last_success_at").alias("last_success_at"),
        F.coalesce("seen", "last_observed_at").alias("last_observed_at"),
        failures.alias("failures"),
        F.coalesce("last_status", "status").alias("status"),
    )


def recorded(commands: DataFrame, last_sequence: int = 0) -> tuple[DataFrame, DataFrame]:
    """(audit, outbox) rows of applied commands; outbox rows are numbered on, event by event.

    Numbers are gapless within an event, in the order of at, command_id.
    """
    done = commands.where("applied")
    audit = done.select("command_id", "event_id", "actor", "action", "subject_id", "at")
    topic = F.concat_ws(".", "subject_type", "action")
    placed = numbered(done, ["event_id"], ["at", "command_id"], "_number")
    outbox = placed.select("event_id", (F.col("_number") + 1 + last_sequence).alias("sequence"), topic.alias("topic"), "subject_id", "at")
    return audit, outbox


def polled(outbox: DataFrame, cursors: DataFrame, most: int = 200) -> DataFrame:
    """What each follower (event_id, after) reads next: at most ``most`` rows behind its cursor, in order."""
    w = Window.partitionBy("follower").orderBy("sequence")
    met = outbox.join(cursors, "event_id").where(F.col("sequence") > F.col("after"))
    return met.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def transitioned(commitments: DataFrame, moves: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commitments, log) after one move each (commitment_id, to_state, at); a move that is not allowed changes nothing."""
    target = moves.select("commitment_id", F.col("to_state").alias("target"), F.col("at").alias("moved_at"))
    ok = allowed.select(F.col("from_state").alias("state"), F.col("to_state").alias("target"), F.lit(True).alias("_ok"))
    met = commitments.join(target, "commitment_id", "left").join(ok, ["state", "target"], "left")
    moved = F.col("_ok").isNotNull()
    after = met.select("commitment_id", F.when(moved, F.col("target")).otherwise(F.col("state")).alias("state"), (F.col("version") + moved.cast("long")).alias("version"))
    log = met.where(moved).select("commitment_id", F.col("state").alias("from_state"), F.col("target").alias("to_state"), "moved_at")
    return after, log


def decided_log(requirements: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requirements (recommendation_id, agency_code) with ``satisfied_by``: the first approval of that agency."""
    approvals = decisions.where("action = 'approve'").groupBy("recommendation_id", "agency_code").agg(F.min_by("decision_id", F.struct("decided_at", "decision_id")).alias("satisfied_by"))
    return requirements.join(approvals, ["recommendation_id", "agency_code"], "left").withColumn("status", F.when(F.col("satisfied_by").isNull(), "pending").otherwise("satisfied"))


def windows_opened(windows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (mode, request_id, requested_at) with their outcome: a mode has one active window.

    Of a batch's requests for a mode without an active window the first is opened.
    """
    active = windows.where("active").select("mode", F.lit(True).alias("busy")).distinct()
    w = Window.partitionBy("mode").orderBy("requested_at", "request_id")
    met = requests.withColumn("rn", F.row_number().over(w)).join(active, "mode", "left")
    return met.withColumn("outcome", F.when(F.col("busy").isNull() & (F.col("rn") == 1), "opened").otherwise("conflict")).drop("rn", "busy")


def faults_of_batch(batch: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Batches (batch_id, kind) over the cap of a kind, with the number of their items."""
    cap = F.lit(None).cast("long")
    for kind, most in caps.items():
        cap = F.when(F.col("kind") == kind, F.lit(most)).otherwise(cap)
    return batch.groupBy("batch_id", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("accepted", F.col("n") <= cap)
