"""Incidents, recommendations, decisions and commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moves each machine allows.
RECOMMENDATION_MOVES = {
    "acknowledge": (["awaiting_acknowledgement"], "awaiting_approval"),
    "approve": (["awaiting_approval", "delegated"], "approved"),
    "reject": (["awaiting_acknowledgement", "awaiting_approval", "delegated", "escalated"], "rejected"),
    "request_revision": (["awaiting_acknowledgement", "awaiting_approval", "delegated", "escalated"], "revision_requested"),
    "delegate": (["awaiting_approval"], "delegated"),
    "escalate": (["awaiting_acknowledgement", "awaiting_approval", "delegated"], "escalated"),
    "withdraw": (["approved"], "superseded"),
}
COMMITMENT_MOVES = {
    "requested": ["acknowledged", "cancelled", "expired"],
    "acknowledged": ["approved", "blocked", "cancelled", "expired"],
    "approved": ["executing", "blocked", "cancelled", "expired"],
    "executing": ["verified", "blocked", "failed"],
    "blocked": ["acknowledged", "approved", "executing", "failed", "cancelled"],
}
TERMINAL = ["verified", "failed", "expired", "cancelled"]
OPEN_INCIDENT = ["new", "triaged", "active", "monitoring"]


def commitment_moves(spark: SparkSession) -> DataFrame:
    pairs = [(a, b) for a, ends in COMMITMENT_MOVES.items() for b in ends]
    return spark.createDataFrame(pairs, "from_state string, to_state string")


def recommendation_moves(spark: SparkSession) -> DataFrame:
    rows = [(action, state, to) for action, (states, to) in RECOMMENDATION_MOVES.items() for state in states]
    return spark.createDataFrame(rows, "action string, from_state string, to_state string")


def checked_moves(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves with ``allowed``: whether the machine has them."""
    marked = allowed.withColumn("allowed", F.lit(True))
    return moves.join(F.broadcast(marked), ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def decided(recommendations: DataFrame, actions: DataFrame, moves: DataFrame) -> DataFrame:
    """State after each action; approval waits while any requirement is pending."""
    met = actions.join(recommendations, "recommendation_id").join(F.broadcast(moves.withColumnRenamed("from_state", "state")), ["action", "state"], "left")
    waits = F.col("to_state").isin("approved", "awaiting_approval") & (F.col("n_pending") > 0)
    return met.withColumn("next_state", F.when(F.col("to_state").isNull(), F.col("state")).when(waits, "awaiting_approval").otherwise(F.col("to_state"))).withColumn("valid", F.col("to_state").isNotNull())


def incident_step(incidents: DataFrame, matches: DataFrame, observed: DataFrame) -> DataFrame:
    """Incidents after one detection pass, by (connector_code, external_key).

    absent and matched: active; resolved and matched: active again; open and matched:
    as it is, with a new version; open, not matched and its connector seen: resolved;
    closed is never touched.  An update counts a version even if nothing changed.
    """
    key = ["connector_code", "external_key"]
    met = incidents.select(*key, "status", "version").join(matches.select(*key).distinct().withColumn("matched", F.lit(True)), key, "full")
    met = met.join(observed.select("connector_code").distinct().withColumn("seen", F.lit(True)), "connector_code", "left")
    matched, seen, open_ = F.coalesce("matched", F.lit(False)), F.coalesce("seen", F.lit(False)), F.col("status").isin(OPEN_INCIDENT)
    change = (
        F.when(F.col("status").isNull(), "opened")
        .when(F.col("status") == "closed", "untouched")
        .when(matched & (F.col("status") == "resolved"), "reopened")
        .when(matched, "confirmed")
        .when(open_ & seen, "resolved")
        .otherwise("untouched")
    )
    status = F.when(change.isin("opened", "reopened"), "active").when(change == "resolved", "resolved").otherwise(F.col("status"))
    version = F.coalesce("version", F.lit(0)) + (change != "untouched").cast("long")
    return met.select(*key, status.alias("status"), version.alias("version"), change.alias("change"))


def cleared(incidents: DataFrame, matches: DataFrame, observed: DataFrame) -> DataFrame:
    """Open incidents whose connector was seen and whose key did not match."""
    open_ = incidents.where(F.col("status").isin(OPEN_INCIDENT))
    return open_.join(observed.select("connector_code").distinct(), "connector_code", "left_semi").join(matches.select("connector_code", "external_key").distinct(), ["connector_code", "external_key"], "left_anti")


def supersede(recommendations: DataFrame, order: list[str]) -> DataFrame:
    """Versions of the recommendations of each incident, in the order they were projected.

    A new evidence hash rewrites an open recommendation in place and supersedes a
    decided one by the next version; the old one keeps its state.  Rows have
    incident_id, evidence_hash and decided.
    """
    w = Window.partitionBy("incident_id").orderBy(*order)
    changed = ~F.lag("evidence_hash").over(w).eqNullSafe(F.col("evidence_hash"))
    steps = recommendations.withColumn("first", F.row_number().over(w) == 1).withColumn("was_decided", F.coalesce(F.lag("decided").over(w), F.lit(False)))
    steps = steps.withColumn("plan", F.when(F.col("first"), "insert").when(~changed, "keep").when(F.col("was_decided"), "supersede").otherwise("rewrite"))
    return steps.withColumn("version", F.sum(F.col("plan").isin("insert", "supersede").cast("long")).over(w)).drop("first", "was_decided")


def latest_flagged(decisions: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Every decision with ``historical``: whether a later one of its key replaced it."""
    return decisions.withColumn("historical", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def planned_commitments(playbooks: DataFrame, agencies: DataFrame, now: Column) -> DataFrame:
    """The commitments of playbooks (array ``commitments`` of agency_code and due_minutes); unknown agencies drop out."""
    each = playbooks.select("rule_code", F.posexplode("commitments").alias("position", "c")).select("rule_code", "position", F.col("c.agency_code"), F.col("c.due_minutes"))
    return each.join(agencies, "agency_code").withColumn("due_at", now + F.make_dt_interval(mins=F.col("due_minutes")))


def required(recommendations: DataFrame, approvals: DataFrame, agencies: DataFrame, existing: DataFrame) -> DataFrame:
    """Approval requirements after recommendations are written: each (recommendation, agency, role) once.

    recommendations(recommendation_id, rule_code); approvals(rule_code, ``approvals``: array
    of agency_code and role_code, in their sequence); unknown agencies are skipped, and what
    ``existing`` has stays as it is.
    """
    each = approvals.select("rule_code", F.posexplode("approvals").alias("at", "a")).select("rule_code", (F.col("at") + 1).cast("long").alias("sequence"), F.col("a.agency_code"), F.col("a.role_code"))
    known = each.join(agencies.select("agency_code").distinct(), "agency_code", "left_semi")
    key = ["recommendation_id", "agency_code", "role_code"]
    asked = recommendations.select("recommendation_id", "rule_code").join(known, "rule_code").groupBy(*key).agg(F.min("sequence").alias("sequence"))
    new = asked.join(existing.select(*key), key, "left_anti")
    return existing.select(*key, "sequence", "status").unionByName(new.select(*key, "sequence", F.lit("pending").alias("status")))


def after_approval(recommendations: DataFrame, requirements: DataFrame, decisions: DataFrame) -> DataFrame:
    """recommendation_id, n_pending and state after approvals (recommendation_id, agency_code): while any requirement is pending it waits."""
    signed = decisions.select("recommendation_id", "agency_code").distinct().withColumn("signed", F.lit(True))
    met = requirements.join(signed, ["recommendation_id", "agency_code"], "left")
    pending = met.groupBy("recommendation_id").agg(F.count_if((F.col("status") == "pending") & F.col("signed").isNull()).alias("n_pending"))
    asked = decisions.select("recommendation_id").distinct().withColumn("asked", F.lit(True))
    out = recommendations.join(pending, "recommendation_id", "left").join(asked, "recommendation_id", "left")
    n = F.coalesce("n_pending", F.lit(0).cast("long"))
    return out.select("recommendation_id", n.alias("n_pending"), F.when(F.col("asked").isNull(), F.col("state")).when(n > 0, "awaiting_approval").otherwise("approved").alias("state"))


def unresolved(commitments: DataFrame) -> DataFrame:
    """Commitments whose state is not one of the terminal ones."""
    return commitments.where(~F.col("state").isin(TERMINAL))


def queue(recommendations: DataFrame, incidents: DataFrame, requirements: DataFrame, agency: str | None) -> DataFrame:
    """Recommendations awaiting a decision: only those with a requirement, each once.

    With an agency only those that require it; ``None`` is the lead, who sees all.
    """
    wanted = requirements if agency is None else requirements.where(F.col("agency_code") == agency)
    open_ = recommendations.where(F.col("state") != "draft")
    return open_.join(incidents, "incident_id").join(wanted.select("recommendation_id").distinct(), "recommendation_id", "left_semi")


def close_window(incidents: DataFrame, recommendations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closing an operating window closes its incidents and expires their open recommendations."""
    closed = incidents.withColumn("status", F.when(F.col("status").isin([*OPEN_INCIDENT, "resolved"]), "closed").otherwise(F.col("status")))
    decided_ = ["approved", "rejected", "superseded", "expired"]
    touched = recommendations.join(incidents.select("incident_id").distinct().withColumn("hit", F.lit(True)), "incident_id", "left")
    return closed, touched.withColumn("state", F.when(F.col("hit") & ~F.col("state").isin(decided_), "expired").otherwise(F.col("state"))).drop("hit")


def once(commands: DataFrame, key: list[str], at: str, hours: int = 24, body: str | None = None) -> DataFrame:
    """Commands with ``outcome``: applied, replayed, or conflict where the body is another, and ``replayed``.

    The first command of a key is applied and remembered for ``hours``; what comes in that
    time is answered from memory, and the first after it is applied anew.  Time runs from the
    command that was applied, not from its replays.  commands(command_id, ...); a key names
    one request of one client, so its commands are few and are folded in one row;
    :func:`mobilis.streaming.commands.answered` holds for keys of any size.
    """
    said = F.col(body) if body else F.lit(None).cast("string")
    row = F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col("command_id"), said.cast("string").alias("body"))
    listed = commands.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = listed.schema["rows"].dataType.elementType["command_id"].dataType.simpleString()
    live = hours * 3_600_000_000
    none = F.struct(F.lit(None).cast("long").alias("since"), F.lit(None).cast("string").alias("body"), F.array().cast(f"array<struct<command_id:{kind},outcome:string>>").alias("out"))

    def step(now: Column, c: Column) -> Column:
        known = F.coalesce(c["at"] < now["since"] + live, F.lit(False))
        outcome = F.when(~known, "applied").when(now["body"].eqNullSafe(c["body"]), "replayed").otherwise("conflict")
        told = F.struct(c["command_id"].alias("command_id"), outcome.alias("outcome"))
        return F.struct(F.when(known, now["since"]).otherwise(c["at"]).alias("since"), F.when(known, now["body"]).otherwise(c["body"]).alias("body"), F.array_append(now["out"], told).alias("out"))

    told = listed.select(F.inline(F.aggregate("rows", none, step)["out"]))
    return commands.join(told, "command_id").withColumn("replayed", F.col("outcome") == "replayed")
