"""Records as they are read together: events with owners, evidence with sources, decisions with actors.

Every function names the columns it joins on and leaves the choice of the join to Spark,
which knows the sizes; facts that may be unknown stay null and no row is lost for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_owner(events: DataFrame, principals: DataFrame, agencies: DataFrame) -> DataFrame:
    """Events (owner_id) with ``owner`` and ``agency``, null where nobody or an unknown one owns them.

    principals(principal_id, display_name, agency_id); agencies(agency_id, agency_name).
    """
    who = principals.select(F.col("principal_id").alias("owner_id"), F.col("display_name").alias("owner"), "agency_id")
    return events.join(who, "owner_id", "left").join(agencies.select("agency_id", F.col("agency_name").alias("agency")), "agency_id", "left").drop("agency_id")


def with_evidence(links: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (evidence_id, source_id) to evidence that is there, with its summary and the name of its source."""
    met = links.join(evidence.select("evidence_id", "summary"), "evidence_id")
    return met.join(sources.select("source_id", F.col("name").alias("source")), "source_id")


def with_agency(requirements: DataFrame, agencies: DataFrame) -> DataFrame:
    """Requirements (agency_id) with their agency's columns and ``n_of_agency``, how many it has in all."""
    counts = requirements.groupBy("agency_id").agg(F.count(F.lit(1)).alias("n_of_agency"))
    return requirements.join(counts.join(agencies, "agency_id"), "agency_id")


def decision_trail(decisions: DataFrame, recommendations: DataFrame, principals: DataFrame, agencies: DataFrame) -> DataFrame:
    """Decisions (recommendation_id) with their recommendation, actor and agency.

    recommendations(recommendation_id, actor_id, ...); principals(actor_id, actor, agency_id);
    agencies(agency_id, ...).
    """
    return decisions.join(recommendations, "recommendation_id").join(principals, "actor_id").join(agencies, "agency_id")


def with_incident(queue: DataFrame, incidents: DataFrame, other: str = "none") -> DataFrame:
    """The queue (incident_id) with ``incident`` and ``kind`` of its incident; ``other`` where there is none."""
    met = queue.join(incidents.select("incident_id", F.col("title").alias("incident"), "kind"), "incident_id", "left")
    return met.withColumn("kind", F.coalesce("kind", F.lit(other)))


def findings_in_order(findings: DataFrame, by: list[str], composer: Column, contributed: Column, then: list[str]) -> DataFrame:
    """Findings with their ``place``: the composer's first, then those that contributed, then by ``then``."""
    w = Window.partitionBy(*by).orderBy(F.desc(composer), F.desc(contributed), *then)
    return findings.withColumn("place", F.row_number().over(w))


def commitments_of_event(commitments: DataFrame, incidents: DataFrame, agencies: DataFrame, principals: DataFrame, event_id: Column) -> DataFrame:
    """The commitments of an event's incidents with their agency and, where one is assigned, the person.

    commitments(commitment_id, incident_id, agency_id, assignee_id, ...); incidents(incident_id,
    event_id); agencies(agency_id, agency_name); principals(principal_id, display_name).
    """
    of = incidents.where(F.col("event_id") == event_id).select("incident_id")
    met = commitments.join(of, "incident_id", "left_semi").join(agencies.select("agency_id", "agency_name"), "agency_id")
    return met.join(principals.select(F.col("principal_id").alias("assignee_id"), F.col("display_name").alias("assignee")), "assignee_id", "left")


def is_live(connection: Column, health: Column) -> Column:
    """Whether a feed is live: connected (or never said otherwise) and healthy."""
    return (F.coalesce(connection, F.lit("connected")) == "connected") & F.coalesce(health == "healthy", F.lit(False))


def rail(feeds: DataFrame, live: Column, n_cited: DataFrame, expires_at: Column, now: Column) -> DataFrame:
    """One row: n_live, n_degraded, n_uncited (what is observed and not cited, at least 0) and n_expired."""
    counts = feeds.agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_degraded"), F.count(F.lit(1)).alias("_n"), F.count_if(expires_at <= now).alias("n_expired"))
    return counts.crossJoin(n_cited).select("n_live", "n_degraded", F.greatest(F.lit(0).cast("long"), F.col("_n") - F.col("n_cited")).alias("n_uncited"), "n_expired")  # one row each


def checkpointed(checkpoints: DataFrame, batches: DataFrame, order: list[str]) -> DataFrame:
    """Checkpoints (source_id, metadata, updated_at) after batches: a source's last one in ``order`` replaces what is stored.

    A batch without metadata says nothing and changes nothing.
    """
    last = batches.where("metadata IS NOT NULL").groupBy("source_id").agg(F.max_by(F.struct("metadata", "updated_at"), F.struct(*order)).alias("new"))
    old = checkpoints.select("source_id", F.struct("metadata", "updated_at").alias("old"))
    both = old.join(last, "source_id", "full")
    return both.select("source_id", F.coalesce("new", "old").alias("c")).select("source_id", "c.*")


def pilot_measures(incidents: DataFrame, decisions: DataFrame, by: str) -> DataFrame:
    """Measures of a pilot by ``by``: n_incidents, n_decided, the mean minutes to the first decision and the share acknowledged.

    incidents(incident_id, detected_at, ...); decisions(incident_id, decided_at, acknowledged).
    """
    first = decisions.groupBy("incident_id").agg(F.min("decided_at").alias("first_at"), F.count(F.lit(1)).alias("n"), F.count_if("acknowledged").alias("seen"))
    met = incidents.join(first, "incident_id", "left")
    minutes = F.timestamp_diff("MICROSECOND", F.col("detected_at"), F.col("first_at")) / 1e6 / 60
    return met.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_incidents"), F.count("first_at").alias("n_decided"), F.avg(minutes).alias("mean_minutes_to_decision"), (F.sum("seen").cast("double") / F.sum("n").cast("double")).alias("acknowledged_share")
    )


def service_measures(sources: DataFrame, corridors: DataFrame, exceptions: DataFrame) -> DataFrame:
    """measure, share: feeds that are fresh, corridors that are open, exceptions that are resolved.

    sources(fresh); corridors(open); exceptions(resolved): booleans, a null counts as false;
    a table without rows has no share.
    """
    parts = [("fresh_feeds", sources, "fresh"), ("open_corridors", corridors, "open"), ("resolved_exceptions", exceptions, "resolved")]
    rows = [df.agg((F.count_if(F.col(c)) / F.count(F.lit(1))).alias("share")).select(F.lit(name).alias("measure"), "share") for name, df, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
