"""What operators see: cards of evidence and of the queue, rows of a recommendation, map features, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.functions.coerce import js_text
from mobilis.functions.text import capitalised, labelled, lead_clause
from mobilis.operators.desks import DESK_CONNECTORS
from mobilis.operators.numbering import first_rows

#: How many rows a reader is shown of each kind.
CAPS = {"evidence_of_match": 12, "cards": 24, "cited": 24, "policies": 8, "lineage_evidence": 4, "commitments": 6, "evidence_rows": 8, "feeds": 10, "probes": 6, "cleared": 4, "map_points": 80}
#: The members of attributes that a card shows, the first that is there of several.
CARD_MEMBERS = {
    "atlas": {"layer": ["layer"], "congestion_level": ["congestionLevel"], "current_speed_mph": ["currentSpeedMph"], "free_flow_speed_mph": ["freeFlowSpeedMph"], "event_type": ["eventType", "kind"]},
    "aqua": {
        "route_name": ["routeName"], "equipment_id": ["equipmentId"], "in_service": ["inService"], "load": ["load"], "capacity": ["capacity"], "available_units": ["availableUnits"],
        "current_delay_minutes": ["currentDelayMinutes"], "occupancy": ["occupancy", "occupancyPct"],
    },
}
#: The types of nodes that a view of the graph has.
VIEWS = {
    "mobility": ["intersection", "road_segment", "parking_lot", "transit_stop", "transit_vehicle", "transit_route", "staging_area", "emergency_gate", "emergency_corridor", "closure", "detour"],
    "decision_lineage": ["evidence", "finding", "incident", "recommendation", "decision", "commitment", "verification"],
    "agency_coordination": ["agency", "operational_team", "incident", "recommendation", "decision", "commitment", "verification"],
}
#: Words for codes.
PHASES = {
    "readiness": "Getting ready", "arrival": "Arrival", "ingress": "Coming in", "in_game": "During the event", "egress": "Leaving", "after_action": "After-action", "closed": "Closed",
    "steady_state": "Everyday operations", "response": "Response", "recovery": "Recovery",
}
SERVICES = {
    "traffic": "Roads", "ingress": "Arrival routes", "egress": "Departure routes", "parking": "Parking", "transit": "Transit", "emergency_access": "Emergency access", "public_safety": "Public safety",
    "public_works": "Public works", "communications": "Communications", "operational_technology": "Systems",
}
COMMITMENTS = {"requested": "Asked", "acknowledged": "Seen", "approved": "Accepted", "executing": "In progress", "blocked": "Blocked", "verified": "Done", "failed": "Failed", "expired": "Expired", "cancelled": "Cancelled"}
DESKS = {"atlas": "Traffic", "aqua": "Parking & transit", "sentinel": "Public safety", "phoenix": "Emergency routes", "forge": "Roads & utilities", "echo": "Communications"}
CLASSES = {"live": "Live", "reference": "Background", "restricted": "Restricted"}
#: States in which a recommendation waits for somebody.
PENDING = ["awaiting_acknowledgement", "awaiting_approval", "delegated", "escalated"]
SHAPES = ["LineString", "MultiLineString", "Polygon", "MultiPolygon"]


def evidence_cards(evidence: DataFrame, desk: str, most: int = CAPS["cards"]) -> DataFrame:
    """The newest evidence that a desk may read as cards: evidence_id, connector_code, summary, observed_at and members as text.

    ``attributes`` is VARIANT; a member that is missing or ``null`` is null.
    """
    a = F.col("attributes")

    def shown(paths: list[str]) -> Column:
        return F.coalesce(*[F.try_variant_get(a, f"$.{p}", "string") for p in paths])

    seen = evidence.where(F.col("connector_code").isin(DESK_CONNECTORS[desk])).orderBy(F.desc("observed_at"), "evidence_id").limit(most)
    return seen.select("evidence_id", "connector_code", "summary", "observed_at", *[shown(paths).alias(name) for name, paths in CARD_MEMBERS[desk].items()])


def clock(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "HH:mm"), F.lit("—"))


def _said(*texts: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


def queue_cards(recommendations: DataFrame, incidents: DataFrame) -> DataFrame:
    """Pending recommendations as cards: their incident's words where there is one, else their own.

    recommendations(recommendation_id, incident_id, state, priority, why_it_matters,
    what_changed, recommended_action, created_at, expires_at); incidents(incident_id,
    title, severity, why_it_matters, detected_at, affected_services).
    """
    r, i = recommendations.where(F.col("state").isin(PENDING)).alias("r"), incidents.alias("i")
    met = r.join(i, F.col("r.incident_id") == F.col("i.incident_id"), "left")
    tags = F.slice(F.coalesce("i.affected_services", F.array().cast("array<string>")), 1, 3)
    return met.select(
        "r.recommendation_id",
        "r.incident_id",
        capitalised(F.coalesce("i.severity", "r.priority")).alias("severity"),
        clock(F.coalesce("i.detected_at", "r.created_at")).alias("at"),
        F.concat(F.lit("exp "), clock(F.col("r.expires_at"))).alias("expires"),
        lead_clause(_said(F.col("i.why_it_matters"), F.col("r.why_it_matters"), F.col("r.recommended_action"))).alias("title"),
        _said(F.col("i.title"), F.col("r.what_changed")).alias("place"),
        F.transform(tags, lambda s: labelled(s, SERVICES)).alias("tags"),
    )


def evidence_rows(evidence: DataFrame, order: list[Column], most: int = CAPS["evidence_rows"]) -> DataFrame:
    """The first rows of evidence that each recommendation (recommendation_id) shows."""
    return first_rows(evidence, ["recommendation_id"], order, most)


def commitment_rows(commitments: DataFrame, order: list[Column], most: int = CAPS["commitments"]) -> DataFrame:
    """The first commitments of each incident as rows: who, until when, and what to note.

    commitments(incident_id, commitment_id, state, assignee, due_at, blocker, verification_rule, ...).
    """
    first = first_rows(commitments, ["incident_id"], order, most)
    state = F.replace("state", F.lit("_"), F.lit(" "))
    due = F.when(F.col("due_at").isNotNull(), F.concat(F.lit("due "), clock(F.col("due_at")))).otherwise(state)
    return first.select("incident_id", "commitment_id", F.coalesce("assignee", F.lit("unassigned")).alias("owner"), due.alias("due"), _said(F.col("blocker"), F.col("verification_rule"), state).alias("note"), labelled(F.col("state"), COMMITMENTS).alias("label"))


def approval_rows(requirements: DataFrame) -> DataFrame:
    """Requirements as rows: whose part it is and how it stands; waived ones count as done."""
    role = F.replace("role_code", F.lit("_"), F.lit(" "))
    status = F.when(F.col("status") == "satisfied", "Satisfied").when(F.col("status") == "waived", "Waived").otherwise("Pending")
    said = F.when(F.col("status") == "pending", "Required").otherwise(F.col("status"))
    return requirements.select("requirement_id", "agency", F.concat_ws(" · ", said, role).alias("role"), status.alias("status"), F.col("status").isin("satisfied", "waived").alias("done"))


def feed_chips(sources: DataFrame, order: list[Column], most: int = CAPS["feeds"]) -> DataFrame:
    """The first feeds with whether they are muted: not connected, or not healthy."""
    muted = (F.coalesce("connection_status", F.lit("connected")) != "connected") | (F.col("health") != "healthy")
    return sources.orderBy(*order).limit(most).withColumn("muted", muted)


def map_points(observations: DataFrame, order: list[Column], most: int = CAPS["map_points"]) -> DataFrame:
    """The first points that a map shows: not stale, no weather, no reference data."""
    shown = on_map(observations).where((F.col("geometry_type") == "Point") & ~F.col("data_class").eqNullSafe("reference"))
    return shown.orderBy(*order).limit(most)


def map_shapes(observations: DataFrame) -> DataFrame:
    """Lines and areas that a map shows, whatever their class."""
    return on_map(observations).where(F.col("geometry_type").isin(SHAPES))


def on_map(observations: DataFrame) -> DataFrame:
    """Observations (source_code, quality_flags, geometry_type, data_class) that are not stale and not about the weather."""
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    weather = F.col("source_code").contains("weather") | F.arrays_overlap(flags, F.array(F.lit("nws_alert"), F.lit("nws_gridded_forecast")))
    return observations.where(~F.array_contains(flags, "stale") & ~F.coalesce(weather, F.lit(False)))


def by_stance(tasks: DataFrame, stance: str) -> DataFrame:
    """Desks' tasks (status) of a stance; ``all`` shows every one."""
    return tasks if stance == "all" else tasks.where(F.lower("status") == stance)


def stance_tabs(tasks: DataFrame) -> DataFrame:
    """How many tasks each tab of the filter shows: tab, n."""
    counts = tasks.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Contributed", "Abstained", "Dissent")])
    return counts.unpivot([], ["all", "contributed", "abstained", "dissent"], "tab", "n")


def connector_views(definitions: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every defined connector with its source, or what holds without one, and its latest run.

    definitions(connector_code, configured, default_status); sources(source_id,
    connector_code, connection_status, health_status, failures); runs(run_id, source_id,
    status, started_at, accepted).  The latest run is that started last, then the largest id.
    """
    last = runs.groupBy("source_id").agg(F.max_by(F.struct("run_id", F.col("status").alias("run_status"), "started_at", "accepted"), F.struct("started_at", "run_id")).alias("latest"))
    met = definitions.join(sources, "connector_code", "left").join(last, "source_id", "left")
    waits = F.when(F.col("configured") & (F.col("default_status") == "configuration_required"), "connected").otherwise(F.col("default_status"))
    return met.select(
        "connector_code", "source_id", "configured", F.coalesce("connection_status", waits).alias("connection_status"), F.coalesce("health_status", F.lit("unverified")).alias("health_status"),
        F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), "latest.run_id", "latest.run_status", "latest.started_at", "latest.accepted",
    )


def request_hash(body: list[str]) -> Column:
    """SHA-256 of a request's members as JSON, in the order that they came in; nulls count."""
    return F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)


def composed_text(findings: DataFrame) -> DataFrame:
    """The summary of each incident in words: incident_id, observation, interpretation, limitations, status.

    findings(incident_id, place, desk_name, stance, concern); desks are named in the order
    of ``place``, and every dissent with its concern.
    """

    def rows(cond: Column, what: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(cond, F.struct("place", what.alias("said")))))
        return F.transform(found, lambda x: x["said"])

    name, spoke = F.col("desk_name"), F.col("stance").isin("contributed", "dissent")
    both = findings.groupBy("incident_id").agg(
        rows(spoke, name).alias("spoke"), rows(~spoke, name).alias("silent"), rows(F.col("stance") == "dissent", F.concat(name, F.lit(": "), "concern")).alias("concerns")
    )
    who, silent = F.array_join("spoke", ", "), F.array_join("silent", ", ")
    quiet = F.when(F.size("silent") > 0, F.concat(silent, F.lit(" had no evidence to offer."))).otherwise("Every staffed desk reported.")
    nobody = F.concat(F.lit("No staffed desk could evaluate this incident. "), silent, F.lit(" all reported no usable evidence."))
    return both.select(
        "incident_id",
        F.when(F.size("spoke") > 0, F.concat(who, F.lit(" contributed. "), quiet)).otherwise(nobody).alias("observation"),
        F.when(F.size("concerns") > 0, F.concat(F.lit("The desks do not fully agree. "), F.array_join("concerns", " "))).otherwise("No desk raised a conflict with the recommended action.").alias("interpretation"),
        F.when(F.size("silent") > 0, F.concat(F.lit("This recommendation was composed without "), silent, F.lit(". Treat their domains as unassessed, not as clear."))).otherwise("Composed from the staffed desks listed above and the cited evidence only.").alias("limitations"),
        F.when(F.size("spoke") > 0, "contributed").otherwise("abstained").alias("status"),
    )


def what_changed(rule_code: Column, a: Column) -> Column:
    """What a match reports, in words that follow from the attributes (VARIANT) of its first evidence, rule by rule."""

    def t(name: str) -> Column:
        return js_text(a, name)

    def named(*parts: Column | str) -> Column:
        return _said(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    traffic = F.concat(
        F.lit("ALDOT published "), F.lower(t("eventType")), F.lit(' "'), t("title"), F.lit('"'), F.when(named(t("subtitle"), t("route")) != "", F.concat(F.lit(" at "), named(t("subtitle"), t("route")))).otherwise(""), F.lit("."),
        F.when(t("description") != "", F.concat(F.lit(" "), t("description"))).otherwise(""),
    )
    congestion = F.concat(
        F.lit("ALDOT travel time for "), named(t("name"), "the Auburn corridor"), F.lit(" reports "), F.lower(t("congestionLevel")), F.lit(" congestion at "), named(t("averageSpeedMph"), "an unreported"), F.lit(" mph, "),
        named(t("estimatedTimeMinutes"), "unknown"), F.lit(" minutes end to end."),
    )
    city = F.trim(F.concat(F.lit("City of Auburn publishes an in-effect "), t("kind"), F.lit(" on "), named(t("road"), "an unnamed road"), F.lit(": "), t("description")))
    point, closed = named(t("pointName"), t("pointCode")), F.coalesce(F.try_variant_get(a, "$.roadClosure", "boolean"), F.lit(False))
    share = F.floor(F.try_variant_get(a, "$.currentSpeedMph", "double") / F.try_variant_get(a, "$.freeFlowSpeedMph", "double") * 100 + 0.5).cast("string")
    flow = F.when(closed, F.concat(F.lit("Licensed road-flow data reports a closure at "), point, F.lit("."))).otherwise(
        F.concat(F.lit("Licensed road-flow data reports "), t("currentSpeedMph"), F.lit(" mph at "), point, F.lit(" against a "), t("freeFlowSpeedMph"), F.lit(" mph free-flow baseline ("), share, F.lit("%)."))
    )
    alert = F.concat(F.lit("National Weather Service issued "), named(t("eventName"), "Weather alert"), F.when(t("headline") != "", F.concat(F.lit(": "), t("headline"))).otherwise(""))
    gauge = F.concat(
        F.lit("USGS gauge "), t("siteCode"), F.lit(" rose "), t("riseFt"), F.lit(" ft in "), named(t("riseWindowHours"), "3"), F.lit(" hours to "), named(t("gageHeightFt"), "an unreported"),
        F.lit(" ft. Readings are provisional and carry no flood-stage determination."),
    )
    quake = F.concat(F.lit("USGS recorded a magnitude "), t("magnitude"), F.lit(" earthquake near "), named(t("place"), "the region"), F.lit(". Structural and bridge condition is not reported by this feed and must be inspected."))
    siem = F.concat(F.lit("Security monitoring raised a "), F.lower(t("severity")), F.lit(" alert on "), named(t("assetName"), "an operational system"), F.lit("."))
    return (
        F.when(rule_code.isin("algo-crash", "algo-incident", "algo-roadwork"), F.trim(F.regexp_replace(traffic, r"\s+", " ")))
        .when(rule_code == "algo-corridor-congestion", congestion)
        .when(rule_code == "city-restriction-in-effect", city)
        .when(rule_code == "tomtom-corridor-degraded", flow)
        .when(rule_code == "nws-alert-active", alert)
        .when(rule_code == "usgs-stream-rapid-rise", gauge)
        .when(rule_code == "usgs-earthquake-felt", quake)
        .when(rule_code == "siem-critical-alert", siem)
    )
