"""Queries of cards, rows, words and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.functions.text import labelled
from mobilis.operators import boards, detection, graph, lifecycle
from mobilis.plans import desk_queries, graph_queries
from mobilis.plans.common import EDGES, EV, NODES, catalogue, evidence, geography, table

Q, SQL, query = catalogue()


def _picked(values: list[str | None], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def _choice(values: list[str | None], n: str) -> str:
    """The same choice in SQL."""
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values)) + " END"


def _lead(text: str) -> str:
    return f"CASE WHEN trim(regexp_extract({text}, '^([^.!?]*)', 1)) <> '' THEN trim(regexp_extract({text}, '^([^.!?]*)', 1)) ELSE trim({text}) END"


# ---- cards -----------------------------------------------------------------------


@query(f"""WITH {EV} SELECT evidence_id, CASE connector_code WHEN 'click' THEN 'aldot-algo-traffic-v1' ELSE 'tomtom-traffic-flow-v1' END AS connector_code, 'seen ' || evidence_id AS summary, observed_at,
  CASE WHEN connector_code = 'click' THEN CASE k % 4 WHEN 0 THEN 'traffic_event' WHEN 2 THEN 'message_sign' ELSE 'travel_time' END END AS layer,
  CASE WHEN connector_code = 'click' AND k % 4 = 1 THEN CASE k % 3 WHEN 0 THEN 'Heavy' WHEN 1 THEN 'Unaffected' ELSE '' END END AS congestion_level,
  CASE WHEN connector_code = 'error' THEN CAST(cents AS VARCHAR) END AS current_speed_mph, CASE WHEN connector_code = 'error' THEN CASE WHEN k % 10 = 0 THEN '0' ELSE '10000' END END AS free_flow_speed_mph, CAST(NULL AS VARCHAR) AS event_type
FROM ev WHERE connector_code IN ('click', 'error') ORDER BY observed_at DESC, evidence_id LIMIT 24""")
def evidence_card_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The cards of one desk with all their fields."""
    snapshot = desk_queries._snapshot(spark, sf).withColumn("summary", F.concat(F.lit("seen "), "evidence_id"))
    return boards.evidence_cards(snapshot, "atlas")


_WHY = [None, "", "Holds the lane. Then more", "Why not? Yes", "...all of it"]
_TAGS = ["traffic", "transit", "new_service", "parking", "public_works"]


@query(f"""WITH r AS (SELECT o_orderkey AS recommendation_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'awaiting_approval' ELSE 'delegated' END AS state, o_orderpriority, {_choice(_WHY, "o_orderkey")} AS why, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS created FROM orders),
i AS (SELECT c_custkey, lower(replace(c_mktsegment, 'E', '_')) AS severity, {_choice(_WHY, "c_custkey")} AS why, c_name FROM customer WHERE c_custkey % 4 <> 1),
m AS (SELECT *, coalesce(nullif(i.why, ''), nullif(r.why, ''), 'Look at it') AS said, replace(coalesce(severity, o_orderpriority), '_', ' ') AS word FROM r LEFT JOIN i ON c_custkey = o_custkey WHERE state <> 'approved')
SELECT recommendation_id, o_custkey AS incident_id, upper(substr(word, 1, 1)) || substr(word, 2) AS severity, strftime(created, '%H:%M') AS shown_at, 'exp ' || strftime(created + INTERVAL 6 HOUR, '%H:%M') AS expires, {_lead("said")} AS title,
  coalesce(c_name, 'changed ' || recommendation_id) AS place, CASE WHEN c_custkey IS NULL THEN '' ELSE 'Roads,Transit,new service' END AS tags FROM m""")
def queue_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Pending recommendations as cards with the words of their incident, else with their own."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("delegated")
    created = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
    recommendations = o.select(
        key.alias("recommendation_id"), F.col("o_custkey").alias("incident_id"), state.alias("state"), F.col("o_orderpriority").alias("priority"), _picked(_WHY, key).alias("why_it_matters"), F.concat(F.lit("changed "), key).alias("what_changed"),
        F.lit("Look at it").alias("recommended_action"), created.alias("created_at"), (created + F.expr("INTERVAL 6 HOURS")).alias("expires_at"),
    )
    severity = F.lower(F.replace("c_mktsegment", F.lit("E"), F.lit("_")))
    incidents = c.where("c_custkey % 4 <> 1").select(
        F.col("c_custkey").alias("incident_id"), F.col("c_name").alias("title"), severity.alias("severity"), _picked(_WHY, F.col("c_custkey")).alias("why_it_matters"), F.lit(None).cast("timestamp_ntz").alias("detected_at"), F.array(*[F.lit(t) for t in _TAGS]).alias("affected_services")
    )
    return boards.queue_cards(recommendations, incidents).withColumn("tags", F.array_join("tags", ",")).withColumnRenamed("at", "shown_at")


_STATES = ["requested", "acknowledged", "approved", "executing", "blocked", "verified", "failed", "expired", "cancelled", "put_off"]


@query(f"""WITH c AS (SELECT l_suppkey AS incident_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS commitment_id, {_choice(_STATES, "l_partkey")} AS state, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS assignee,
  CASE WHEN l_linestatus = 'O' THEN l_shipdate + to_minutes(CAST(l_partkey % 1440 AS INTEGER)) END AS due_at, CASE WHEN l_partkey % 3 = 0 THEN 'waits for parts' ELSE '' END AS blocker, CASE WHEN l_partkey % 2 = 0 THEN 'a photo' END AS rule FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY commitment_id) AS rn FROM c)
SELECT incident_id, commitment_id, coalesce(assignee, 'unassigned') AS owner, CASE WHEN due_at IS NULL THEN replace(state, '_', ' ') ELSE 'due ' || strftime(due_at, '%H:%M') END AS due, coalesce(nullif(blocker, ''), rule, replace(state, '_', ' ')) AS note,
  CASE state WHEN 'requested' THEN 'Asked' WHEN 'acknowledged' THEN 'Seen' WHEN 'approved' THEN 'Accepted' WHEN 'executing' THEN 'In progress' WHEN 'blocked' THEN 'Blocked' WHEN 'verified' THEN 'Done' WHEN 'failed' THEN 'Failed' WHEN 'expired' THEN 'Expired' WHEN 'cancelled' THEN 'Cancelled' ELSE 'put off' END AS label FROM f WHERE rn <= 6""")
def commitment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first six commitments of each incident as rows."""
    l, part = table(spark, sf, "lineitem"), F.col("l_partkey")
    rows = l.select(
        F.col("l_suppkey").alias("incident_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("commitment_id"), _picked(_STATES, part).alias("state"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("assignee"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate") + F.make_dt_interval(mins=(part % 1440).cast("int"))).alias("due_at"), F.when(part % 3 == 0, "waits for parts").otherwise("").alias("blocker"), F.when(part % 2 == 0, "a photo").alias("verification_rule"),
    )
    return boards.commitment_rows(rows, [F.asc("commitment_id")])


@query("""WITH e AS (SELECT l_orderkey AS recommendation_id, l_partkey AS evidence_id, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT recommendation_id, evidence_id, l_shipdate AS observed_at FROM e WHERE rn <= 8""")
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recommendation_id"), F.col("l_partkey").alias("evidence_id"), F.col("l_shipdate").alias("observed_at"), "l_suppkey")
    return boards.evidence_rows(rows, [F.desc("observed_at"), F.asc("evidence_id"), F.asc("l_suppkey")]).drop("l_suppkey")


@query("""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS requirement_id, s_name AS agency, CASE l_returnflag WHEN 'A' THEN 'satisfied' WHEN 'R' THEN 'waived' ELSE 'pending' END AS status FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT requirement_id, agency, CASE status WHEN 'pending' THEN 'Required' ELSE status END || ' · duty officer' AS role, CASE status WHEN 'satisfied' THEN 'Satisfied' WHEN 'waived' THEN 'Waived' ELSE 'Pending' END AS status, status <> 'pending' AS done FROM r""")
def approval_rows(spark: SparkSession, sf: str) -> DataFrame:
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    status = F.when(F.col("l_returnflag") == "A", "satisfied").when(F.col("l_returnflag") == "R", "waived").otherwise("pending")
    met = l.join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return boards.approval_rows(met.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("requirement_id"), F.col("s_name").alias("agency"), F.lit("duty_officer").alias("role_code"), status.alias("status")))


@query("""WITH s AS (SELECT s_suppkey AS source_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'connected' ELSE 'permission_required' END AS c, CASE WHEN s_suppkey % 5 = 0 THEN 'delayed' ELSE 'healthy' END AS health FROM supplier)
SELECT source_id, name, coalesce(c, 'connected') <> 'connected' OR health <> 'healthy' AS muted FROM s ORDER BY name, source_id LIMIT 10""")
def feed_chips(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    sources = table(spark, sf, "supplier").select(k.alias("source_id"), F.col("s_name").alias("name"), _picked([None, "connected", "permission_required"], k).alias("connection_status"), F.when(k % 5 == 0, "delayed").otherwise("healthy").alias("health"))
    return boards.feed_chips(sources, [F.asc("name"), F.asc("source_id")]).select("source_id", "name", "muted")


# ---- words -----------------------------------------------------------------------


def _label_sql(code: str, labels: dict[str, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE replace({code}, '_', ' ') END"


_WORDS = {"phase": boards.PHASES, "service": boards.SERVICES, "commitment": boards.COMMITMENTS, "desk": boards.DESKS, "class": boards.CLASSES}


@query("SELECT l_orderkey, l_partkey, " + ", ".join(f"{_label_sql('(' + _choice([*labels, 'some_other'], 'l_partkey') + ')', labels)} AS {name}" for name, labels in _WORDS.items()) + " FROM lineitem")
def code_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of five kinds as words; an unknown one with blanks."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", *[labelled(_picked([*labels, "some_other"], F.col("l_partkey")), labels).alias(name) for name, labels in _WORDS.items()])


_DESKS = ["Traffic", "Water", "Safety", "Routes"]


@query(f"""WITH f AS (SELECT l_orderkey AS incident_id, l_linenumber AS place, {_choice(_DESKS, "l_partkey")} AS desk, CASE l_returnflag WHEN 'A' THEN 'contributed' WHEN 'R' THEN 'dissent' ELSE CASE l_linestatus WHEN 'O' THEN 'abstained' ELSE 'no_feed' END END AS stance FROM lineitem),
g AS (SELECT incident_id, coalesce(list(desk ORDER BY place, desk) FILTER (stance IN ('contributed', 'dissent')), []) AS spoke, coalesce(list(desk ORDER BY place, desk) FILTER (stance NOT IN ('contributed', 'dissent')), []) AS silent, coalesce(list(desk || ': line ' || place ORDER BY place, desk || ': line ' || place) FILTER (stance = 'dissent'), []) AS concerns FROM f GROUP BY 1),
t AS (SELECT *, array_to_string(silent, ', ') AS quiet FROM g)
SELECT incident_id, CASE WHEN len(spoke) > 0 THEN array_to_string(spoke, ', ') || ' contributed. ' || CASE WHEN len(silent) > 0 THEN quiet || ' had no evidence to offer.' ELSE 'Every staffed desk reported.' END ELSE 'No staffed desk could evaluate this incident. ' || quiet || ' all reported no usable evidence.' END AS observation,
  CASE WHEN len(concerns) > 0 THEN 'The desks do not fully agree. ' || array_to_string(concerns, ' ') ELSE 'No desk raised a conflict with the recommended action.' END AS interpretation,
  CASE WHEN len(silent) > 0 THEN 'This recommendation was composed without ' || quiet || '. Treat their domains as unassessed, not as clear.' ELSE 'Composed from the staffed desks listed above and the cited evidence only.' END AS limitations, CASE WHEN len(spoke) > 0 THEN 'contributed' ELSE 'abstained' END AS status FROM t""")
def composition_words(spark: SparkSession, sf: str) -> DataFrame:
    """What the desks said together, who was silent and where they differ."""
    l = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    stance = F.when(flag == "A", "contributed").when(flag == "R", "dissent").when(F.col("l_linestatus") == "O", "abstained").otherwise("no_feed")
    return boards.composed_text(l.select(F.col("l_orderkey").alias("incident_id"), F.col("l_linenumber").alias("place"), _picked(_DESKS, F.col("l_partkey")).alias("desk_name"), stance.alias("stance"), F.concat(F.lit("line "), "l_linenumber").alias("concern")))


_TEXT = "CASE WHEN {c} THEN {v} ELSE '' END"


@query(f"""WITH {EV}, n AS (SELECT *, split_part(source_event_id, ':', 2) AS who FROM ev)
SELECT evidence_id, CASE connector_code
  WHEN 'click' THEN 'ALDOT published crash "Lane ' || who || '"' || CASE WHEN k % 3 = 0 THEN ' at mile ' || k WHEN k % 3 = 1 THEN ' at Route ' || k ELSE '' END || '.' || CASE WHEN k % 2 = 0 THEN ' Two lanes shut' ELSE '' END
  WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'Licensed road-flow data reports a closure at ' || who || '.' ELSE 'Licensed road-flow data reports ' || k || ' mph at P' || who || ' against a 128 mph free-flow baseline (' || CAST(floor(k / 128 * 100 + 0.5) AS BIGINT) || '%).' END
  WHEN 'purchase' THEN 'National Weather Service issued ' || CASE WHEN k % 2 = 0 THEN 'Flood Watch' ELSE 'Weather alert' END || CASE WHEN k % 3 = 0 THEN ': River ' || who ELSE '' END
  WHEN 'signup' THEN 'USGS gauge ' || who || ' rose ' || k || ' ft in ' || CASE WHEN k % 2 = 0 THEN 6 ELSE 3 END || ' hours to ' || CASE WHEN k % 3 = 0 THEN CAST(cents AS VARCHAR) ELSE 'an unreported' END || ' ft. Readings are provisional and carry no flood-stage determination.'
  ELSE CASE WHEN k % 2 = 0 THEN 'ALDOT travel time for ' || CASE WHEN k % 4 = 0 THEN 'I-85' ELSE 'the Auburn corridor' END || ' reports heavy congestion at ' || CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) ELSE 'an unreported' END || ' mph, ' || k || ' minutes end to end.'
    ELSE 'City of Auburn publishes an in-effect closure on ' || CASE WHEN k % 3 = 0 THEN 'an unnamed road' ELSE 'Road ' || who END || ': until ' || k END END AS text FROM n""")
def match_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What each observation would report as the first of a match, in the words of its rule."""
    ev = evidence(spark, sf)
    k, c, who = F.col("k"), F.col("connector_code"), F.element_at(F.split("source_event_id", ":"), -1)
    struct = lambda **x: F.to_json(F.struct(*[v.alias(n) for n, v in x.items()]))
    json = (
        F.when(c == "click", struct(eventType=F.lit("Crash"), title=F.concat(F.lit("Lane  "), who), subtitle=F.when(k % 3 == 0, F.concat(F.lit("mile "), k)), route=F.when(k % 3 == 1, F.concat(F.lit("Route "), k)), description=F.when(k % 2 == 0, F.lit("Two lanes \n shut ")).otherwise("")))
        .when(c == "error", struct(pointCode=who, pointName=F.when(k % 5 != 0, F.concat(F.lit("P"), who)), roadClosure=k % 5 == 0, currentSpeedMph=k, freeFlowSpeedMph=F.lit(128)))
        .when(c == "purchase", struct(eventName=F.when(k % 2 == 0, "Flood Watch").otherwise(""), headline=F.when(k % 3 == 0, F.concat(F.lit("River "), who))))
        .when(c == "signup", struct(siteCode=who, riseFt=k, riseWindowHours=F.when(k % 2 == 0, 6), gageHeightFt=F.when(k % 3 == 0, F.col("cents"))))
        .when(k % 2 == 0, struct(name=F.when(k % 4 == 0, "I-85"), congestionLevel=F.lit("Heavy"), averageSpeedMph=F.when(k % 3 == 0, k), estimatedTimeMinutes=k))
        .otherwise(struct(kind=F.lit("closure"), road=F.when(k % 3 != 0, F.concat(F.lit("Road "), who)), description=F.concat(F.lit("until "), k)))
    )
    rule = F.when(c == "click", "algo-crash").when(c == "error", "tomtom-corridor-degraded").when(c == "purchase", "nws-alert-active").when(c == "signup", "usgs-stream-rapid-rise").when(k % 2 == 0, "algo-corridor-congestion").otherwise("city-restriction-in-effect")
    return ev.select("evidence_id", rule.alias("rule"), F.parse_json(json).alias("a")).select("evidence_id", boards.what_changed(F.col("rule"), F.col("a")).alias("text"))


@query(f"""WITH {EV}, n AS (SELECT evidence_id, CASE WHEN k % 7 = 0 THEN 0 ELSE cents END AS cur, CASE WHEN k % 10 = 0 THEN 0 ELSE 10000 END AS free FROM ev WHERE connector_code = 'error')
SELECT evidence_id, free > 0 AS comparable, CASE WHEN free > 0 THEN floor(cur / free * 1000 + 0.5) / 1000 END AS ratio, coalesce(CASE WHEN free > 0 THEN cur / free < 0.6 END, false) AS below_threshold FROM n""")
def freeflow_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds against free flow: to three places, and whether they call for a review."""
    k, cents = F.col("k"), F.col("cents")
    json = F.concat(F.lit('{"currentSpeedMph":'), F.when(k % 7 == 0, "null").otherwise(cents.cast("string")), F.lit(',"freeFlowSpeedMph":'), F.when(k % 10 == 0, '"0"').otherwise("10000"), F.lit("}"))
    rows = evidence(spark, sf).where("connector_code = 'error'").select("evidence_id", F.parse_json(json).alias("a"))
    return rows.select("evidence_id", *[v.alias(n) for n, v in detection.freeflow(F.col("a")).items()])


# ---- requirements ----------------------------------------------------------------

_ROLES = [("1-URGENT", [("city", "lead"), ("fire", "chief"), ("city", "lead")]), ("2-HIGH", [("city", "lead"), ("nobody", "chief")]), ("3-MEDIUM", [])]


@query("""WITH p(rule_code, sequence, agency_code, role_code) AS (VALUES ('1-URGENT', 1, 'city', 'lead'), ('1-URGENT', 2, 'fire', 'chief'), ('2-HIGH', 1, 'city', 'lead')),
e AS (SELECT DISTINCT l_orderkey AS recommendation_id, 'city' AS agency_code, 'lead' AS role_code, 9 AS sequence, 'satisfied' AS status FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)
SELECT recommendation_id, agency_code, role_code, CAST(sequence AS BIGINT) AS sequence, status FROM e
UNION ALL SELECT o_orderkey, p.agency_code, p.role_code, p.sequence, 'pending' FROM orders JOIN p ON rule_code = o_orderpriority LEFT JOIN e ON e.recommendation_id = o_orderkey AND e.agency_code = p.agency_code AND e.role_code = p.role_code WHERE e.recommendation_id IS NULL""")
def requirements_written(spark: SparkSession, sf: str) -> DataFrame:
    """Approval requirements written with their recommendations: each once, what is there stays."""
    approvals = spark.createDataFrame(_ROLES, "rule_code string, approvals array<struct<agency_code:string,role_code:string>>")
    agencies = spark.createDataFrame([("city",), ("fire",)], "agency_code string")
    there = table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_linenumber = 1").select(F.col("l_orderkey").alias("recommendation_id")).distinct()
    existing = there.select("recommendation_id", F.lit("city").alias("agency_code"), F.lit("lead").alias("role_code"), F.lit(9).cast("long").alias("sequence"), F.lit("satisfied").alias("status"))
    recommendations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recommendation_id"), F.col("o_orderpriority").alias("rule_code"))
    return lifecycle.required(recommendations, approvals, agencies, existing)


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS rid, l_suppkey % 5 AS agency FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS rid, l_suppkey % 5 AS agency FROM lineitem WHERE l_returnflag <> 'N'),
p AS (SELECT q.rid, count(*) FILTER (d.rid IS NULL AND q.agency <> 4) AS n FROM q LEFT JOIN d USING (rid, agency) GROUP BY 1)
SELECT o_orderkey AS recommendation_id, coalesce(n, 0) AS n_pending, CASE WHEN o_orderkey NOT IN (SELECT rid FROM d) THEN 'draft' WHEN coalesce(n, 0) > 0 THEN 'awaiting_approval' ELSE 'approved' END AS state FROM orders LEFT JOIN p ON rid = o_orderkey""")
def requirements_pending(spark: SparkSession, sf: str) -> DataFrame:
    """How many requirements are pending after the approvals, and what that makes of the recommendation."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recommendation_id"), (F.col("l_suppkey") % 5).alias("agency_code"), "l_returnflag")
    asked = l.select("recommendation_id", "agency_code").distinct().withColumn("status", F.when(F.col("agency_code") == 4, "waived").otherwise("pending"))
    recommendations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recommendation_id"), F.lit("draft").alias("state"))
    return lifecycle.after_approval(recommendations, asked, l.where("l_returnflag <> 'N'"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {_choice(_STATES, "l_partkey")} NOT IN ('verified', 'failed', 'expired', 'cancelled')""")
def unresolved_commitments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("state", _picked(_STATES, F.col("l_partkey")))
    return lifecycle.unresolved(rows).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- views -----------------------------------------------------------------------


@query(f"""WITH {graph_queries.LINEAGE}, every AS ({graph_queries.SQL["lineage_nodes"].split(graph_queries.LINEAGE)[1]})
SELECT node_id, node_type FROM every WHERE node_type IN ('incident', 'recommendation', 'decision', 'commitment', 'verification')""")
def graph_view_members(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that a view of the graph has, by the types of that view."""
    nodes, _ = graph_queries._lineage(spark, sf)
    return nodes.where(F.col("node_type").isin(boards.VIEWS["agency_coordination"])).select("node_id", "node_type")


@query(f"""WITH {NODES}, {EDGES}, w AS (SELECT dst AS node_id, 1 AS depth FROM edges WHERE src LIKE 'supplier:%' UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src LIKE 'supplier:%')
SELECT CAST(row_number() OVER (ORDER BY depth, label, node_id) AS BIGINT) AS place, node_id, CAST(depth AS BIGINT) AS depth, label FROM (SELECT DISTINCT node_id, depth FROM w) JOIN nodes USING (node_id) QUALIFY place <= 40""")
def impact_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """What lies downstream of all suppliers, nearest first, then by label; the first forty."""
    nodes, edges = geography(spark, sf)
    start = nodes.where("node_type = 'supplier'").select("node_id")
    walked = graph.impact(edges, start).select("node_id", "depth").distinct()
    top = graph.in_order(walked, nodes).limit(40)
    rows = top.groupBy().agg(F.array_sort(F.collect_list(F.struct("depth", "label", "node_id"))).alias("rows"))  # forty at most
    return rows.select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).cast("long").alias("place"), F.col("r.node_id"), F.col("r.depth"), F.col("r.label"))


_MAP = f"""{EV}, o AS (SELECT evidence_id, observed_at, CASE WHEN connector_code = 'view' THEN 'city-weather' ELSE connector_code END AS source_code, CASE k % 5 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 3 THEN NULL ELSE 'MultiPolygon' END AS shape,
  k % 7 = 0 AS stale, k % 11 = 0 AS alert, CASE WHEN k % 3 = 0 THEN 'reference' WHEN k % 3 = 1 THEN 'live' END AS class FROM ev), m AS (SELECT * FROM o WHERE NOT stale AND NOT alert AND source_code <> 'city-weather')"""


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("k"), F.col("connector_code")
    flags = F.array_compact(F.array(F.when(k % 7 == 0, "stale"), F.when(k % 11 == 0, "nws_alert")))
    return evidence(spark, sf).select("evidence_id", "observed_at", F.when(c == "view", "city-weather").otherwise(c).alias("source_code"), flags.alias("quality_flags"), _picked(["Point", "LineString", "Polygon", None, "MultiPolygon"], k).alias("geometry_type"), _picked(["reference", "live", None], k).alias("data_class"))


@query(f"WITH {_MAP} SELECT evidence_id FROM m WHERE shape = 'Point' AND class IS DISTINCT FROM 'reference' ORDER BY observed_at DESC, evidence_id LIMIT 80")
def map_points(spark: SparkSession, sf: str) -> DataFrame:
    return boards.map_points(_observed(spark, sf), [F.desc("observed_at"), F.asc("evidence_id")]).select("evidence_id")


@query(f"WITH {_MAP} SELECT evidence_id, shape AS geometry_type FROM m WHERE shape <> 'Point'")
def map_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and areas of the map, reference data too."""
    return boards.map_shapes(_observed(spark, sf)).select("evidence_id", "geometry_type")


_TASKS = ["Contributed", "Abstained", "Dissent", "Idle"]


@query(f"""WITH t AS (SELECT {_choice(_TASKS, "l_partkey")} AS status FROM lineitem) SELECT 'all' AS tab, count(*) AS n FROM t UNION ALL SELECT lower(status), count(*) FROM t WHERE status <> 'Idle' GROUP BY status""")
def stance_tabs(spark: SparkSession, sf: str) -> DataFrame:
    return boards.stance_tabs(table(spark, sf, "lineitem").select(_picked(_TASKS, F.col("l_partkey")).alias("status")))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {_choice(_TASKS, 'l_partkey')} = 'Dissent'")
def tasks_of_stance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _picked(_TASKS, F.col("l_partkey")).alias("status"))
    return boards.by_stance(rows, "dissent").drop("status")


@query("""WITH d AS (SELECT DISTINCT user_id, 'c' || user_id AS connector_code, user_id % 2 = 0 AS configured, CASE user_id % 3 WHEN 0 THEN 'configuration_required' WHEN 1 THEN 'connected' ELSE 'permission_required' END AS default_status FROM events),
s AS (SELECT DISTINCT user_id AS source_id, 'c' || user_id AS connector_code, CASE WHEN user_id % 7 = 1 THEN 'not_connected' END AS connection_status, CASE WHEN user_id % 4 = 0 THEN 'delayed' END AS health_status, user_id % 6 AS failures FROM events WHERE user_id % 5 <> 0),
r AS (SELECT user_id AS source_id, event_id AS run_id, event_type AS run_status, ts AS started, CAST(round(value) AS BIGINT) AS accepted, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'view')
SELECT d.connector_code, s.source_id, configured, coalesce(connection_status, CASE WHEN configured AND default_status = 'configuration_required' THEN 'connected' ELSE default_status END) AS connection_status, coalesce(health_status, 'unverified') AS health_status, coalesce(failures, 0) AS failures, run_id, run_status, started AS started_at, accepted
FROM d LEFT JOIN s ON s.connector_code = d.connector_code LEFT JOIN r ON r.source_id = s.source_id AND rn = 1""")
def connector_views(spark: SparkSession, sf: str) -> DataFrame:
    """Every connector with its source and its latest run, or what holds without them."""
    e = table(spark, sf, "events")
    u, code = F.col("user_id"), F.concat(F.lit("c"), F.col("user_id")).alias("connector_code")
    who = e.select("user_id").distinct()
    definitions = who.select(code, (u % 2 == 0).alias("configured"), _picked(["configuration_required", "connected", "permission_required"], u).alias("default_status"))
    sources = who.where("user_id % 5 <> 0").select(u.alias("source_id"), code, F.when(u % 7 == 1, "not_connected").alias("connection_status"), F.when(u % 4 == 0, "delayed").alias("health_status"), (u % 6).alias("failures"))
    runs = e.where("event_type <> 'view'").select(F.col("event_id").alias("run_id"), u.alias("source_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.round("value").cast("long").alias("accepted"))
    return boards.connector_views(definitions, sources, runs)


@query("""SELECT o_orderkey, sha256('{"o_orderstatus":"' || o_orderstatus || '","o_orderkey":' || o_orderkey || ',"note":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"n' || o_custkey || '"' END || '}') AS hash FROM orders""")
def request_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of requests as they were written: the order of members and nulls count."""
    o = table(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") % 2 != 0, F.concat(F.lit("n"), "o_custkey")))
    return o.select("o_orderkey", boards.request_hash(["o_orderstatus", "o_orderkey", "note"]).alias("hash"))


@query("""SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events WHERE event_type ILIKE '%I%' AND event_type NOT LIKE '%I%'""")
def log_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Instants of a log in milliseconds, of the kinds that a pattern names in any case."""
    e, kind = table(spark, sf, "events"), F.col("event_type")
    return e.where(kind.ilike("%I%") & ~kind.like("%I%")).select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))
