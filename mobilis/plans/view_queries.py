"""Queries of the read path: joins of what is shown, labels, orders and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.functions.text import CONNECTION_LABELS, feed_owners, labelled, named_in, nearest_nice, queue_alert
from mobilis.functions.time import clock, lag_label, minutes_left, remaining_label
from mobilis.operators import records, views
from mobilis.plans.common import AS_OF_TEXT, EV, as_of, catalogue, evidence, table
from mobilis.plans.evidence_queries import HITS, _hits

Q, SQL, query = catalogue()


@query("""SELECT o_orderkey, c_name AS owner, n_name AS agency FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0 LEFT JOIN nation ON n_nationkey = c_nationkey""")
def event_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its owner and the owner's agency, where known."""
    principals = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("display_name"), F.col("c_nationkey").alias("agency_id"))
    events = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id"))
    return records.with_owner(events, principals, _agencies(spark, sf)).drop("owner_id")


def _agencies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name"))


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency"), F.col("r_name").alias("area"))


@query("""SELECT l_orderkey, l_linenumber, p_name AS summary, s_name AS source FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def recommendation_evidence(spark: SparkSession, sf: str) -> DataFrame:
    l, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    links = l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("evidence_id"), F.col("l_suppkey").alias("source_id"))
    found = records.with_evidence(links, p.select(F.col("p_partkey").alias("evidence_id"), F.col("p_name").alias("summary")), s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name")))
    return found.drop("evidence_id", "source_id")


@query("""SELECT s_suppkey, n_name AS agency, r_name AS area, count(*) OVER (PARTITION BY n_nationkey) AS n_of_agency FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def requirement_agencies(spark: SparkSession, sf: str) -> DataFrame:
    requirements = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("agency_id"))
    return records.with_agency(requirements, _areas(spark, sf)).drop("agency_id")


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority, c_name AS actor, n_name AS agency, r_name AS area FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_returnflag = 'A'""")
def decision_trail(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with their recommendation, actor and agency: a star of five tables."""
    l, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    decisions = l.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("recommendation_id"), "l_linenumber")
    recommendations = o.select(F.col("o_orderkey").alias("recommendation_id"), "o_orderpriority", F.col("o_custkey").alias("actor_id"))
    principals = c.select(F.col("c_custkey").alias("actor_id"), F.col("c_name").alias("actor"), F.col("c_nationkey").alias("agency_id"))
    found = records.decision_trail(decisions, recommendations, principals, _areas(spark, sf))
    return found.drop("agency_id", "actor_id").withColumnRenamed("recommendation_id", "l_orderkey")


@query("""SELECT o_orderkey, c_name AS incident, coalesce(c_mktsegment, 'none') AS kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0 WHERE o_orderstatus <> 'F'""")
def queue_related_incident(spark: SparkSession, sf: str) -> DataFrame:
    incidents = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("incident_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"))
    queue = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_custkey").alias("incident_id"))
    return records.with_incident(queue, incidents).drop("incident_id")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_shipdate IS NOT NULL AND l_returnflag = 'N') DESC, (l_linestatus = 'O') DESC, l_partkey, l_linenumber) AS place FROM lineitem""")
def finding_order(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a recommendation: the composer's first, then those that contributed, then by desk."""
    rows = records.findings_in_order(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "N", F.col("l_linestatus") == "O", ["l_partkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", "place")


@query("""SELECT n_regionkey AS event_id, n_nationkey AS pack FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_name = 'NATION_7' OR n_name = 'NATION_13') DESC, n_name) AS rn FROM nation) WHERE rn = 1""")
def preferred_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The pack an event names, else its first."""
    n = table(spark, sf, "nation")
    return views.shown_first(n, ["n_regionkey"], F.col("n_name").isin("NATION_7", "NATION_13"), [F.asc("n_name")]).select(F.col("n_regionkey").alias("event_id"), F.col("n_nationkey").alias("pack"))


@query(f"""WITH {HITS} SELECT evidence_id, rule_code, CASE rule_code WHEN 'algo-crash' THEN 'Crash reported on the Auburn approach' WHEN 'algo-incident' THEN 'Incident reported on the Auburn approach'
  WHEN 'tomtom-corridor-degraded' THEN ' running at ' || CAST(floor(CASE WHEN k % 10 = 0 THEN 0 ELSE cents END / 10000 * 100 + 0.5) AS BIGINT) || '% of free flow' WHEN 'nws-alert-active' THEN ' in effect for the operating area'
  WHEN 'usgs-stream-rapid-rise' THEN 'Stream stage rising fast at ' ELSE 'M earthquake in the region' END AS title FROM fired""")
def match_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("rule_code") == "usgs-earthquake-felt", F.regexp_replace(views.titles(F.col("rule_code"), F.col("attributes")), "M [0-9.]+ ", "M ")).otherwise(views.titles(F.col("rule_code"), F.col("attributes")))
    return _hits(spark, sf).select("evidence_id", "rule_code", title.alias("title"))


#: What this engine's playbooks say where their author left a field out.
DEFAULTS = {"recommendedAction": "Look at the cited record and decide by name.", "expectedEffect": "The agencies named here take note; only the decision is recorded.", "limitations": "Rests on the cited records alone."}


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Look at the cited record and decide by name.' ELSE p_brand END AS "recommendedAction", 'The agencies named here take note; only the decision is recorded.' AS "expectedEffect",
  CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Rests on the cited records alone.' END AS limitations, CASE WHEN p_size % 4 = 1 THEN 2 ELSE 0 END AS approvals, 0 AS commitments FROM part""")
def playbook_defaults(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    json = F.concat(
        F.lit('{"recommendedAction":'), F.when(size % 3 == 0, "null").otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"'))), F.when(size % 2 == 0, F.concat(F.lit(',"limitations":"'), "p_type", F.lit('"'))).otherwise(""),
        F.lit(',"approvals":'), F.when(size % 4 == 1, '["a",{"b":1}]').when(size % 4 == 2, '"none"').otherwise("null"), F.lit("}"),
    )
    return table(spark, sf, "part").select("p_partkey", F.parse_json(json).alias("v")).select("p_partkey", *views.playbook(F.col("v"), DEFAULTS))


WHY = ["Holds the emergency-access lane", "a CORRIDOR check", "Spillback onto Main. Then more", "Queue at the gate", "  Shuttle loop runs late! Ask the lot", "One very long clause that goes on well beyond the room of a card", "", "."]


@query("""SELECT o_orderkey, CASE o_custkey % 8 WHEN 0 THEN 'Emergency access at risk' WHEN 1 THEN 'Emergency access at risk' WHEN 2 THEN 'Approach is backing up' WHEN 3 THEN 'Approach is backing up'
  WHEN 4 THEN 'Shuttle loop runs late' WHEN 5 THEN 'One very long clause that goes on well…' WHEN 6 THEN '' ELSE '.' END AS alert FROM orders""")
def queue_alerts(spark: SparkSession, sf: str) -> DataFrame:
    why = F.get(F.array(*[F.lit(w) for w in WHY]), (F.col("o_custkey") % 8).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", queue_alert(why).alias("alert"))


@query("""WITH c AS (SELECT c_custkey, ['connected', 'permission_required', 'configuration_required', 'not_connected', 'partly_open'][1 + c_custkey % 5] AS code FROM customer)
SELECT c_custkey, CASE code WHEN 'connected' THEN 'Connected' WHEN 'permission_required' THEN 'Needs a partner agreement' WHEN 'configuration_required' THEN 'Not set up yet' WHEN 'not_connected' THEN 'Not connected' ELSE 'partly open' END AS label FROM c""")
def status_labels(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in [*CONNECTION_LABELS, "partly_open"]])
    return table(spark, sf, "customer").select("c_custkey", labelled(F.get(codes, (F.col("c_custkey") % 5).cast("int")), CONNECTION_LABELS).alias("label"))


@query(f"""WITH t AS (SELECT event_id, ts, CAST(greatest(0, floor(date_diff('microsecond', TIMESTAMP '2024-01-15', ts) / 1e6 / 60 + 0.5)) AS BIGINT) AS m, CAST(greatest(0, floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_TEXT}') / 1e6 + 0.5)) AS BIGINT) AS lag FROM events)
SELECT event_id, strftime(ts, '%H:%M') AS hhmm, strftime(ts, '%H:%M:%SZ') AS hhmmss, CASE WHEN m < 1 THEN 'due now' WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN m // 60 || 'h' ELSE m // 60 || 'h ' || m % 60 || 'm' END AS remaining,
  CASE WHEN lag < 60 THEN lag || 's' WHEN lag < 3600 THEN CAST(floor(lag / 60 + 0.5) AS BIGINT) || 'm' ELSE CAST(floor(lag / 3600 + 0.5) AS BIGINT) || 'h' END AS lag FROM t""")
def time_labels(spark: SparkSession, sf: str) -> DataFrame:
    from mobilis.functions.time import lag_seconds

    ts = F.col("ts")
    left = minutes_left(ts, F.lit("2024-01-15").cast("timestamp_ntz"))
    return table(spark, sf, "events").select("event_id", clock(ts).alias("hhmm"), clock(ts, True).alias("hhmmss"), remaining_label(left).alias("remaining"), lag_label(lag_seconds(ts, as_of())).alias("lag"))


@query("""WITH n AS (SELECT unnest([50, 100, 200, 250, 500, 1000, 2000]) AS n), p AS (SELECT p_partkey, p_retailprice FROM part),
r AS (SELECT p_partkey, n, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(n - p_retailprice), n) AS rn FROM p CROSS JOIN n)
SELECT p_partkey, CASE WHEN n >= 1000 THEN n // 1000 || ' km' ELSE n || ' m' END AS scale FROM r WHERE rn = 1""")
def map_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", nearest_nice(F.col("p_retailprice")).alias("scale"))


NAMES = ["City closures", "Auburn closure map", "ALDOT ALGO", "algo signs", "NWS alerts", "Weather grid", "TomTom flow", "USGS gauges", "Shuttle"]


@query("""WITH f AS (SELECT user_id, ['coa', 'coa', 'aldot', 'aldot', 'nws', 'nws', 'tomtom', 'usgs', NULL][1 + CAST(props->>'$.k' AS BIGINT) % 9] AS owner, CAST(props->>'$.k' AS BIGINT) % 9 AS place FROM events),
o AS (SELECT user_id, owner, min(place) AS place FROM f WHERE owner IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rn FROM o)
SELECT u.user_id, coalesce(string_agg(owner, ' · ' ORDER BY place), 'feeds') AS owners FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON r.user_id = u.user_id AND rn <= 3 GROUP BY u.user_id""")
def feed_owner_tokens(spark: SparkSession, sf: str) -> DataFrame:
    place = (F.get_json_object("props", "$.k").cast("long") % 9).cast("int")
    places = F.array_sort(F.collect_set(place))
    names = F.transform(places, lambda p: F.get(F.array(*[F.lit(n) for n in NAMES]), p))
    return table(spark, sf, "events").groupBy("user_id").agg(feed_owners(names).alias("owners"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || coalesce(text, '')), 'tomtom') OR contains(lower(source || ' ' || coalesce(text, '')), 'ingthe') OR contains(lower(source || ' ' || coalesce(text, '')), 'the the')""")
def source_is_live(spark: SparkSession, sf: str) -> DataFrame:
    hay = F.concat_ws(" ", "source", F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").where(named_in(hay, "TomTom", ["ingthe", "the the"])).select("doc_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 = l_suppkey % 3 AS v, l_returnflag = 'N' AS s, l_linestatus = 'O' AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT v THEN 'version' WHEN NOT s THEN 'state' WHEN NOT h THEN 'evidence' END AS conflict FROM r""")
def snapshot_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    c = views.snapshot_conflict(F.col("l_partkey") % 3, F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_suppkey") % 3, F.lit("N"), F.lit("O"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c.alias("conflict"))


@query("""WITH n AS (SELECT s_nationkey AS node, count(*) AS value FROM supplier GROUP BY 1) SELECT coalesce(min((20 + node % 7) * 0.78 / value), 3.0) AS scale FROM n""")
def sankey_scale(spark: SparkSession, sf: str) -> DataFrame:
    flows = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("value"))
    return views.flow_scale(flows, 20 + F.col("node") % 7)


@query(f"WITH {EV}, r AS (SELECT connector_code, evidence_id, row_number() OVER (PARTITION BY connector_code ORDER BY observed_at, evidence_id) AS rn FROM ev) SELECT connector_code, evidence_id FROM r WHERE rn <= 2")
def smoke_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The first two observations of each connector."""
    return views.first_per(evidence(spark, sf), "connector_code", [F.asc("observed_at"), F.asc("evidence_id")]).select("connector_code", "evidence_id")


@query(f"WITH {EV} SELECT source_event_id, observed_at, connector_code || '#' || (row_number() OVER (PARTITION BY connector_code ORDER BY observed_at, evidence_id) - 1) AS evidence_id FROM ev")
def dry_run_ids(spark: SparkSession, sf: str) -> DataFrame:
    return views.dry_run(evidence(spark, sf), [F.asc("observed_at"), F.asc("evidence_id")]).select("source_event_id", "observed_at", "evidence_id")


@query(f"""SELECT count(*) FILTER (event_type <> 'error' AND value >= 10) AS n_live, count(*) FILTER (event_type = 'error' OR value < 10) AS n_degraded, CAST(greatest(0, count(*) - (SELECT count(*) FROM orders)) AS BIGINT) AS n_uncited,
  count(*) FILTER (ts + INTERVAL 6 HOUR <= TIMESTAMP '{AS_OF_TEXT}') AS n_expired FROM events""")
def rail_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Live and degraded feeds, observations that nothing cites, and recommendations past their six hours."""
    feeds = table(spark, sf, "events").select("ts", F.when(F.col("event_type") == "error", "not_connected").alias("connection"), F.when(F.col("value") >= 10, "healthy").otherwise("delayed").alias("health"))
    cited = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_cited"))
    return records.rail(feeds, records.is_live(F.col("connection"), F.col("health")), cited, F.col("ts") + F.expr("INTERVAL 6 HOURS"), as_of())


@query("""SELECT l_orderkey, l_linenumber, l_partkey, n_name AS agency_name, s_name AS assignee FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 20 = 7 JOIN nation ON n_nationkey = l_partkey % 25 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 <> 0""")
def commitments_of_event(spark: SparkSession, sf: str) -> DataFrame:
    """The commitments of one event with agency and assignee."""
    l = table(spark, sf, "lineitem")
    commitments = l.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("incident_id"), (F.col("l_partkey") % 25).alias("agency_id"), F.col("l_suppkey").alias("assignee_id"))
    incidents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("incident_id"), (F.col("o_custkey") % 20).alias("event_id"))
    principals = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("principal_id"), F.col("s_name").alias("display_name"))
    found = records.commitments_of_event(commitments, incidents, _agencies(spark, sf), principals, F.lit(7))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "agency_name", "assignee")


@query("""WITH b AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN 'c' || event_id END AS metadata, ts, event_id FROM events), n AS (SELECT user_id, arg_max(metadata, (ts, event_id)) AS metadata, arg_max(ts, (ts, event_id)) AS updated FROM b WHERE metadata IS NOT NULL GROUP BY 1),
o AS (SELECT c_custkey AS user_id, 'old' || c_custkey AS metadata, TIMESTAMP '2023-12-31' AS updated FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(n.user_id, o.user_id) AS source_id, coalesce(n.metadata, o.metadata) AS metadata, coalesce(n.updated, o.updated) AS updated_at FROM o FULL JOIN n ON n.user_id = o.user_id""")
def checkpoint_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Where each source goes on, after the batches of a month."""
    e, c = table(spark, sf, "events"), table(spark, sf, "customer").where("c_custkey % 2 = 0")
    batches = e.select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "error", F.concat(F.lit("c"), "event_id")).alias("metadata"), F.col("ts").alias("updated_at"), "event_id")
    old = c.select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("old"), "c_custkey").alias("metadata"), F.lit("2023-12-31").cast("timestamp_ntz").alias("updated_at"))
    return records.checkpointed(old, batches, ["updated_at", "event_id"])


@query("""SELECT 'fresh_feeds' AS measure, CAST(count(*) FILTER (value >= 20) AS DOUBLE) / count(*) AS share FROM events UNION ALL SELECT 'open_corridors', CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) / count(*) FROM orders
UNION ALL SELECT 'resolved_exceptions', CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) FROM lineitem WHERE l_returnflag = 'R'""")
def service_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The share of fresh feeds, open corridors and resolved exceptions."""
    e, o, l = (table(spark, sf, t) for t in ("events", "orders", "lineitem"))
    return records.service_measures(e.select((F.col("value") >= 20).alias("fresh")), o.select((F.col("o_orderstatus") == "O").alias("open")), l.where("l_returnflag = 'R'").select((F.col("l_linestatus") == "F").alias("resolved")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderdate DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey AS event_id, o_orderkey AS incident_id FROM r WHERE rn = 1""")
def active_incident(spark: SparkSession, sf: str) -> DataFrame:
    """The first open incident of each event, else its first one."""
    o = table(spark, sf, "orders")
    found = views.shown_first(o, ["o_custkey"], F.col("o_orderstatus") == "O", [F.desc("o_orderdate"), F.asc("o_orderkey")])
    return found.select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("incident_id"))
