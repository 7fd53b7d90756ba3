"""Queries of the desks: what each makes of a snapshot, its findings, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators import desks
from mobilis.plans.common import EV, catalogue, evidence, table

Q, SQL, query = catalogue()

FEEDS = {"click": "aldot-algo-traffic-v1", "error": "tomtom-traffic-flow-v1", "purchase": "nws-weather-alerts-v1", "signup": "usgs-natural-hazards-v1", "view": "coa-road-closures-v1"}
MATCHES = [
    (1, "atlas", ["keep the emergency corridor open"], "Post a traveler message"),
    (2, "sentinel", ["none"], "Stage crews"),
    (3, "forge", ["Emergency Corridor"], "Inspect the crossing"),
    (4, "echo", [], "Inform drivers"),
    (5, None, ["shuttle lanes"], None),
]


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Events as evidence of the real feeds, with attributes as these write them."""
    ev = evidence(spark, sf)
    k, cents, c = F.col("k"), F.col("cents"), F.col("connector_code")
    level = F.when(k % 3 == 0, "Heavy").when(k % 3 == 1, "Unaffected").otherwise("")
    traffic = (
        F.when(k % 4 == 0, F.lit('{"layer":"traffic_event"}'))
        .when(k % 4 == 1, F.concat(F.lit('{"layer":"travel_time","congestionLevel":"'), level, F.lit('"}')))
        .when(k % 4 == 2, F.concat(F.lit('{"layer":"message_sign","pages":["  ",'), F.when(k % 8 == 2, '"Slow"').otherwise("null"), F.lit("]}")))
        .otherwise('{"layer":"travel_time"}')
    )
    json = (
        F.when(c == "click", traffic)
        .when(c == "error", F.concat(F.lit('{"currentSpeedMph":'), cents, F.lit(',"freeFlowSpeedMph":'), F.when(k % 10 == 0, "0").otherwise('"10000"'), F.lit("}")))
        .when(c == "purchase", F.when(k % 2 == 0, F.lit('{"layer":"weather_alert"}')).otherwise(F.concat(F.lit('{"layer":"hourly_forecast","thunderstormHours":'), k % 5, F.lit("}"))))
        .when(c == "signup", F.concat(F.lit('{"layer":"stream_gauge","riseFt":'), cents - 5000, F.lit("}")))
        .otherwise(F.concat(F.lit('{"kind":"'), F.when(k % 3 == 0, "closure").otherwise(""), F.lit('"}')))
    )
    feed = F.create_map(*[F.lit(x) for pair in FEEDS.items() for x in pair])
    return ev.select("evidence_id", "observed_at", F.element_at(feed, c).alias("connector_code"), F.parse_json(json).alias("attributes"))


PARTS = f"""{EV}, seen AS (
  SELECT 'atlas' AS desk_code, connector_code = 'click' AND k % 4 = 0 AS p1, connector_code = 'click' AND k % 4 = 1 AND k % 3 = 0 AS p2,
         connector_code = 'error' AND k % 10 <> 0 AND cents / 10000 < 0.6 AS p3, false AS shown, evidence_id, observed_at FROM ev WHERE connector_code IN ('click', 'error')
  UNION ALL SELECT 'sentinel', k % 2 = 0, k % 2 = 1 AND k % 5 > 0, false, false, evidence_id, observed_at FROM ev WHERE connector_code = 'purchase'
  UNION ALL SELECT 'phoenix', k % 3 = 0, false, false, false, evidence_id, observed_at FROM ev WHERE connector_code = 'view'
  UNION ALL SELECT 'forge', connector_code = 'view' AND k % 3 = 0, connector_code = 'signup' AND cents > 5000, false, false, evidence_id, observed_at FROM ev WHERE connector_code IN ('view', 'signup')
  UNION ALL SELECT 'echo', k % 4 = 2, false, false, k % 8 = 2, evidence_id, observed_at FROM ev WHERE connector_code = 'click'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY desk_code ORDER BY CASE WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END, observed_at DESC, evidence_id) AS rn FROM seen WHERE p1 OR p2 OR p3),
quoted AS (SELECT desk_code, string_agg(evidence_id, ',' ORDER BY rn) AS cited FROM ranked WHERE rn <= 12 GROUP BY 1),
counted AS (SELECT desk_code, count(*) AS n_seen, count(*) FILTER (p1) AS n1, count(*) FILTER (p2) AS n2, count(*) FILTER (p3) AS n3, count(*) FILTER (shown) AS n_shown FROM seen GROUP BY 1),
picture AS (SELECT d.desk_code, coalesce(n_seen, 0) AS n_seen, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(n_shown, 0) AS n_shown, coalesce(cited, '') AS cited
  FROM (VALUES ('atlas'), ('sentinel'), ('phoenix'), ('forge'), ('aqua'), ('echo')) d(desk_code) LEFT JOIN counted USING (desk_code) LEFT JOIN quoted USING (desk_code))"""
MATCHES_SQL = "m(match_id, agent_code, corridor, message) AS (VALUES (1, 'atlas', true, true), (2, 'sentinel', false, false), (3, 'forge', true, false), (4, 'echo', false, true), (5, NULL, false, false))"
FOUND = f"""{PARTS}, {MATCHES_SQL}, met AS (SELECT *, desk_code IS DISTINCT FROM agent_code AS other FROM m CROSS JOIN picture),
judged AS (SELECT match_id, desk_code, n_seen, cited, n1 + n2 + n3 > 0 AND (desk_code <> 'phoenix' OR corridor) AS speaks,
  CASE WHEN desk_code = 'sentinel' AND other AND n1 > 0 THEN 'weather' WHEN desk_code = 'phoenix' THEN 'corridor' WHEN desk_code = 'forge' AND other AND n2 > 0 THEN 'water' WHEN desk_code = 'echo' AND n_shown > 0 AND message THEN 'message' END AS concern,
  CAST(CASE desk_code WHEN 'atlas' THEN CASE WHEN n2 + n3 > 0 THEN 0.68 ELSE 0.5 END WHEN 'sentinel' THEN CASE WHEN n1 > 0 THEN 0.7 ELSE 0.45 END WHEN 'phoenix' THEN 0.3 WHEN 'forge' THEN 0.6 WHEN 'aqua' THEN 0.35 ELSE 0.55 END AS DOUBLE) AS confidence FROM met)"""


def _picture(spark: SparkSession, sf: str) -> DataFrame:
    return desks.pictures(_snapshot(spark, sf))


@query(f"WITH {PARTS} SELECT desk_code, n_seen, n1 + n2 + n3 AS n_parts, cited FROM picture")
def desk_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """What bears on each desk's domain, and the rows it would cite."""
    said = [p for p in ("events", "congested", "degraded", "alerts", "thunder", "restrictions", "rising", "vehicles", "signs", "security")]
    total = sum((F.coalesce(F.element_at("n", p), F.lit(0)) for p in said), F.lit(0).cast("long"))
    return _picture(spark, sf).select("desk_code", "n_seen", total.alias("n_parts"), F.array_join("cited", ",").alias("cited"))


@query(f"""WITH {FOUND} SELECT match_id, desk_code, CASE WHEN n_seen = 0 THEN 'no_feed' WHEN NOT speaks THEN 'abstained' WHEN concern IS NOT NULL THEN 'dissent' ELSE 'contributed' END AS stance,
  CASE WHEN speaks THEN confidence END AS confidence, CASE WHEN speaks THEN concern END AS concern, CASE WHEN speaks THEN cited ELSE '' END AS cited FROM judged""")
def desk_findings(spark: SparkSession, sf: str) -> DataFrame:
    matches = spark.createDataFrame(MATCHES, "match_id int, agent_code string, constraints array<string>, recommended_action string")
    found = desks.findings_on(_picture(spark, sf), matches, list(FEEDS.values()))
    return found.select("match_id", "desk_code", "stance", "confidence", "concern", F.array_join("cited", ",").alias("cited"))


@query(f"""WITH {FOUND} SELECT s.desk_code, CASE WHEN NOT s.staffed THEN 'not staffed' WHEN n_seen > 0 AND speaks THEN CASE WHEN concern IS NULL THEN 'contributed' ELSE 'dissent' END ELSE 'abstained' END AS status
FROM (VALUES ('atlas', true), ('sentinel', true), ('phoenix', true), ('forge', false), ('aqua', true), ('echo', true), ('composer', false)) s(desk_code, staffed) LEFT JOIN judged j ON j.desk_code = s.desk_code AND match_id = 1""")
def desk_roster(spark: SparkSession, sf: str) -> DataFrame:
    matches = spark.createDataFrame(MATCHES[:1], "match_id int, agent_code string, constraints array<string>, recommended_action string")
    staffed = [("atlas", True), ("sentinel", True), ("phoenix", True), ("forge", False), ("aqua", True), ("echo", True), ("composer", False)]
    return desks.roster(spark.createDataFrame(staffed, "desk_code string, staffed boolean"), desks.findings_on(_picture(spark, sf), matches, list(FEEDS.values())))


@query(f"WITH {EV} SELECT evidence_id FROM ev WHERE connector_code IN ('click', 'error') ORDER BY observed_at DESC, evidence_id LIMIT 24")
def desk_cards(spark: SparkSession, sf: str) -> DataFrame:
    return desks.cards(_snapshot(spark, sf), "atlas").select("evidence_id")


@query("""WITH d AS (SELECT o_orderkey AS draft_id, o_orderpriority || ' note on ' || o_orderstatus AS statement, CASE o_orderstatus WHEN 'F' THEN 'hold' WHEN 'O' THEN 'send' END AS action FROM orders)
SELECT draft_id, concat_ws(',', CASE WHEN regexp_matches(statement, 'urgent|on p', 'i') THEN 'wording' END, CASE WHEN action IS NULL OR action <> 'hold' THEN 'action' END) AS faults FROM d""")
def draft_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts whose wording is forbidden or whose action is not among the known ones."""
    none = F.array().cast("array<long>")
    status = F.col("o_orderstatus")
    drafts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("draft_id"), F.concat(F.col("o_orderpriority"), F.lit(" note on "), status).alias("statement"), F.when(status == "F", "hold").when(status == "O", "send").alias("action"),
        none.alias("cited"), none.alias("allowed"), none.alias("read"), F.lit(0.5).alias("confidence"),
    )
    return desks.invalid_citations(drafts, forbidden=["urgent", "on p"], actions=["hold"]).select("draft_id", F.array_join("faults", ",").alias("faults"))


#: The feeds that partners grant: transit, parking, access and security reach their desks.
GRANTED = {"click": desks.TRANSIT, "error": desks.PARKING, "purchase": desks.ACCESS, "signup": desks.SECURITY, "view": "coa-road-closures-v1"}


@query(f"""WITH {EV}, seen AS (
  SELECT 'aqua' AS desk_code, connector_code = 'click' AS bears, evidence_id, observed_at FROM ev WHERE connector_code IN ('click', 'error')
  UNION ALL SELECT 'sentinel', false, evidence_id, observed_at FROM ev WHERE connector_code = 'purchase'
  UNION ALL SELECT 'phoenix', connector_code = 'view' AND k % 3 = 0, evidence_id, observed_at FROM ev WHERE connector_code IN ('purchase', 'view')
  UNION ALL SELECT 'forge', k % 3 = 0, evidence_id, observed_at FROM ev WHERE connector_code = 'view'
  UNION ALL SELECT 'echo', true, evidence_id, observed_at FROM ev WHERE connector_code = 'signup'),
r AS (SELECT *, row_number() OVER (PARTITION BY desk_code ORDER BY observed_at DESC, evidence_id) AS rn FROM seen WHERE bears),
c AS (SELECT desk_code, string_agg(evidence_id, ',' ORDER BY rn) AS cited FROM r WHERE rn <= 12 GROUP BY 1),
n AS (SELECT desk_code, count(*) AS n_seen, count(*) FILTER (bears) AS n FROM seen GROUP BY 1), {MATCHES_SQL},
j AS (SELECT match_id, d.desk_code, coalesce(n_seen, 0) AS n_seen, coalesce(n, 0) > 0 AND (d.desk_code <> 'phoenix' OR corridor) AS speaks, coalesce(cited, '') AS cited
  FROM m CROSS JOIN (VALUES ('atlas'), ('sentinel'), ('phoenix'), ('forge'), ('aqua'), ('echo')) d(desk_code) LEFT JOIN n USING (desk_code) LEFT JOIN c USING (desk_code))
SELECT match_id, desk_code, CASE WHEN n_seen = 0 THEN 'no_feed' WHEN NOT speaks THEN 'abstained' ELSE 'contributed' END AS stance,
  CASE WHEN speaks THEN CAST(CASE desk_code WHEN 'phoenix' THEN 0.62 WHEN 'forge' THEN 0.6 WHEN 'aqua' THEN 0.6 ELSE 0.55 END AS DOUBLE) END AS confidence, CASE WHEN speaks THEN cited ELSE '' END AS cited FROM j""")
def desk_findings_with_partners(spark: SparkSession, sf: str) -> DataFrame:
    """Findings where the feeds of partners report: transit, parking, access and security."""
    k, c = F.col("k"), F.col("connector_code")
    feed = F.create_map(*[F.lit(x) for pair in GRANTED.items() for x in pair])
    json = F.when((c == "view") & (k % 3 == 0), '{"kind":"closure"}').when(c == "signup", '{"severity":"high"}').otherwise("{}")
    snapshot = evidence(spark, sf).select("evidence_id", "observed_at", F.element_at(feed, c).alias("connector_code"), F.parse_json(json).alias("attributes"))
    matches = spark.createDataFrame(MATCHES, "match_id int, agent_code string, constraints array<string>, recommended_action string")
    found = desks.findings_on(desks.pictures(snapshot), matches, list(GRANTED.values()))
    return found.select("match_id", "desk_code", "stance", "confidence", F.array_join("cited", ",").alias("cited"))
