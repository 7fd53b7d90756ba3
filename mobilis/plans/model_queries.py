"""Queries behind the screens: feeds, badges, stages, counters and pilot measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators import records, views
from mobilis.plans.common import AS_OF_TEXT, EV, SOURCES_SQL, as_of, catalogue, evidence, sources, table

Q, SQL, query = catalogue()


@query(f"""WITH {EV}, {SOURCES_SQL}, approval(connector_code, needs_approval, default_status) AS (VALUES ('click', false, 'connected'), ('error', false, 'connected'), ('purchase', true, 'permission_required'), ('signup', false, 'configuration_required'), ('siem', true, 'permission_required')),
n AS (SELECT connector_code, count(*) AS n FROM ev GROUP BY 1)
SELECT s.connector_code, CASE WHEN NOT configured AND needs_approval THEN 'permission_required' WHEN NOT configured THEN 'configuration_required' WHEN default_status = 'configuration_required' THEN 'connected' ELSE default_status END AS status, coalesce(n, 0) AS n
FROM src s JOIN approval a ON a.connector_code = s.connector_code LEFT JOIN n ON n.connector_code = s.connector_code""")
def connector_statuses(spark: SparkSession, sf: str) -> DataFrame:
    approval = spark.createDataFrame([("click", False, "connected"), ("error", False, "connected"), ("purchase", True, "permission_required"), ("signup", False, "configuration_required"), ("siem", True, "permission_required")], "connector_code string, needs_approval boolean, default_status string")
    n = evidence(spark, sf).groupBy("connector_code").agg(F.count(F.lit(1)).alias("n"))
    met = sources(spark).join(approval, "connector_code").join(n, "connector_code", "left")
    return met.select("connector_code", views.connection_status("configured", "needs_approval", "default_status").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {EV} SELECT evidence_id, connector_code, source_event_id FROM ev
WHERE connector_code LIKE 'p%' AND observed_at > TIMESTAMP '2024-01-15' ORDER BY observed_at, evidence_id LIMIT 200""")
def evidence_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence(spark, sf).where(F.col("connector_code").like("p%") & (F.col("observed_at") > F.lit("2024-01-15").cast("timestamp_ntz")))
    return rows.orderBy("observed_at", "evidence_id").limit(200).select("evidence_id", "connector_code", "source_event_id")


@query(f"""WITH {EV}, m AS (SELECT *, date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF_TEXT}') / 1e6 > 1200000 AS stale FROM ev)
SELECT evidence_id, connector_code FROM m WHERE NOT stale AND connector_code <> 'view' ORDER BY observed_at DESC, evidence_id LIMIT 80""")
def map_observations(spark: SparkSession, sf: str) -> DataFrame:
    age = F.timestamp_diff("MICROSECOND", F.col("observed_at"), as_of()) / 1e6
    return evidence(spark, sf).where((age <= 1_200_000) & (F.col("connector_code") != "view")).orderBy(F.desc("observed_at"), "evidence_id").limit(80).select("evidence_id", "connector_code")


@query(f"""WITH {EV} SELECT count(*) FILTER (connector_code = 'click') AS n_closures, count(*) FILTER (connector_code = 'view') AS n_transit, count(*) FILTER (observed_at > TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 6 HOUR) AS n_live FROM ev""")
def observation_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("connector_code")
    live = F.col("observed_at") > as_of() - F.expr("INTERVAL 6 HOURS")
    return evidence(spark, sf).agg(F.count_if(kind == "click").alias("n_closures"), F.count_if(kind == "view").alias("n_transit"), F.count_if(live).alias("n_live"))


@query("""WITH t AS (SELECT p_partkey, [w FOR w IN string_split(lower(p_type), ' ')] AS words FROM part),
c AS (SELECT p_partkey, [CASE WHEN w LIKE '%steel%' OR w LIKE '%tin%' THEN 'traffic' WHEN w LIKE '%brass%' THEN 'transit' WHEN w LIKE '%copper%' OR w LIKE '%nickel%' THEN 'safety' ELSE 'service' END FOR w IN words] AS kinds FROM t)
SELECT p_partkey, array_to_string([k FOR k, i IN kinds IF list_position(kinds, k) = i][:3], ',') AS badges FROM c""")
def queue_badges(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of services from key words: each once, in order, three at most."""
    words = {"traffic": ["steel", "tin"], "transit": ["brass"], "safety": ["copper", "nickel"]}
    services = F.split(F.lower("p_type"), " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(views.badges(services, words, "service"), ",").alias("badges"))


@query("""WITH s AS (SELECT ['requested', 'acknowledged', 'approved', 'executing', 'verified', 'blocked', 'failed', 'expired', 'cancelled'] AS names),
m AS (SELECT l_orderkey, l_linenumber, names[1 + l_partkey % 9] AS state FROM lineitem, s)
SELECT l_orderkey, l_linenumber, state, CASE state WHEN 'requested' THEN 'asked' WHEN 'acknowledged' THEN 'asked,seen' WHEN 'approved' THEN 'asked,seen,accepted' WHEN 'executing' THEN 'asked,seen,accepted,in progress' WHEN 'verified' THEN 'asked,seen,accepted,in progress,done' ELSE 'asked' END AS stages FROM m""")
def commitment_stages(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("requested", "acknowledged", "approved", "executing", "verified", "blocked", "failed", "expired", "cancelled")])
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(names, (F.col("l_partkey") % 9).cast("int")).alias("state"))
    return rows.withColumn("stages", F.array_join(views.stages_done("state"), ","))


@query("""SELECT s_nationkey, any_value(n_name) AS owner, count(*) AS n_received, count(*) FILTER (l_linestatus = 'O') AS n_executing, count(*) FILTER (l_returnflag = 'R') AS n_blocked
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey""")
def agency_counters(spark: SparkSession, sf: str) -> DataFrame:
    l, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    # counted by supplier first: what is joined and grouped again is one row a supplier
    by_owner = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    met = by_owner.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"))
    return met.groupBy("s_nationkey").agg(F.first("n_name").alias("owner"), F.sum("n").alias("n_received"), F.sum("o").alias("n_executing"), F.sum("r").alias("n_blocked"))


@query("""WITH d AS (SELECT l_orderkey, min(l_shipdate) AS first_at, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS seen FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS n_incidents, count(d.first_at) AS n_decided, avg(date_diff('microsecond', o_orderdate, first_at) / 1e6 / 60) AS mean_minutes_to_decision, CAST(sum(seen) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS acknowledged_share
FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY 1""")
def pilot_measures(spark: SparkSession, sf: str) -> DataFrame:
    incidents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderdate").alias("detected_at"), "o_orderpriority")
    decisions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_shipdate").alias("decided_at"), (F.col("l_returnflag") != "N").alias("acknowledged"))
    return records.pilot_measures(incidents, decisions, "o_orderpriority")
