"""Queries of the writes: upserts, links, health, logs and what followers read of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators import lifecycle, sinks
from mobilis.plans.common import catalogue, table

Q, SQL, query = catalogue()


@query("""WITH old AS (SELECT c_custkey AS id, c_name AS label, 'healthy' AS health, c_nationkey AS owner FROM customer WHERE c_custkey % 3 <> 1),
new AS (SELECT c_custkey AS id, upper(c_name) AS label, 'unknown' AS health, c_nationkey + 1 AS owner FROM customer WHERE c_custkey % 4 <> 2)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.label ELSE o.label END AS label, CASE WHEN o.id IS NOT NULL THEN o.health ELSE n.health END AS health, CASE WHEN n.id IS NOT NULL THEN n.owner ELSE o.owner END AS owner
FROM old o FULL JOIN new n ON o.id = n.id""")
def source_registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions replace what is stored; health is not among what they set."""
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("healthy").alias("health"), F.col("c_nationkey").alias("owner"))
    new = c.where("c_custkey % 4 <> 2").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("label"), F.lit("unknown").alias("health"), (F.col("c_nationkey") + 1).alias("owner"))
    return sinks.replaced(old, new, ["id"], keep=["health"])


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus = 'F' AS failed, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS seen FROM orders),
w AS (SELECT *, max(CASE WHEN NOT failed THEN (o_orderdate, o_orderkey) END) OVER (PARTITION BY o_custkey) AS ok FROM r),
b AS (SELECT o_custkey, max(ok) AS ok, count(*) FILTER (failed AND (ok IS NULL OR (o_orderdate, o_orderkey) > ok)) AS since, arg_max(seen, (o_orderdate, o_orderkey)) FILTER (seen IS NOT NULL) AS seen, arg_max(failed, (o_orderdate, o_orderkey)) AS failed FROM w GROUP BY 1)
SELECT c_custkey AS source_code, CASE WHEN ok IS NULL THEN NULL ELSE struct_extract_at(ok, 1) END AS last_success_at, coalesce(seen, -1.0) AS last_observed_at,
  CASE WHEN o_custkey IS NULL THEN 2 WHEN ok IS NULL THEN 2 + since ELSE since END AS failures, CASE WHEN o_custkey IS NULL THEN 'idle' WHEN failed THEN 'failed' ELSE 'succeeded' END AS status
FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def run_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Sources after their runs: last success, what was seen last, and failures in a row."""
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_code"), F.lit(None).cast("timestamp_ntz").alias("last_success_at"), F.lit(-1.0).alias("last_observed_at"), F.lit(2).cast("long").alias("failures"), F.lit("idle").alias("status"))
    runs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source_code"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("observed_at")
    )
    return sinks.run_health(sources, runs)


@query("""WITH old AS (SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS evidence_id FROM lineitem WHERE l_linenumber = 1), new AS (SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS evidence_id FROM lineitem WHERE l_returnflag = 'R')
SELECT incident_id, evidence_id, 'old' AS origin FROM old UNION ALL SELECT n.incident_id, n.evidence_id, 'new' FROM new n ANTI JOIN old o ON o.incident_id = n.incident_id AND o.evidence_id = n.evidence_id""")
def incident_link_insert(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("evidence_id"), "l_linenumber", "l_returnflag")
    links = ["incident_id", "evidence_id"]
    old = l.where("l_linenumber = 1").select(*links, F.lit("old").alias("origin")).distinct()
    return sinks.added(old, l.where("l_returnflag = 'R'").select(*links, F.lit("new").alias("origin")), links)


@query("""WITH e AS (SELECT DISTINCT o_orderkey AS evidence_id, o_custkey % 10 AS event_id FROM orders)
SELECT l_partkey AS subject_id, l_orderkey AS evidence_id, l_suppkey % 10 AS event_id, count(*) AS n FROM lineitem SEMI JOIN e ON e.evidence_id = l_orderkey AND e.event_id = l_suppkey % 10 GROUP BY ALL""")
def evidence_links_of_event(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.col("l_orderkey").alias("evidence_id"), (F.col("l_suppkey") % 10).alias("event_id"))
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), (F.col("o_custkey") % 10).alias("event_id"))
    return sinks.links_of_event(links, known).groupBy("subject_id", "evidence_id", "event_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey % 500 AS incident_id, l_returnflag AS desk_code, l_linestatus AS evidence_hash, max(l_partkey) AS finding FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
g AS (SELECT l_orderkey % 600 AS incident_id, l_returnflag AS desk_code, l_linestatus AS evidence_hash, max(l_suppkey) AS finding FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)
SELECT coalesce(g.incident_id, f.incident_id) AS incident_id, coalesce(g.desk_code, f.desk_code) AS desk_code, coalesce(g.evidence_hash, f.evidence_hash) AS evidence_hash, coalesce(g.finding, f.finding) AS finding
FROM f FULL JOIN g ON f.incident_id = g.incident_id AND f.desk_code = g.desk_code AND f.evidence_hash = g.evidence_hash""")
def finding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A finding per incident, desk and evidence hash; a later one replaces it."""
    key = ["incident_id", "desk_code", "evidence_hash"]
    l = table(spark, sf, "lineitem")

    def findings(rows: DataFrame, of: int, value: str) -> DataFrame:
        named = rows.select((F.col("l_orderkey") % of).alias("incident_id"), F.col("l_returnflag").alias("desk_code"), F.col("l_linestatus").alias("evidence_hash"), value)
        return named.groupBy(*key).agg(F.max(value).alias("finding"))

    return sinks.replaced(findings(l.where("l_linenumber <= 3"), 500, "l_partkey"), findings(l.where("l_linenumber > 3"), 600, "l_suppkey"), key)


@query("""WITH old AS (SELECT DISTINCT l_orderkey AS recommendation_id, l_partkey AS evidence_id FROM lineitem WHERE l_linenumber <= 2), new AS (SELECT DISTINCT l_orderkey AS recommendation_id, l_partkey AS evidence_id FROM lineitem WHERE l_linenumber >= 2 AND l_orderkey % 3 <> 0)
SELECT recommendation_id, evidence_id, 'old' AS origin FROM old WHERE recommendation_id NOT IN (SELECT recommendation_id FROM new)
UNION ALL SELECT n.recommendation_id, n.evidence_id, CASE WHEN o.evidence_id IS NULL THEN 'new' ELSE 'old' END FROM new n LEFT JOIN old o ON o.recommendation_id = n.recommendation_id AND o.evidence_id = n.evidence_id""")
def recommendation_evidence_sync(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recommendation_id"), F.col("l_partkey").alias("evidence_id"), "l_linenumber")
    key = ["recommendation_id", "evidence_id"]
    old = l.where("l_linenumber <= 2").select(*key, F.lit("old").alias("origin")).distinct()
    return sinks.synced(old, l.where("l_linenumber >= 2 AND recommendation_id % 3 <> 0").select(*key, F.lit("new").alias("origin")), "recommendation_id", key)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def orphan_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    parents = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.without_orphans(rows, parents, ["l_orderkey"])[1]


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("command_id"), (F.col("user_id") % 5).alias("event_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("subject_id"), F.lit("incident").alias("subject_type"), F.col("ts").alias("at"), (F.col("value") >= 10).alias("applied")
    )


OUTBOX = """outbox AS (SELECT user_id % 5 AS event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) + 100 AS sequence, 'incident.' || event_type AS topic, CAST(user_id AS VARCHAR) AS subject_id, ts AS at FROM events WHERE value >= 10)"""


@query(f"WITH {OUTBOX} SELECT event_id, sequence, topic, subject_id FROM outbox")
def outbox_append(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.recorded(_commands(spark, sf), 100)[1].select("event_id", "sequence", "topic", "subject_id")


@query("SELECT event_id AS command_id, user_id AS actor, event_type AS action FROM events WHERE value >= 10")
def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.recorded(_commands(spark, sf))[0].select("command_id", "actor", "action")


CURSORS = [("a", 0, 100), ("b", 0, 140), ("c", 3, 100), ("d", 4, 1_000_000)]


@query(f"""WITH {OUTBOX}, c(follower, event_id, after) AS (VALUES ('a', 0, 100), ('b', 0, 140), ('c', 3, 100), ('d', 4, 1000000)),
r AS (SELECT follower, sequence, topic, row_number() OVER (PARTITION BY follower ORDER BY sequence) AS rn FROM outbox JOIN c USING (event_id) WHERE sequence > after) SELECT follower, sequence, topic FROM r WHERE rn <= 200""")
def outbox_poll(spark: SparkSession, sf: str) -> DataFrame:
    cursors = spark.createDataFrame(CURSORS, "follower string, event_id long, after long")
    return sinks.polled(sinks.recorded(_commands(spark, sf), 100)[1], cursors).select("follower", "sequence", "topic")


STATES = ["requested", "acknowledged", "approved", "executing", "blocked", "verified", "failed", "expired", "cancelled"]


@query("""WITH s AS (SELECT ['requested', 'acknowledged', 'approved', 'executing', 'blocked', 'verified', 'failed', 'expired', 'cancelled'] AS names),
m AS (SELECT o_orderkey AS commitment_id, names[1 + o_orderkey % 9] AS from_state, names[1 + o_custkey % 9] AS to_state, o_orderdate AS moved_at FROM orders, s WHERE o_custkey % 4 <> 0)
SELECT commitment_id, from_state, to_state, moved_at FROM m WHERE (from_state = 'requested' AND to_state IN ('acknowledged', 'cancelled', 'expired')) OR (from_state = 'acknowledged' AND to_state IN ('approved', 'blocked', 'cancelled', 'expired'))
  OR (from_state = 'approved' AND to_state IN ('executing', 'blocked', 'cancelled', 'expired')) OR (from_state = 'executing' AND to_state IN ('verified', 'blocked', 'failed')) OR (from_state = 'blocked' AND to_state IN ('acknowledged', 'approved', 'executing', 'failed', 'cancelled'))""")
def commitment_transition_log(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STATES])
    o = table(spark, sf, "orders")
    held = o.select(F.col("o_orderkey").alias("commitment_id"), F.get(names, (F.col("o_orderkey") % 9).cast("int")).alias("state"), F.lit(1).cast("long").alias("version"))
    moves = o.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("commitment_id"), F.get(names, (F.col("o_custkey") % 9).cast("int")).alias("to_state"), F.col("o_orderdate").alias("at"))
    return sinks.transitioned(held, moves, lifecycle.commitment_moves(spark))[1]


@query("""WITH d AS (SELECT event_id AS decision_id, user_id AS recommendation_id, event_type AS agency, ts FROM events WHERE value >= 50),
a AS (SELECT recommendation_id, agency, arg_min(decision_id, (ts, decision_id)) AS satisfied_by FROM d GROUP BY ALL), q AS (SELECT DISTINCT user_id AS recommendation_id, event_type AS agency FROM events)
SELECT q.recommendation_id, q.agency AS agency_code, satisfied_by, CASE WHEN satisfied_by IS NULL THEN 'pending' ELSE 'satisfied' END AS status FROM q LEFT JOIN a USING (recommendation_id, agency)""")
def requirement_satisfied(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    needs = e.select(F.col("user_id").alias("recommendation_id"), F.col("event_type").alias("agency_code")).distinct()
    done = e.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("recommendation_id"), F.col("event_type").alias("agency_code"), F.when(F.col("value") >= 50, "approve").otherwise("reject").alias("action"), F.col("ts").alias("decided_at"))
    return sinks.decided_log(needs, done)


@query("""WITH r AS (SELECT user_id AS mode, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT mode, request_id, CASE WHEN rn = 1 AND mode % 3 <> 1 THEN 'opened' ELSE 'conflict' END AS outcome FROM r""")
def window_open(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "events").select(F.col("user_id").alias("mode"), F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"))
    held = requests.select("mode", (F.col("mode") % 3 == 1).alias("active")).distinct()
    return sinks.windows_opened(held, requests).select("mode", "request_id", "outcome")


@query("""WITH i AS (SELECT user_id AS batch_id, CASE WHEN event_type = 'view' THEN 'node' ELSE 'edge' END AS kind FROM events)
SELECT batch_id, kind, n, n <= CASE kind WHEN 'node' THEN 5 ELSE 20 END AS accepted FROM (SELECT batch_id, kind, count(*) AS n FROM i GROUP BY batch_id, kind)""")
def batch_caps(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "events").select(F.col("user_id").alias("batch_id"), F.when(F.col("event_type") == "view", "node").otherwise("edge").alias("kind"))
    return sinks.faults_of_batch(items, {"node": 5, "edge": 20})
