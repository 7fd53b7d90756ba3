"""Queries over incidents, recommendations, decisions, commitments, desks and read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.functions.text import first_clause, listed, queue_rank, short_hash
from mobilis.operators import desks, lifecycle, views
from mobilis.operators import evidence as ev_ops
from mobilis.plans.common import EV, catalogue, evidence, table

Q, SQL, query = catalogue()


def severity(priority):
    """Order priorities are the five severities."""
    return F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").when(priority == "3-MEDIUM", "medium").when(priority == "5-LOW", "low").otherwise("informational")


SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'informational' END"


@query(f"""WITH q AS (SELECT o_orderkey, {SEVERITY} AS severity, o_orderdate FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, severity FROM q ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, o_orderdate DESC, o_orderkey LIMIT 250""")
def severity_queue_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "orders").where("o_orderstatus <> 'F'").withColumn("severity", severity(F.col("o_orderpriority")))
    return q.orderBy(queue_rank(F.col("severity")), F.desc("o_orderdate"), "o_orderkey").limit(250).select("o_orderkey", "severity")


@query(f"""WITH r AS (SELECT o_orderkey AS recommendation_id, o_custkey AS incident_id, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'awaiting_approval' ELSE 'delegated' END AS state, {SEVERITY} AS severity FROM orders)
SELECT recommendation_id, incident_id, state, severity FROM r JOIN customer ON c_custkey = incident_id WHERE state <> 'draft'
AND recommendation_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 5 = 3 AND l_returnflag = 'A')""")
def queue_requires_approval(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("delegated")
    recs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recommendation_id"), F.col("o_custkey").alias("incident_id"), state.alias("state"), severity(F.col("o_orderpriority")).alias("severity"))
    incidents = table(spark, sf, "customer").select(F.col("c_custkey").alias("incident_id"))
    needs = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("recommendation_id"), (F.col("l_suppkey") % 5).cast("string").alias("agency_code"))
    return lifecycle.queue(recs, incidents, needs, "3").select("recommendation_id", "incident_id", "state", "severity")


def _incidents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidents of the first days, matches of the last; one connector is not seen."""
    ev = evidence(spark, sf).withColumnRenamed("source_event_id", "external_key")
    old = ev_ops.latest_per(ev.where("observed_at < timestamp_ntz'2024-01-06'"), ["connector_code", "external_key"], [F.desc("observed_at"), F.desc("evidence_id")])
    status = F.when(F.col("k") % 5 == 0, "resolved").when(F.col("k") % 5 == 1, "closed").when(F.col("k") % 5 == 2, "new").otherwise("active")
    incidents = old.select("connector_code", "external_key", status.alias("status"), (F.col("k") % 3 + 1).alias("version"))
    late = ev.where("observed_at >= timestamp_ntz'2024-01-29' AND connector_code <> 'view'")
    return incidents, late.where("cents > 2000").select("connector_code", "external_key"), late


STEP = f"""{EV}, old AS (SELECT *, row_number() OVER (PARTITION BY connector_code, source_event_id ORDER BY observed_at DESC, evidence_id DESC) AS rn FROM ev WHERE observed_at < TIMESTAMP '2024-01-06'),
incidents AS (SELECT connector_code, source_event_id AS external_key, CASE k % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' WHEN 2 THEN 'new' ELSE 'active' END AS status, k % 3 + 1 AS version FROM old WHERE rn = 1),
late AS (SELECT * FROM ev WHERE observed_at >= TIMESTAMP '2024-01-29' AND connector_code <> 'view'),
matched AS (SELECT DISTINCT connector_code, source_event_id AS external_key FROM late WHERE cents > 2000)"""


@query(f"""WITH {STEP}, met AS (
  SELECT coalesce(i.connector_code, m.connector_code) AS connector_code, coalesce(i.external_key, m.external_key) AS external_key, i.status, coalesce(i.version, 0) AS version, m.external_key IS NOT NULL AS hit
  FROM incidents i FULL JOIN matched m ON i.connector_code = m.connector_code AND i.external_key = m.external_key),
c AS (SELECT *, CASE WHEN status IS NULL THEN 'opened' WHEN status = 'closed' THEN 'untouched' WHEN hit AND status = 'resolved' THEN 'reopened' WHEN hit THEN 'confirmed'
  WHEN status IN ('new', 'triaged', 'active', 'monitoring') AND connector_code IN (SELECT connector_code FROM late) THEN 'resolved' ELSE 'untouched' END AS change FROM met)
SELECT connector_code, external_key, CASE WHEN change IN ('opened', 'reopened') THEN 'active' WHEN change = 'resolved' THEN 'resolved' ELSE status END AS status,
  version + CASE WHEN change <> 'untouched' THEN 1 ELSE 0 END AS version, change FROM c""")
def incident_lifecycle_batch(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.incident_step(*_incidents(spark, sf))


@query(f"""WITH {STEP} SELECT connector_code, external_key FROM incidents i WHERE status IN ('new', 'triaged', 'active', 'monitoring') AND connector_code IN (SELECT connector_code FROM late)
AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.connector_code = i.connector_code AND m.external_key = i.external_key)""")
def incident_resolve_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.cleared(*_incidents(spark, sf)).select("connector_code", "external_key")


@query("""WITH r AS (SELECT o_custkey AS incident_id, o_orderkey, o_orderdate, CAST(CAST(floor(o_totalprice) AS BIGINT) % 3 AS VARCHAR) AS evidence_hash, o_orderstatus = 'F' AS decided FROM orders),
s AS (SELECT *, row_number() OVER w AS n, lag(evidence_hash) OVER w AS before, lag(decided) OVER w AS was FROM r WINDOW w AS (PARTITION BY incident_id ORDER BY o_orderdate, o_orderkey)),
p AS (SELECT *, CASE WHEN n = 1 THEN 'insert' WHEN before = evidence_hash THEN 'keep' WHEN was THEN 'supersede' ELSE 'rewrite' END AS plan FROM s)
SELECT incident_id, o_orderkey, plan, CAST(sum(CASE WHEN plan IN ('insert', 'supersede') THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version FROM p""")
def recommendation_supersede(spark: SparkSession, sf: str) -> DataFrame:
    recs = table(spark, sf, "orders").select(F.col("o_custkey").alias("incident_id"), "o_orderkey", "o_orderdate", (F.floor("o_totalprice") % 3).cast("string").alias("evidence_hash"), (F.col("o_orderstatus") == "F").alias("decided"))
    return lifecycle.supersede(recs, ["o_orderdate", "o_orderkey"]).select("incident_id", "o_orderkey", "plan", "version")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text)) > 1 AS historical FROM conversations")
def decision_latest_historical(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.latest_flagged(table(spark, sf, "conversations"), ["conv_id", "role"], [F.desc("turn"), F.length("text").asc()]).select("conv_id", "turn", "role", "historical")


STATES = ["requested", "acknowledged", "approved", "executing", "blocked", "verified", "failed", "expired", "cancelled"]


@query("""WITH s AS (SELECT ['requested', 'acknowledged', 'approved', 'executing', 'blocked', 'verified', 'failed', 'expired', 'cancelled'] AS names),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, names[1 + l_partkey % 9] AS from_state, names[1 + l_suppkey % 9] AS to_state FROM lineitem, s),
a(from_state, to_state) AS (VALUES ('requested', 'acknowledged'), ('requested', 'cancelled'), ('requested', 'expired'), ('acknowledged', 'approved'), ('acknowledged', 'blocked'), ('acknowledged', 'cancelled'), ('acknowledged', 'expired'),
  ('approved', 'executing'), ('approved', 'blocked'), ('approved', 'cancelled'), ('approved', 'expired'), ('executing', 'verified'), ('executing', 'blocked'), ('executing', 'failed'),
  ('blocked', 'acknowledged'), ('blocked', 'approved'), ('blocked', 'executing'), ('blocked', 'failed'), ('blocked', 'cancelled'))
SELECT m.from_state, m.to_state, a.from_state IS NOT NULL AS allowed, count(*) AS n FROM m LEFT JOIN a ON a.from_state = m.from_state AND a.to_state = m.to_state GROUP BY ALL""")
def commitment_transition_check(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STATES])
    moves = table(spark, sf, "lineitem").select(F.get(names, (F.col("l_partkey") % 9).cast("int")).alias("from_state"), F.get(names, (F.col("l_suppkey") % 9).cast("int")).alias("to_state"))
    return lifecycle.checked_moves(moves, lifecycle.commitment_moves(spark)).groupBy("from_state", "to_state", "allowed").agg(F.count(F.lit(1)).alias("n"))


ACTIONS = ["acknowledge", "approve", "reject", "request_revision", "delegate", "escalate", "withdraw"]
REC_STATES = ["awaiting_acknowledgement", "awaiting_approval", "delegated", "escalated", "approved", "rejected"]


@query("""WITH n AS (SELECT ['acknowledge', 'approve', 'reject', 'request_revision', 'delegate', 'escalate', 'withdraw'] AS acts, ['awaiting_acknowledgement', 'awaiting_approval', 'delegated', 'escalated', 'approved', 'rejected'] AS states),
d AS (SELECT o_orderkey AS recommendation_id, acts[1 + o_custkey % 7] AS action, states[1 + o_orderkey % 6] AS state, CAST(floor(o_totalprice) AS BIGINT) % 2 AS n_pending FROM orders, n),
t AS (SELECT *, CASE WHEN action = 'acknowledge' AND state = 'awaiting_acknowledgement' THEN 'awaiting_approval' WHEN action = 'approve' AND state IN ('awaiting_approval', 'delegated') THEN 'approved'
  WHEN action = 'reject' AND state IN ('awaiting_acknowledgement', 'awaiting_approval', 'delegated', 'escalated') THEN 'rejected'
  WHEN action = 'request_revision' AND state IN ('awaiting_acknowledgement', 'awaiting_approval', 'delegated', 'escalated') THEN 'revision_requested'
  WHEN action = 'delegate' AND state = 'awaiting_approval' THEN 'delegated' WHEN action = 'escalate' AND state IN ('awaiting_acknowledgement', 'awaiting_approval', 'delegated') THEN 'escalated'
  WHEN action = 'withdraw' AND state = 'approved' THEN 'superseded' END AS target FROM d)
SELECT recommendation_id, target IS NOT NULL AS valid, CASE WHEN target IS NULL THEN state WHEN target IN ('approved', 'awaiting_approval') AND n_pending > 0 THEN 'awaiting_approval' ELSE target END AS next_state FROM t""")
def recommendation_decisions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    acts, states = (F.array(*[F.lit(x) for x in xs]) for xs in (ACTIONS, REC_STATES))
    recs = o.select(F.col("o_orderkey").alias("recommendation_id"), F.get(states, (F.col("o_orderkey") % 6).cast("int")).alias("state"), (F.floor("o_totalprice") % 2).alias("n_pending"))
    done = o.select(F.col("o_orderkey").alias("recommendation_id"), F.get(acts, (F.col("o_custkey") % 7).cast("int")).alias("action"))
    return lifecycle.decided(recs, done, lifecycle.recommendation_moves(spark)).select("recommendation_id", "valid", "next_state")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, unnest([0, 1, 2]) AS position FROM supplier), c AS (SELECT s_suppkey, position, (s_nationkey + position * 11) % 30 AS agency, 30 * (position + 1) AS due_minutes FROM p)
SELECT 'rule-' || s_suppkey AS rule_code, position, 'NATION_' || agency AS agency_code, TIMESTAMP '2024-01-31' + to_minutes(due_minutes) AS due_at FROM c JOIN nation ON n_nationkey = agency""")
def commitment_plan_explode(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda k: F.struct(F.concat(F.lit("NATION_"), (F.col("s_nationkey") + k * 11) % 30).alias("agency_code"), F.lit(30 * (k + 1)).alias("due_minutes"))
    books = table(spark, sf, "supplier").select(F.concat(F.lit("rule-"), F.col("s_suppkey")).alias("rule_code"), F.array(*[item(k) for k in range(3)]).alias("commitments"))
    agencies = table(spark, sf, "nation").select(F.col("n_name").alias("agency_code"))
    return lifecycle.planned_commitments(books, agencies, F.lit("2024-01-31").cast("timestamp_ntz")).select("rule_code", "position", "agency_code", "due_at")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'expired' ELSE CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'awaiting_approval' END END AS state FROM orders""")
def window_close_cascade(spark: SparkSession, sf: str) -> DataFrame:
    recs = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("incident_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("awaiting_approval").alias("state"))
    incidents = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("incident_id"), F.lit("active").alias("status"))
    return lifecycle.close_window(incidents, recs)[1].select("o_orderkey", "state")


# ---- desks -----------------------------------------------------------------

DESKS = [("d1", "click"), ("d1", "error"), ("d2", "purchase"), ("d3", "signup"), ("d3", "view"), ("d4", "siem")]
DESKS_SQL = "perm(desk_code, connector_code) AS (VALUES ('d1', 'click'), ('d1', 'error'), ('d2', 'purchase'), ('d3', 'signup'), ('d3', 'view'), ('d4', 'siem'))"


def _seen(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    permissions = spark.createDataFrame(DESKS, "desk_code string, connector_code string")
    return desks.visible(evidence(spark, sf), permissions), permissions


@query(f"WITH {EV}, {DESKS_SQL} SELECT desk_code, connector_code, count(*) AS n FROM ev JOIN perm USING (connector_code) GROUP BY ALL")
def desk_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return _seen(spark, sf)[0].groupBy("desk_code", "connector_code").agg(F.count(F.lit(1)).alias("n"))


ASSESSED = f"""{EV}, {DESKS_SQL}, c AS (SELECT desk_code, user_id % 7 AS incident_id, count(*) AS n_seen, count(*) FILTER (k >= 97) AS n_relevant
  FROM (SELECT *, CAST(split_part(source_event_id, ':', 2) AS BIGINT) AS user_id FROM ev) JOIN perm USING (connector_code) GROUP BY ALL),
f AS (SELECT d.desk_code, i.incident_id, coalesce(n_seen, 0) AS n_seen, coalesce(n_relevant, 0) AS n_relevant,
  CASE WHEN coalesce(n_seen, 0) = 0 THEN 'no_feed' WHEN n_relevant = 0 THEN 'abstained' WHEN n_relevant > 12 AND d.desk_code = 'd3' THEN 'dissent' ELSE 'contributed' END AS stance
  FROM (SELECT DISTINCT desk_code FROM perm) d CROSS JOIN (SELECT unnest(range(7)) AS incident_id) i LEFT JOIN c ON c.desk_code = d.desk_code AND c.incident_id = i.incident_id)"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    seen, permissions = _seen(spark, sf)
    user = F.element_at(F.split("source_event_id", ":"), -1).cast("long")
    out = None
    by = seen.withColumn("desk", F.col("desk_code")).withColumn("incident_id", user % 7).withColumn("desk_code", F.concat_ws("/", "desk", "incident_id"))
    each = permissions.select("desk_code").distinct().crossJoin(F.broadcast(spark.range(7).withColumnRenamed("id", "incident_id")))  # four desks by seven incidents
    keys = each.select(F.concat_ws("/", "desk_code", "incident_id").alias("desk_code"), F.col("desk_code").alias("name"), "incident_id")
    conflict = (F.col("n_relevant") > 12) & (F.col("name") == "d3")
    out = desks.assessed(by, F.col("k") >= 97, keys, F.lit(0.6), conflict)
    return out.drop("desk_code").withColumnRenamed("name", "desk_code")


@query(f"WITH {ASSESSED} SELECT incident_id, desk_code, n_seen, n_relevant, stance, CASE WHEN n_relevant > 0 THEN CAST(0.6 AS DOUBLE) END AS confidence FROM f")
def desk_assess_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).select("incident_id", "desk_code", "n_seen", "n_relevant", "stance", "confidence")


@query(f"""WITH {ASSESSED}, g AS (SELECT incident_id, list(desk_code ORDER BY desk_code) FILTER (stance IN ('contributed', 'dissent')) AS spoke,
  string_agg(desk_code, ', ' ORDER BY desk_code) FILTER (stance IN ('abstained', 'no_feed')) AS silent, count(*) FILTER (stance = 'dissent') AS n_conflicts FROM f GROUP BY incident_id)
SELECT incident_id, CASE WHEN spoke IS NULL THEN 'no desk' WHEN len(spoke) = 1 THEN spoke[1] ELSE array_to_string(spoke[:-2], ', ') || ' and ' || spoke[-1] END || ' contributed; silent: ' || coalesce(silent, 'none') AS summary,
  CASE WHEN spoke IS NULL THEN 'abstained' ELSE 'contributed' END AS status, n_conflicts FROM g""")
def desk_composition_text(spark: SparkSession, sf: str) -> DataFrame:
    return desks.composed(_findings(spark, sf))


@query(f"WITH {ASSESSED} SELECT incident_id, count(*) FILTER (stance = 'contributed') AS n_contributed, count(*) FILTER (stance = 'dissent') AS n_dissent, count(*) FILTER (stance = 'abstained') AS n_abstained, count(*) AS n_staffed, CAST(floor(count(*) FILTER (stance = 'contributed') * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM f GROUP BY incident_id")
def stance_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.stance_counts(_findings(spark, sf), ["incident_id"])


@query("""WITH d AS (SELECT l_orderkey AS draft_id, list_sort(list_distinct(list(l_partkey % 40))) AS cited FROM lineitem GROUP BY 1)
SELECT draft_id, concat_ws(',', CASE WHEN len([x FOR x IN cited IF x >= 36]) > 0 THEN 'citation' END, CASE WHEN length('note ' || draft_id) NOT BETWEEN 12 AND 600 THEN 'length' END,
  CASE WHEN (draft_id % 100) / 100 NOT BETWEEN 0.2 AND 0.85 THEN 'confidence' END) AS faults FROM d""")
def citation_validation(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(*[F.lit(k).cast("long") for k in range(36)])
    drafts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("draft_id")).agg(F.collect_set(F.col("l_partkey") % 40).alias("cited"))
    drafts = drafts.withColumns({"allowed": ids, "read": ids, "statement": F.concat(F.lit("note "), F.col("draft_id")), "confidence": F.col("draft_id") % 100 / 100})
    return desks.invalid_citations(drafts).select("draft_id", F.array_join("faults", ",").alias("faults"))


@query("""WITH c AS (SELECT l_suppkey % 50 AS incident_id, l_orderkey % 2000 AS ref FROM lineitem), s AS (SELECT incident_id, list_sort(list_distinct(list(ref)))[:24] AS cited FROM c GROUP BY 1)
SELECT incident_id, array_to_string(cited, ',') AS cited FROM s""")
def cited_union_cap(spark: SparkSession, sf: str) -> DataFrame:
    findings = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("incident_id"), F.col("l_linenumber"), (F.col("l_orderkey") % 2000).alias("ref")).groupBy("incident_id", "l_linenumber").agg(F.collect_set("ref").alias("cited"))
    return desks.cited(findings).select("incident_id", F.array_join("cited", ",").alias("cited"))


# ---- read models -----------------------------------------------------------


@query("""WITH needle AS (SELECT 'the ea' AS q)
SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 277) || '...' ELSE text END AS excerpt FROM documents, needle WHERE contains(lower(source || ' ' || text), q) ORDER BY doc_id LIMIT 8""")
def policy_search(spark: SparkSession, sf: str) -> DataFrame:
    return views.search(table(spark, sf, "documents").select("doc_id", "source", "text"), "the ea", ["source", "text"]).select("doc_id", "excerpt")


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    up = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("weight"))
    low = up.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.lit("all").alias("dst"), "weight")
    mid = up.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("weight").alias("weight"))
    return low.unionByName(mid.select(F.lit("all").alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"), "weight"))


FLOW = """up AS (SELECT s_nationkey, count(*) AS weight FROM supplier GROUP BY 1), flow AS (SELECT 'n' || s_nationkey AS src, 'all' AS dst, weight FROM up
  UNION ALL SELECT 'all', 'r' || n_regionkey, CAST(sum(weight) AS BIGINT) FROM up JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey)"""


@query(f"""WITH {FLOW}, o AS (SELECT src AS node, CAST(sum(greatest(1, weight)) AS BIGINT) AS out_sum FROM flow GROUP BY 1), i AS (SELECT dst AS node, CAST(sum(greatest(1, weight)) AS BIGINT) AS in_sum FROM flow GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(out_sum, 0) AS out_sum, coalesce(in_sum, 0) AS in_sum, greatest(1, coalesce(out_sum, 0), coalesce(in_sum, 0)) AS value FROM o FULL JOIN i ON o.node = i.node""")
def sankey_flow(spark: SparkSession, sf: str) -> DataFrame:
    return views.flow_nodes(_flow(spark, sf))


@query(f"WITH {FLOW} SELECT src, dst, weight, CAST(coalesce(sum(weight) OVER (PARTITION BY dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ribbon_offset FROM flow")
def ribbon_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return views.ribbon_offsets(_flow(spark, sf), "dst", ["src"], "weight")


@query("""SELECT o_orderkey, o_orderpriority, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, coalesce(first_part, -1) AS first_part
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS first_part FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def update_from_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    agg = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("first_part"))
    met = table(spark, sf, "orders").join(agg, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select("o_orderkey", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("first_part", F.lit(-1)).alias("first_part"))


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority, owner.s_name AS owner, requester.n_name AS requester, r_name AS area
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier owner ON owner.s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation requester ON requester.n_nationkey = c_nationkey JOIN region ON r_regionkey = requester.n_regionkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def agency_coordination(spark: SparkSession, sf: str) -> DataFrame:
    l, o, s, c, n, r = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer", "nation", "region"))
    met = l.where("l_returnflag = 'R' AND l_linestatus = 'F'").join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    met = met.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    return met.select("l_orderkey", "l_linenumber", "o_orderpriority", F.col("s_name").alias("owner"), F.col("n_name").alias("requester"), F.col("r_name").alias("area"))


@query("""SELECT o_orderkey, o_orderdate, o_orderpriority FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM orders)
ORDER BY o_orderdate NULLS LAST, o_orderpriority, o_orderkey LIMIT 300""")
def due_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate"), "o_orderpriority")
    return o.orderBy(F.asc_nulls_last("o_orderdate"), "o_orderpriority", "o_orderkey").limit(300)


@query("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'Crash on route ' || o_orderkey WHEN 1 THEN 'word word word word word word word word word word word word word word word word…' ELSE '' END AS clause,
  CASE WHEN o_custkey % 2 = 0 THEN substr(sha256('h' || o_orderkey), 1, 4) || '…' || right(sha256('h' || o_orderkey), 3) ELSE 'abc' END AS hash, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and ' || o_orderkey ELSE 'a, b and ' || o_orderkey END AS names FROM orders""")
def text_labels(spark: SparkSession, sf: str) -> DataFrame:
    """First clauses, short hashes and lists of names."""
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(c % 3 == 0, F.concat(F.lit("Crash on route "), key, F.lit("; left lane shut"))).when(c % 3 == 1, F.repeat(F.lit("word "), F.lit(30)))
    h = F.when(c % 2 == 0, F.sha2(F.concat(F.lit("h"), key), 256)).otherwise("abc")
    names = F.when(key % 3 == 0, F.array(F.lit("a"))).when(key % 3 == 1, F.array(F.lit("a"), key.cast("string"))).otherwise(F.array(F.lit("a"), F.lit("b"), key.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", first_clause(text).alias("clause"), short_hash(h).alias("hash"), listed(names).alias("names"))
