"""Queries over the temporal graph: snapshots, walks, changes, lineage and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators import chains, graph, ingest
from mobilis.plans.common import AS_OF_TEXT, EDGES, EV, NODES, as_of, catalogue, evidence, geography, table
from mobilis.sources.folders import new_folder

Q, SQL, query = catalogue()


def _number(col: str):
    return F.element_at(F.split(col, ":"), -1).cast("long")


def _timed(edges: DataFrame) -> DataFrame:
    """Edges with a validity that follows from the number of their lower end."""
    n = _number("src")
    start = F.lit("2024-01-12").cast("timestamp_ntz") + F.make_dt_interval(days=(n % 15).cast("int"))
    until = F.when(n % 9 == 4, start + F.expr("INTERVAL 10 DAYS"))
    return edges.select(F.concat_ws(">", "src", "dst").alias("edge_id"), F.lit("part_of").alias("edge_type"), "src", "dst", start.alias("valid_from"), until.alias("valid_until"), (n % 13 != 6).alias("active"))


TIMED = """timed AS (SELECT src || '>' || dst AS edge_id, src, dst, TIMESTAMP '2024-01-12' + to_days(CAST(n % 15 AS INTEGER)) AS valid_from,
  CASE WHEN n % 9 = 4 THEN TIMESTAMP '2024-01-12' + to_days(CAST(n % 15 AS INTEGER)) + INTERVAL 10 DAY END AS valid_until, n % 13 <> 6 AS active
  FROM (SELECT *, CAST(split_part(src, ':', 2) AS BIGINT) AS n FROM edges))"""
LIVE = """live AS (SELECT * FROM nodes WHERE active AND valid_from <= TIMESTAMP '2024-01-25' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-25')),
among AS (SELECT t.* FROM timed t SEMI JOIN live a ON t.src = a.node_id SEMI JOIN live b ON t.dst = b.node_id
  WHERE t.active AND t.valid_from <= TIMESTAMP '2024-01-25' AND (t.valid_until IS NULL OR t.valid_until > TIMESTAMP '2024-01-25'))"""


def _snapshot(spark: SparkSession, sf: str, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    nodes, edges = geography(spark, sf)
    return graph.snapshot(nodes, _timed(edges), F.lit("2024-01-25").cast("timestamp_ntz"), types)


@query(f"WITH {NODES}, {EDGES}, {TIMED}, {LIVE} SELECT 'node' AS kind, node_id AS id FROM live UNION ALL SELECT 'edge', edge_id FROM among")
def graph_snapshot_asof(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _snapshot(spark, sf)
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


@query(f"""WITH {NODES}, {EDGES}, {TIMED}, {LIVE}, few AS (SELECT * FROM live WHERE node_type IN ('nation', 'region'))
SELECT 'node' AS kind, node_id AS id FROM few UNION ALL SELECT 'edge', edge_id FROM among WHERE src IN (SELECT node_id FROM few) AND dst IN (SELECT node_id FROM few)""")
def graph_coordination_view(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot restricted to some types of nodes, and the edges that stay among them."""
    nodes, edges = _snapshot(spark, sf, ["nation", "region"])
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


def _start(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'nation:3' AS node_id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node_id WHERE depth < 3)
SELECT node_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node_id""")
def graph_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighborhood(geography(spark, sf)[1], _start(spark, "nation:3"), 3)


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, walk AS (
  SELECT 'supplier:' || s_suppkey AS node_id, CAST(0 AS BIGINT) AS depth, ['supplier:' || s_suppkey] AS path FROM supplier
  UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM walk JOIN edges ON src = node_id WHERE depth < 6 AND NOT list_contains(path, dst))
SELECT w.node_id, depth, array_to_string(path, '>') AS path, label FROM walk w JOIN nodes n ON n.node_id = w.node_id WHERE depth > 0""")
def graph_impact_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = geography(spark, sf)
    start = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node_id"))
    return graph.impact(edges, start).join(nodes.select("node_id", "label"), "node_id").select("node_id", "depth", F.array_join("path", ">").alias("path"), "label")


@query(f"""WITH RECURSIVE {EDGES}, down AS (SELECT 'nation:3' AS node_id UNION SELECT dst FROM down JOIN edges ON src = node_id),
up AS (SELECT 'nation:3' AS node_id UNION SELECT src FROM up JOIN edges ON dst = node_id)
SELECT node_id, 'down' AS direction FROM down WHERE node_id <> 'nation:3' UNION ALL SELECT node_id, 'up' FROM up WHERE node_id <> 'nation:3'""")
def graph_closure_up_down(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(geography(spark, sf)[1], _start(spark, "nation:3"))


@query(f"WITH {EDGES} SELECT dst AS node_id FROM edges WHERE src = 'nation:3' UNION SELECT src FROM edges WHERE dst = 'nation:3'")
def graph_related_ids(spark: SparkSession, sf: str) -> DataFrame:
    step = graph.both_ways(geography(spark, sf)[1])
    return step.where("src = 'nation:3'").select(F.col("dst").alias("node_id")).distinct()


@query(f"""WITH {EDGES}, ends AS (SELECT src AS node_id, 1 AS up, 0 AS down FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
SELECT node_id, CAST(sum(up) AS BIGINT) AS n_up, CAST(sum(down) AS BIGINT) AS n_down FROM ends GROUP BY node_id""")
def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(geography(spark, sf)[1])


@query(f"""WITH {NODES} SELECT node_type, count(*) AS n, count(*) FILTER (valid_until <= TIMESTAMP '{AS_OF_TEXT}') AS n_over, count(*) FILTER (NOT active) AS n_inactive FROM nodes GROUP BY node_type""")
def graph_type_rollup(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = geography(spark, sf)
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_until") <= as_of()).alias("n_over"), F.count_if(~F.col("active")).alias("n_inactive"))


@query("""SELECT 'supplier:' || s_suppkey AS node_id, l_orderkey, l_linenumber, o_orderdate, c_name AS run
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0""")
def graph_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence behind nodes, its source and, where known, the run that brought it."""
    nodes = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("supplier:"), "s_suppkey").alias("node_id"))
    links = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    found = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    runs = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey", F.col("c_name").alias("run"))
    met = links.join(nodes, F.col("l_suppkey") == F.col("s_suppkey")).join(found, F.col("o_orderkey") == F.col("l_orderkey")).join(runs, F.col("o_custkey") == F.col("c_custkey"), "left")
    return met.select("node_id", "l_orderkey", "l_linenumber", "o_orderdate", "run")


VERSIONS = f"""{EV}, v AS (SELECT source_event_id AS entity, evidence_id, observed_at, k % 3 AS state, cents % 2 AS geometry, k % 7 <> 0 AS active FROM ev),
l AS (SELECT *, row_number() OVER w AS rn, lag(state) OVER w AS previous_state, lag(geometry) OVER w AS g, lag(active) OVER w AS a FROM v WINDOW w AS (PARTITION BY entity ORDER BY observed_at, evidence_id)),
c AS (SELECT *, CASE WHEN rn = 1 THEN 'created' WHEN a AND NOT active THEN 'deactivated' WHEN NOT a AND active THEN 'reactivated' WHEN g <> geometry THEN 'geometry_updated' WHEN previous_state <> state THEN 'state_updated' END AS change_type FROM l)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    k, cents = F.col("k"), F.col("cents")
    versions = evidence(spark, sf).select(F.col("source_event_id").alias("entity"), "evidence_id", "observed_at", (k % 3).alias("state"), (cents % 2).alias("geometry"), (k % 7 != 0).alias("active"))
    return graph.change_log(versions, "entity", ["observed_at", "evidence_id"])


@query(f"""WITH {VERSIONS} SELECT entity, evidence_id, change_type, row_number() OVER (PARTITION BY entity ORDER BY observed_at, evidence_id) AS version FROM c WHERE change_type IS NOT NULL""")
def graph_change_type(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("entity", "evidence_id", "change_type", F.col("version").cast("long").alias("version"))


@query(f"""WITH {VERSIONS} SELECT entity, evidence_id, change_type, previous_state, state FROM c WHERE change_type IS NOT NULL AND starts_with(entity, 'error:') ORDER BY observed_at DESC, evidence_id LIMIT 500""")
def graph_state_history(spark: SparkSession, sf: str) -> DataFrame:
    """The newest changes of one kind of entity with the state before and after; a page of at most 500."""
    log = _changes(spark, sf).where(F.col("entity").startswith("error:"))
    return log.orderBy(F.desc("observed_at"), "evidence_id").limit(500).select("entity", "evidence_id", "change_type", "previous_state", "state")


@query(f"""WITH {NODES}, {EDGES}, {TIMED}, h AS (SELECT *, CAST(split_part(node_id, ':', 2) AS BIGINT) AS n FROM nodes), t AS (SELECT *, CAST(split_part(src, ':', 2) AS BIGINT) AS n FROM timed)
SELECT 'node' AS kind, node_id AS id, label FROM h WHERE valid_until <= TIMESTAMP '{AS_OF_TEXT}' OR n % 17 = 2 OR n % 19 = 3
UNION ALL SELECT 'edge', edge_id, src FROM t WHERE valid_until <= TIMESTAMP '{AS_OF_TEXT}' OR n % 17 = 2 OR n % 19 = 3""")
def graph_stale_union(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = geography(spark, sf)

    def flagged(df: DataFrame, col: str) -> DataFrame:
        n = _number(col)
        flags = F.when(n % 17 == 2, F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>"))
        return df.withColumn("quality_flags", flags).withColumn("health", F.when(n % 19 == 3, "delayed").otherwise("healthy"))

    return graph.stale(flagged(nodes, "node_id"), flagged(_timed(edges), "src").withColumn("label", F.col("src")), as_of())


@query(f"""WITH {NODES}, extra AS (SELECT 'supplier:' || s_suppkey AS src, 'nation:' || (s_nationkey + s_suppkey % 4) AS dst FROM supplier UNION ALL SELECT 'supplier:' || (s_suppkey + 5), 'nation:1' FROM supplier WHERE s_suppkey % 3 = 0),
ok AS (SELECT node_id FROM nodes WHERE active)
SELECT src, dst, CASE WHEN src NOT IN (SELECT node_id FROM ok) THEN 'unknown_source' ELSE 'unknown_target' END AS reason FROM extra WHERE src NOT IN (SELECT node_id FROM ok) OR dst NOT IN (SELECT node_id FROM ok)""")
def edge_endpoint_reject(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = geography(spark, sf)
    s = table(spark, sf, "supplier")
    edges = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.concat(F.lit("nation:"), F.col("s_nationkey") + F.col("s_suppkey") % 4).alias("dst"))
    more = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey") + 5).alias("src"), F.lit("nation:1").alias("dst"))
    return graph.split_edges(edges.unionByName(more), nodes)[1].select("src", "dst", "reason")


@query("""WITH old AS (SELECT c_custkey AS id, c_nationkey AS state, c_mktsegment AS label, c_custkey % 5 <> 0 AS active FROM customer WHERE c_custkey % 4 <> 1),
new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS state, upper(c_name) AS label, c_custkey % 5 <> 0 OR c_custkey % 2 = 0 AS active FROM customer WHERE c_custkey % 7 <> 2)
SELECT CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'untouched' WHEN o.state = n.state AND o.active = n.active THEN 'unchanged' ELSE 'updated' END AS change,
  count(*) AS n, CAST(sum(CASE WHEN o.id IS NULL THEN 1 WHEN n.id IS NULL OR (o.state = n.state AND o.active = n.active) THEN 1 ELSE 2 END) AS BIGINT) AS versions FROM old o FULL JOIN new n ON o.id = n.id GROUP BY 1""")
def graph_node_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of nodes on stored ones: a change of label alone is no change."""
    c = table(spark, sf, "customer")
    node_id, none = F.concat(F.lit("customer:"), "c_custkey").alias("node_id"), F.lit(None).cast("string")

    def nodes(df: DataFrame, state, label, active) -> DataFrame:
        return df.select(node_id, state.cast("string").alias("state"), none.alias("geometry"), F.array().cast("array<string>").alias("quality_flags"), active.alias("active"), none.cast("timestamp_ntz").alias("valid_until"), label.alias("label"))

    key, on = F.col("c_custkey"), F.col("c_custkey") % 5 != 0
    old = nodes(c.where("c_custkey % 4 <> 1"), F.col("c_nationkey"), F.col("c_mktsegment"), on).withColumn("version", F.lit(1).cast("long"))
    new = nodes(c.where("c_custkey % 7 <> 2"), F.when(key % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), F.upper("c_name"), on | (key % 2 == 0))
    merged = graph.merged(old, new, "node_id")
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@query("""WITH b AS (SELECT event_id AS batch_id, user_id AS idempotency_key, event_type AS body_hash, ts FROM events), f AS (SELECT *, first_value(body_hash) OVER w AS kept, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY idempotency_key ORDER BY ts, batch_id))
SELECT batch_id, CASE WHEN rn = 1 THEN 'applied' WHEN kept = body_hash THEN 'replayed' ELSE 'conflict' END AS outcome FROM f""")
def graph_batch_ledger(spark: SparkSession, sf: str) -> DataFrame:
    batches = table(spark, sf, "events").select(F.col("event_id").alias("batch_id"), F.col("user_id").alias("idempotency_key"), F.col("event_type").alias("body_hash"), "ts")
    return graph.ledger(batches, ["ts", "batch_id"]).select("batch_id", "outcome")


@query("""WITH d AS (SELECT DISTINCT n_regionkey, n_name FROM nation)
SELECT r_name AS label, CAST(to_json(list_sort(list(struct_pack(node := n_name, kind := 'nation')) FILTER (n_name IS NOT NULL))) AS VARCHAR) AS members FROM region LEFT JOIN d ON n_regionkey = r_regionkey GROUP BY r_name""")
def graph_members_json(spark: SparkSession, sf: str) -> DataFrame:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    met = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    member = F.when(F.col("n_name").isNotNull(), F.struct(F.col("n_name").alias("node"), F.lit("nation").alias("kind")))
    return met.groupBy(F.col("r_name").alias("label")).agg(F.to_json(F.array_sort(F.collect_set(member))).alias("members"))


# ---- lineage ----------------------------------------------------------------


_DOCUMENTS = """r AS (SELECT o_orderkey AS recommendation_id, o_custkey AS incident_id, o_orderpriority AS priority, o_orderstatus AS state, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1 END AS superseded_by FROM orders),
i AS (SELECT c_custkey AS incident_id, c_name AS title, c_mktsegment AS category FROM customer WHERE c_custkey % 9 <> 4),
l AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem),
e AS (SELECT l_orderkey AS recommendation_id, list(struct_pack(evidence_id := l_partkey, line := l_linenumber, mode := CASE WHEN l_returnflag <> 'A' THEN l_returnflag END) ORDER BY l_partkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END NULLS FIRST) AS x FROM l WHERE l_returnflag <> 'N' GROUP BY 1),
d AS (SELECT l_orderkey AS recommendation_id, list(struct_pack(decision_id := l_linenumber, actor := l_suppkey, action := CASE WHEN l_returnflag = 'A' THEN 'approve' ELSE 'request_revision' END, decided_at := day) ORDER BY day, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'approve' ELSE 'request_revision' END) AS x FROM l WHERE l_linenumber IN (2, 3) GROUP BY 1),
c AS (SELECT l_orderkey AS recommendation_id, list(struct_pack(commitment_id := l_linenumber, owner := l_suppkey, state := l_linestatus) ORDER BY l_linenumber, l_suppkey, l_linestatus) AS x FROM l WHERE l_linenumber >= 3 GROUP BY 1),
v AS (SELECT l_orderkey AS recommendation_id, list(struct_pack(commitment_id := l_linenumber, confirmed_at := day) ORDER BY l_linenumber, day) AS x FROM l WHERE l_linenumber >= 3 AND l_tax < 0.02 GROUP BY 1)"""


@query(f"""WITH {_DOCUMENTS}
SELECT recommendation_id, CAST(to_json(struct_pack(
  recommendation := struct_pack(recommendation_id := r.recommendation_id, incident_id := r.incident_id, priority := r.priority, state := r.state, superseded_by := r.superseded_by),
  incident := struct_pack(incident_id := i.incident_id, title := i.title, category := i.category),
  evidence := coalesce(e.x, []), decisions := coalesce(d.x, []), commitments := coalesce(c.x, []), verifications := coalesce(v.x, []))) AS VARCHAR) AS lineage
FROM r JOIN i ON i.incident_id = r.incident_id LEFT JOIN e USING (recommendation_id) LEFT JOIN d USING (recommendation_id) LEFT JOIN c USING (recommendation_id) LEFT JOIN v USING (recommendation_id)""")
def lineage_document(spark: SparkSession, sf: str) -> DataFrame:
    """One document a recommendation, with its incident, evidence, decisions, commitments and their verification."""
    o, c, l = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    recommendations = o.select(F.col("o_orderkey").alias("recommendation_id"), F.col("o_custkey").alias("incident_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1).alias("superseded_by"))
    incidents = c.where("c_custkey % 9 <> 4").select(F.col("c_custkey").alias("incident_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"))
    key, line, day, flag = F.col("l_orderkey").alias("recommendation_id"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_returnflag")
    later = l.where("l_linenumber >= 3")
    return graph.decision_documents(
        recommendations,
        incidents,
        {
            "evidence": (l.where("l_returnflag <> 'N'").select(key, F.col("l_partkey").alias("evidence_id"), line.alias("line"), F.when(flag != "A", flag).alias("mode")), ["evidence_id", "line"]),
            "decisions": (l.where("l_linenumber IN (2, 3)").select(key, line.alias("decision_id"), F.col("l_suppkey").alias("actor"), F.when(flag == "A", "approve").otherwise("request_revision").alias("action"), day.alias("decided_at")), ["decided_at", "decision_id"]),
            "commitments": (later.select(key, line.alias("commitment_id"), F.col("l_suppkey").alias("owner"), F.col("l_linestatus").alias("state")), ["commitment_id"]),
            "verifications": (later.where("l_tax < 0.02").select(key, line.alias("commitment_id"), day.alias("confirmed_at")), ["commitment_id"]),
        },
    )


@query("""WITH e AS (
  SELECT 'supports' AS edge_type, CAST(l_partkey AS VARCHAR) AS src, CAST(l_orderkey AS VARCHAR) AS dst FROM lineitem
  UNION ALL SELECT 'triggered', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'delegate' END, CAST(o_orderkey AS VARCHAR), 'd' || o_orderkey FROM orders
  UNION ALL SELECT 'assigned', CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS VARCHAR) ELSE 'd' || l_orderkey END, l_orderkey || '-' || l_linenumber FROM lineitem),
h AS (SELECT *, sha256('edge:' || edge_type || ':' || src || ':' || dst) AS d FROM e)
SELECT edge_type, src, dst, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) AS edge_id FROM h""")
def lineage_projection_edges(spark: SparkSession, sf: str) -> DataFrame:
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    decision = F.concat(F.lit("d"), F.col("l_orderkey"))
    assigned = l.select(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey").cast("string")).otherwise(decision).alias("a"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("b"))
    outcome = lambda df: df.select("o_orderkey", F.concat(F.lit("d"), F.col("o_orderkey")).alias("decision"))
    return graph.lineage_edges(
        {
            "supports": (l, "l_partkey", "l_orderkey"),
            "triggered": (o, "o_custkey", "o_orderkey"),
            "approved": (outcome(o.where("o_orderstatus = 'F'")), "o_orderkey", "decision"),
            "delegate": (outcome(o.where("o_orderstatus <> 'F'")), "o_orderkey", "decision"),
            "assigned": (assigned, "a", "b"),
        }
    )


LINEAGE = """r AS (SELECT 'r' || o_orderkey AS id, 'i' || o_custkey AS incident, o_orderkey AS rank, o_clerk AS action, state FROM (
    SELECT *, o_orderpriority AS o_clerk, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'awaiting_approval' ELSE 'delegated' END AS state FROM orders)),
i AS (SELECT 'i' || c_custkey AS id, c_name AS title FROM customer WHERE c_acctbal >= 0),
e AS (SELECT DISTINCT 'r' || l_orderkey AS rid, 'e' || (l_partkey % 500) AS eid FROM lineitem WHERE l_returnflag <> 'N'),
f AS (SELECT 'r' || l_orderkey AS rid, l_linestatus || l_linenumber AS desk, CASE WHEN l_quantity > 25 THEN 'contributed' ELSE 'abstained' END AS status, l_shipdate AS happened, ['e' || (l_partkey % 500), 'e' || (l_suppkey % 700)] AS cited FROM lineitem WHERE l_linenumber <= 2),
d AS (SELECT 'd' || l_orderkey || '-' || l_linenumber AS id, 'r' || l_orderkey AS rid, CASE WHEN l_returnflag = 'A' THEN 'approve' ELSE 'request_revision' END AS action, l_linestatus AS actor, l_shipdate AS happened FROM lineitem WHERE l_linenumber IN (2, 3)),
c AS (SELECT 'c' || l_orderkey || '-' || l_linenumber AS id, 'd' || l_orderkey || '-' || (l_linenumber - 1) AS did, 'r' || (l_orderkey + l_linenumber - 4) AS rid, l_returnflag AS outcome, CASE WHEN l_tax < 0.02 THEN 'verified' WHEN l_tax < 0.04 THEN 'expired' ELSE 'requested' END AS state, l_linestatus AS rule FROM lineitem WHERE l_linenumber >= 3),
p AS (SELECT rid, eid, rank, incident, i.id IS NOT NULL AS has FROM e JOIN r ON r.id = rid LEFT JOIN i ON i.id = incident),
o AS (SELECT eid, min(rank) AS first_rank FROM p GROUP BY 1),
h AS (SELECT f.*, rank, incident, i.id IS NOT NULL AS has, sha256('finding:' || incident || ':' || desk || ':' || strftime(happened, '%Y-%m-%d %H:%M:%S')) AS g FROM f JOIN r ON r.id = rid LEFT JOIN i ON i.id = incident),
s AS (SELECT *, substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-' || substr(g, 13, 4) || '-' || substr(g, 17, 4) || '-' || substr(g, 21, 12) AS fid FROM h),
v AS (SELECT id, rule, substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-' || substr(g, 13, 4) || '-' || substr(g, 17, 4) || '-' || substr(g, 21, 12) AS vid FROM (SELECT *, sha256('verification:' || id) AS g FROM c WHERE state = 'verified'))"""


def _lineage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rid, text = F.concat(F.lit("r"), F.col("l_orderkey")), F.concat
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("delegated")
    recommendations = o.select(text(F.lit("r"), "o_orderkey").alias("recommendation_id"), text(F.lit("i"), "o_custkey").alias("incident_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("action"), status.alias("state"))
    incidents = c.where("c_acctbal >= 0").select(text(F.lit("i"), "c_custkey").alias("incident_id"), F.col("c_name").alias("title"))
    place = F.struct("_metadata.file_name", "_metadata.row_index").alias("place")
    part, supplier = (text(F.lit("e"), F.col(k) % n) for k, n in (("l_partkey", 500), ("l_suppkey", 700)))
    evidence = l.where("l_returnflag <> 'N'").select(rid.alias("recommendation_id"), part.alias("evidence_id"), part.alias("summary")).distinct()
    findings = l.where("l_linenumber <= 2").select(
        rid.alias("recommendation_id"), text("l_linestatus", "l_linenumber").alias("desk_code"), F.when(F.col("l_quantity") > 25, "contributed").otherwise("abstained").alias("status"), F.col("l_shipdate").alias("created_at"), F.array(part, supplier).alias("cited"), place
    )
    decisions = l.where("l_linenumber IN (2, 3)").select(
        text(F.lit("d"), "l_orderkey", F.lit("-"), "l_linenumber").alias("decision_id"), rid.alias("recommendation_id"), F.when(F.col("l_returnflag") == "A", "approve").otherwise("request_revision").alias("action"), F.col("l_linestatus").alias("actor"), F.col("l_shipdate").alias("decided_at"), place
    )
    state = F.when(F.col("l_tax") < 0.02, "verified").when(F.col("l_tax") < 0.04, "expired").otherwise("requested")
    commitments = l.where("l_linenumber >= 3").select(
        text(F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber").alias("commitment_id"), text(F.lit("d"), "l_orderkey", F.lit("-"), F.col("l_linenumber") - 1).alias("decision_id"),
        text(F.lit("r"), F.col("l_orderkey") + F.col("l_linenumber") - 4).alias("recommendation_id"), F.col("l_returnflag").alias("outcome"), state.alias("state"), F.col("l_linestatus").alias("rule"),
    )
    return graph.lineage(incidents, recommendations, evidence, findings, decisions, commitments)


@query(f"""WITH {LINEAGE}
SELECT id AS node_id, 'incident' AS node_type, title AS label, 'current' AS flag FROM i
UNION ALL SELECT id, 'recommendation', action, CASE WHEN state = 'approved' THEN 'closed' ELSE 'current' END FROM r
UNION ALL SELECT eid, 'evidence', eid, 'current' FROM o
UNION ALL SELECT fid, 'finding', any_value(desk || ' · ' || status), any_value(status) FROM s GROUP BY fid
UNION ALL SELECT id, 'decision', replace(action, '_', ' ') || ' · ' || actor, CASE WHEN row_number() OVER (PARTITION BY rid ORDER BY happened DESC, id DESC) = 1 THEN 'current' ELSE 'historical' END FROM d
UNION ALL SELECT id, 'commitment', outcome, CASE WHEN state = 'requested' THEN 'current' ELSE 'closed' END FROM c
UNION ALL SELECT vid, 'verification', rule, 'current' FROM v""")
def lineage_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Seven types of nodes, each id once, with what makes them current, closed or historical."""
    return _lineage(spark, sf)[0]


@query(f"""WITH {LINEAGE}
SELECT 'triggered' AS edge_type, incident AS src, r.id AS dst FROM r JOIN i ON i.id = incident
UNION ALL SELECT 'supports', eid, rid FROM p UNION ALL SELECT 'supports', eid, incident FROM p WHERE has
UNION ALL SELECT 'informed', fid, incident FROM s WHERE has UNION ALL SELECT 'informed', fid, rid FROM s
UNION ALL SELECT 'supports', x.eid, fid FROM (SELECT fid, rank, unnest(list_distinct(cited)) AS eid FROM s) x JOIN o ON o.eid = x.eid WHERE first_rank <= rank
UNION ALL SELECT CASE WHEN action = 'approve' THEN 'approved' ELSE action END, rid, id FROM d
UNION ALL SELECT 'assigned', did, c.id FROM c JOIN d ON d.id = did
UNION ALL SELECT 'assigned', c.rid, c.id FROM c JOIN r ON r.id = c.rid WHERE did NOT IN (SELECT id FROM d)
UNION ALL SELECT 'verified', id, vid FROM v""")
def lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between them: citations of unknown evidence are skipped, commitments fall back to the recommendation."""
    return _lineage(spark, sf)[1]


#: Edges of the lineage with a weight: what a recommendation rests on counts by its evidence, everything else once.
_WEIGHED = f"""WITH RECURSIVE {LINEAGE}, n AS (SELECT rid, count(*) AS n FROM p GROUP BY 1),
edges AS (
SELECT incident AS src, r.id AS dst, coalesce(n, 1) AS w FROM r JOIN i ON i.id = incident LEFT JOIN n ON n.rid = r.id
UNION ALL SELECT eid, incident, 1 FROM p WHERE has UNION ALL SELECT fid, incident, 1 FROM s WHERE has
UNION ALL SELECT x.eid, fid, 1 FROM (SELECT fid, rank, unnest(list_distinct(cited)) AS eid FROM s) x JOIN o ON o.eid = x.eid WHERE first_rank <= rank
UNION ALL SELECT d.rid, d.id, coalesce(n, 1) FROM d LEFT JOIN n ON n.rid = d.rid
UNION ALL SELECT did, c.id, 1 FROM c JOIN d ON d.id = did UNION ALL SELECT id, vid, 1 FROM v),
g AS (SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM edges GROUP BY 1, 2),
walk AS (SELECT DISTINCT src AS node_id, 0 AS d FROM g WHERE src NOT IN (SELECT dst FROM g) UNION SELECT dst, d + 1 FROM walk JOIN g ON src = node_id),
col AS (SELECT node_id, CAST(max(d) AS BIGINT) AS c FROM walk GROUP BY 1),
p0 AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS pos FROM col WHERE c = 0),
""" + ",\n".join(
    f"""p{c} AS (SELECT * FROM p{c - 1} UNION ALL SELECT node_id, row_number() OVER (ORDER BY m, node_id) - 1 FROM (
  SELECT dst AS node_id, sum(w * pos) / sum(w) AS m FROM g JOIN col ON col.node_id = dst AND col.c = {c} JOIN p{c - 1} q ON q.node_id = src GROUP BY 1))"""
    for c in range(1, 8)
)


def _met(spark: SparkSession, sf: str) -> DataFrame:
    l, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    line = F.col("l_linenumber")
    lines = l.select(
        F.col("l_orderkey").alias("rec"), line.alias("line"), (F.col("l_partkey") % 500).alias("part"), (F.col("l_suppkey") % 700).alias("also"), F.coalesce(F.col("l_returnflag") != "N", F.lit(False)).alias("evident"),
        (line <= 2).alias("said"), F.concat("l_linestatus", line).alias("desk"), F.col("l_shipdate").alias("at"), F.coalesce((line >= 3) & (F.col("l_tax") < 0.02), F.lit(False)).alias("verified"),
    )
    return chains.met(lines, o.select(F.col("o_orderkey").alias("rec"), F.col("o_custkey").alias("incident")), c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("incident")))


@query(_WEIGHED + """
SELECT col.node_id, c AS "column", pos AS position, CAST(coalesce(n_in, 0) AS BIGINT) AS n_in, CAST(coalesce(n_out, 0) AS BIGINT) AS n_out FROM col JOIN p7 USING (node_id)
LEFT JOIN (SELECT dst AS node_id, sum(w) AS n_in FROM g GROUP BY 1) USING (node_id) LEFT JOIN (SELECT src AS node_id, sum(w) AS n_out FROM g GROUP BY 1) USING (node_id)""")
def lineage_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The lineage in seven columns: where each node stands and the weights that reach and leave it."""
    return chains.columns(_met(spark, sf))


@query(_WEIGHED + " SELECT src, dst, w AS weight FROM g")
def lineage_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of that view, those between the same nodes as one with their weights summed."""
    return chains.weights(_met(spark, sf))


# ---- a batch as one ------------------------------------------------------------

_KEY = "CAST(split_part({c}, ':', 2) AS BIGINT)"
#: Three requests: places, then who is there, then suppliers that have changed.  Some edges lead to nodes that are not active.
INGEST = f"""{NODES}, {EDGES}, n AS (SELECT *, {_KEY.format(c="node_id")} AS k, node_type IN ('nation', 'region') AS place FROM nodes),
e AS (SELECT src || '>' || split_part(dst, ':', 1) AS edge_id, src, dst, {_KEY.format(c="src")} AS k, split_part(src, ':', 1) AS kind FROM edges),
n2 AS (SELECT node_id, k, active, active <> (k % 5 = 0) AS active2, label, CASE WHEN k % 3 = 0 THEN label || '*' ELSE label END AS label2 FROM n WHERE node_type = 'supplier'),
live1 AS (SELECT node_id FROM n WHERE active),
live2 AS (SELECT node_id FROM n WHERE active AND node_type <> 'supplier' UNION ALL SELECT node_id FROM n2 WHERE active2),
e1 AS (SELECT *, src IN (SELECT node_id FROM live1) AND dst IN (SELECT node_id FROM live1) AS ok FROM e),
e2 AS (SELECT edge_id, src, dst, to2, src IN (SELECT node_id FROM live2) AND to2 IN (SELECT node_id FROM live2) AS ok2, ok AS ok1, k FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'nation:' || ({_KEY.format(c="dst")} + 1) % 25 ELSE dst END AS to2 FROM e1 WHERE kind = 'supplier'))"""


def _batches(spark: SparkSession, sf: str) -> tuple[ingest.Store, list[ingest.Taken]]:
    """The store after the three requests, a replay of the second and another body under its name; what became of each."""
    nodes, edges = geography(spark, sf)
    none, when = F.lit(None).cast("string"), F.lit("2024-01-10").cast("timestamp_ntz")
    who = F.array(F.concat(F.lit("e"), _number("node_id")))

    def as_nodes(df: DataFrame) -> DataFrame:
        flags = F.array().cast("array<string>").alias("quality_flags")
        return df.select("node_id", "node_type", "label", F.col("label").alias("state"), none.alias("geometry"), flags, "active", "valid_from", "valid_until", who.alias("evidence_ids"))

    def as_edges(df: DataFrame) -> DataFrame:
        flags, up = F.array().cast("array<string>").alias("quality_flags"), F.split("dst", ":")[0]
        edge_id, kind = F.concat_ws(">", "src", up).alias("edge_id"), F.lit("part_of").alias("edge_type")
        return df.select(edge_id, kind, "src", "dst", none.alias("state"), none.alias("geometry"), flags, F.lit(True).alias("active"), when.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit(None).cast("array<string>").alias("evidence_ids"))

    place, supplied = F.col("node_type").isin("nation", "region"), F.col("src").startswith("supplier:")
    k = _number("node_id")
    changed = nodes.where("node_type = 'supplier'").withColumns({"active": F.col("active") != (k % 5 == 0), "label": F.when(k % 3 == 0, F.concat("label", F.lit("*"))).otherwise(F.col("label"))})
    moved = edges.where(supplied).withColumn("dst", F.when(_number("src") % 4 == 0, F.concat(F.lit("nation:"), (_number("dst") + 1) % 25)).otherwise(F.col("dst")))
    upward = F.col("src").startswith("nation:")
    first = (as_nodes(nodes.where(place)), as_edges(edges.where(upward)))
    second = (as_nodes(nodes.where(~place)), as_edges(edges.where(~upward)))
    third = (as_nodes(changed), as_edges(moved))
    known = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id") * 2).alias("evidence_id"))
    store = ingest.graph_store(spark, new_folder(spark, "graphs"))
    calls = [("a", first), ("b", second), ("b", second), ("b", third), ("c", third)]
    return store, [ingest.ingest(store, "source", request, n, e, known) for request, (n, e) in calls]


@query(f"""WITH {INGEST},
a AS (SELECT 'a' AS request_id, (SELECT count(*) FROM n WHERE place) AS n_nodes, (SELECT count(*) FROM e1 WHERE kind = 'nation' AND ok) AS n_edges, 0 AS n_unchanged, (SELECT count(*) FROM e1 WHERE kind = 'nation' AND NOT ok) AS n_rejected),
b AS (SELECT 'b', (SELECT count(*) FROM n WHERE NOT place), (SELECT count(*) FROM e1 WHERE kind <> 'nation' AND ok), 0, (SELECT count(*) FROM e1 WHERE kind <> 'nation' AND NOT ok)),
c AS (SELECT 'c', (SELECT count(*) FROM n2 WHERE active <> active2 OR label <> label2), (SELECT count(*) FROM e2 WHERE ok2 AND (NOT ok1 OR dst <> to2)), (SELECT count(*) FROM n2 WHERE active = active2 AND label = label2) + (SELECT count(*) FROM e2 WHERE ok2 AND ok1 AND dst = to2), (SELECT count(*) FROM e2 WHERE NOT ok2)),
r AS (SELECT 1 AS call, 'applied' AS outcome, a.* FROM a UNION ALL SELECT 2, 'applied', b.* FROM b UNION ALL SELECT 3, 'replayed', b.* FROM b UNION ALL SELECT 5, 'applied', c.* FROM c)
SELECT CAST(call AS BIGINT) AS call, request_id, outcome, CASE WHEN n_rejected > 0 THEN 'partial' ELSE 'succeeded' END AS status, n_nodes, n_edges, CAST(n_unchanged AS BIGINT) AS n_unchanged, n_rejected FROM r
UNION ALL SELECT 4, 'b', 'conflict', NULL, NULL, NULL, NULL, NULL""")
def graph_batch_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of batches: applied, replayed with the counts of the first time, in conflict."""
    _, taken = _batches(spark, sf)
    rows = [(n, t.request_id, t.outcome, t.status, t.n_nodes, t.n_edges, t.n_unchanged, t.n_rejected) for n, t in enumerate(taken, 1)]
    return spark.createDataFrame(rows, "call long, request_id string, outcome string, status string, n_nodes long, n_edges long, n_unchanged long, n_rejected long")


@query(f"""WITH {INGEST}
SELECT 'node' AS entity, node_id AS entity_id, CASE WHEN place THEN 'a' ELSE 'b' END AS request_id, 'created' AS change_type, CAST(1 AS BIGINT) AS version, NULL AS previous_state, label AS state FROM n
UNION ALL SELECT 'edge', edge_id, CASE WHEN kind = 'nation' THEN 'a' ELSE 'b' END, 'created', 1, NULL, NULL FROM e1 WHERE ok
UNION ALL SELECT 'node', node_id, 'c', CASE WHEN active AND NOT active2 THEN 'deactivated' WHEN active2 AND NOT active THEN 'reactivated' ELSE 'state_updated' END, 2, label, label2 FROM n2 WHERE active <> active2 OR label <> label2
UNION ALL SELECT 'edge', edge_id, 'c', CASE WHEN ok1 THEN 'state_updated' ELSE 'created' END, CASE WHEN ok1 THEN 2 ELSE 1 END, NULL, NULL FROM e2 WHERE ok2 AND (NOT ok1 OR dst <> to2)""")
def graph_ingest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The changes that the batches have left in the graph's log."""
    store, _ = _batches(spark, sf)
    return store.read("changes").select("entity", "entity_id", "request_id", "change_type", "version", "previous_state", "state")


@query(f"""WITH {INGEST}, known AS (SELECT 'e' || event_id * 2 AS evidence_id FROM events), links AS (SELECT node_id, 'e' || k AS evidence_id FROM n SEMI JOIN known ON known.evidence_id = 'e' || k)
SELECT n.node_id, n.node_type, coalesce(n2.active2, n.active) AS active, CASE WHEN n2.active <> n2.active2 OR n2.label <> n2.label2 THEN 2 ELSE 1 END::BIGINT AS version, l.evidence_id FROM n LEFT JOIN n2 USING (node_id) LEFT JOIN links l USING (node_id)""")
def graph_ingested_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes after the batches with the evidence that is linked to them, each link once."""
    store, _ = _batches(spark, sf)
    state = store.state()
    links = store.read("evidence", state).where("entity = 'node'").select(F.col("entity_id").alias("node_id"), "evidence_id")
    return store.read("nodes", state).join(links, "node_id", "left").select("node_id", "node_type", "active", "version", "evidence_id")
