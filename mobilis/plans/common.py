"""The driver's tables as evidence, sources and a graph, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators.evidence import hashed


def catalogue():
    """(queries, their SQL, the decorator that registers a query under its name)."""
    found: dict = {}
    sql_of: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(fn):
            found[fn.__name__] = fn
            if sql:
                sql_of[fn.__name__] = sql
            return fn

        return keep

    return found, sql_of, query


AS_OF_TEXT = "2024-01-31 00:00:00"
CONNECTORS = ["click", "error", "purchase", "signup", "view"]


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as evidence: the type is the connector, type and user the upstream identity."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("evidence_id"),
        F.col("event_type").alias("connector_code"),
        F.concat_ws(":", "event_type", "user_id").alias("source_event_id"),
        F.col("ts").alias("observed_at"),
        F.col("ts").alias("received_at"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    return hashed(rows, ["cents", "k"])


EV = """ev AS (
  SELECT event_id AS evidence_id, event_type AS connector_code, event_type || ':' || user_id AS source_event_id,
         ts AS observed_at, ts AS received_at, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents,
         sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '|' || (props->>'$.k')) AS content_hash
  FROM events)"""

SOURCES = [("click", 600, True), ("error", 1800, True), ("purchase", 3600, True), ("signup", 60, True), ("siem", 300, False)]
SOURCES_SQL = "src(connector_code, stale_after_seconds, configured) AS (VALUES ('click', 600, true), ('error', 1800, true), ('purchase', 3600, true), ('signup', 60, true), ('siem', 300, false))"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "connector_code string, stale_after_seconds long, configured boolean")


def geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and customers in nations in regions, as (nodes, edges); an edge leads upwards."""
    s, c, n, r = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation", "region"))

    def node(df, kind, key, label, day):
        day = F.col(key).cast("int") % 20 if day else F.lit(0)
        start = F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval(days=day)
        until = F.when(F.col(key) % 7 == 3, start + F.expr("INTERVAL 15 DAYS"))
        return df.select(F.concat(F.lit(kind), F.lit(":"), F.col(key)).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"), start.alias("valid_from"), until.alias("valid_until"), (F.col(key) % 11 != 5).alias("active"))

    nodes = node(s, "supplier", "s_suppkey", "s_name", True).unionByName(node(c, "customer", "c_custkey", "c_name", True)).unionByName(node(n, "nation", "n_nationkey", "n_name", False)).unionByName(node(r, "region", "r_regionkey", "r_name", False))

    def edge(df, kind, key, to, up):
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("src"), F.concat(F.lit(f"{up}:"), F.col(to)).alias("dst"))

    edges = edge(s, "supplier", "s_suppkey", "s_nationkey", "nation").unionByName(edge(c, "customer", "c_custkey", "c_nationkey", "nation")).unionByName(edge(n, "nation", "n_nationkey", "n_regionkey", "region"))
    return nodes, edges


def _node_sql(kind: str, t: str, key: str, label: str, day: bool) -> str:
    start = f"TIMESTAMP '2024-01-10' + to_days(CAST({key} % 20 AS INTEGER))" if day else "TIMESTAMP '2024-01-10'"
    return f"SELECT '{kind}:' || {key} AS node_id, '{kind}' AS node_type, {label} AS label, {start} AS valid_from, CASE WHEN {key} % 7 = 3 THEN {start} + INTERVAL 15 DAY END AS valid_until, {key} % 11 <> 5 AS active FROM {t}"


NODES = "nodes AS (" + " UNION ALL ".join([_node_sql("supplier", "supplier", "s_suppkey", "s_name", True), _node_sql("customer", "customer", "c_custkey", "c_name", True), _node_sql("nation", "nation", "n_nationkey", "n_name", False), _node_sql("region", "region", "r_regionkey", "r_name", False)]) + ")"
EDGES = """edges AS (
  SELECT 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
