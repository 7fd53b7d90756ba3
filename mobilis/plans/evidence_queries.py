"""Queries over evidence: intake, freshness, rules and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import js_number, js_text
from mobilis.functions.text import event_identity, haversine_km, in_box, match_rank, representative_point
from mobilis.functions.time import lag_seconds, quality_flags
from mobilis.operators import detection, views
from mobilis.operators import evidence as ev_ops
from mobilis.plans.common import AS_OF_TEXT, EV, SOURCES_SQL, as_of, catalogue, evidence, sources, table

Q, SQL, query = catalogue()


@query(f"WITH {EV} SELECT evidence_id, connector_code, source_event_id, content_hash FROM ev")
def evidence_canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).select("evidence_id", "connector_code", "source_event_id", "content_hash")


@query(f"""WITH {EV}, marked AS (
  SELECT *, lag(content_hash) OVER w IS DISTINCT FROM content_hash AS fresh,
         row_number() OVER (PARTITION BY connector_code, source_event_id ORDER BY observed_at DESC, evidence_id DESC) AS place
  FROM ev WINDOW w AS (PARTITION BY connector_code, source_event_id ORDER BY observed_at, evidence_id))
SELECT connector_code, source_event_id, max(evidence_id) FILTER (place = 1) AS evidence_id, max(content_hash) FILTER (place = 1) AS content_hash,
       max(observed_at) AS received_at, count(*) FILTER (fresh) AS version
FROM marked GROUP BY connector_code, source_event_id""")
def evidence_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ev_ops.current(evidence(spark, sf))


@query(f"""WITH {EV}, split AS (SELECT *, observed_at < TIMESTAMP '2024-01-20' AS old FROM ev),
ranked AS (SELECT *, row_number() OVER (PARTITION BY old, connector_code, source_event_id ORDER BY observed_at DESC, evidence_id DESC) AS place FROM split),
a AS (SELECT * FROM ranked WHERE old AND place = 1), b AS (SELECT * FROM ranked WHERE NOT old AND place = 1)
SELECT coalesce(a.connector_code, b.connector_code) AS connector_code, coalesce(a.source_event_id, b.source_event_id) AS source_event_id,
       coalesce(b.content_hash, a.content_hash) AS content_hash,
       CASE WHEN b.content_hash IS NULL THEN 'untouched' WHEN a.content_hash IS NULL THEN 'inserted' WHEN a.content_hash = b.content_hash THEN 'confirmed' ELSE 'overwritten' END AS change,
       CAST(CASE WHEN a.content_hash IS NULL OR b.content_hash IS NULL OR a.content_hash = b.content_hash THEN 1 ELSE 2 END AS BIGINT) AS version
FROM a FULL JOIN b ON a.connector_code = b.connector_code AND a.source_event_id = b.source_event_id""")
def evidence_merge_batch(spark: SparkSession, sf: str) -> DataFrame:
    ev = evidence(spark, sf)
    newest = [F.desc("observed_at"), F.desc("evidence_id")]
    old = ev_ops.latest_per(ev.where("observed_at < timestamp_ntz'2024-01-20'"), ev_ops.KEY, newest).withColumn("version", F.lit(1).cast("long"))
    new = ev_ops.latest_per(ev.where("observed_at >= timestamp_ntz'2024-01-20'"), ev_ops.KEY, newest)
    return ev_ops.upsert(old, new).select(*ev_ops.KEY, "content_hash", "change", "version")


@query(f"""WITH {EV}, marked AS (SELECT connector_code, CASE WHEN lag(content_hash) OVER w = content_hash THEN 'duplicate' ELSE 'accepted' END AS outcome
  FROM ev WINDOW w AS (PARTITION BY connector_code, source_event_id ORDER BY observed_at, evidence_id))
SELECT connector_code, outcome, count(*) AS n FROM marked GROUP BY ALL""")
def ingest_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev_ops.outcomes(evidence(spark, sf)).groupBy("connector_code", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH runs AS (SELECT event_type AS connector_code, event_id AS run_id, ts, epoch_us(ts) // 3600000000 AS bucket FROM events),
marked AS (SELECT *, row_number() OVER (PARTITION BY connector_code, bucket ORDER BY ts, run_id) = 1 AS claimed FROM runs)
SELECT connector_code, bucket, run_id FROM marked WHERE claimed""")
def cadence_bucket_claims(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(F.col("event_type").alias("connector_code"), F.col("event_id").alias("run_id"), "ts")
    return ev_ops.claims(runs, "connector_code", "ts", 3600).where("claimed").select("connector_code", "bucket", "run_id")


@query(f"""WITH {EV} SELECT evidence_id, connector_code, observed_at FROM ev
WHERE connector_code IN ('click', 'error', 'view') AND received_at > TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 72 HOUR AND received_at <= TIMESTAMP '{AS_OF_TEXT}'
ORDER BY observed_at DESC, evidence_id LIMIT 800""")
def evidence_window_top800(spark: SparkSession, sf: str) -> DataFrame:
    return ev_ops.window_top(evidence(spark, sf), ["click", "error", "view"], as_of(), hours=72).select("evidence_id", "connector_code", "observed_at")


@query(f"""WITH {EV}, aged AS (SELECT connector_code, date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF_TEXT}') / 1e6 AS age FROM ev)
SELECT connector_code, CASE WHEN age > 2 * 432000 THEN 'stale,outside_freshness_window' WHEN age > 432000 THEN 'delayed' ELSE '' END AS flags, count(*) AS n FROM aged GROUP BY ALL""")
def quality_flags_by_age(spark: SparkSession, sf: str) -> DataFrame:
    age = F.timestamp_diff("MICROSECOND", F.col("observed_at"), as_of()) / 1e6
    flags = F.array_join(quality_flags(age, F.lit(432_000)), ",")
    return evidence(spark, sf).groupBy("connector_code", flags.alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, {SOURCES_SQL}, last AS (SELECT connector_code, max(observed_at) AS last_observed_at, count(*) AS n_rows FROM ev GROUP BY 1),
met AS (SELECT s.connector_code, n_rows, last_observed_at, stale_after_seconds,
  CAST(greatest(0, floor(date_diff('microsecond', last_observed_at, TIMESTAMP '{AS_OF_TEXT}') / 1e6 + 0.5)) AS BIGINT) AS lag FROM src s LEFT JOIN last l ON l.connector_code = s.connector_code)
SELECT connector_code, n_rows, CASE WHEN last_observed_at IS NOT NULL THEN lag END AS lag_seconds,
  CASE WHEN last_observed_at IS NULL THEN 'unavailable' WHEN lag > stale_after_seconds THEN 'delayed' ELSE 'healthy' END AS health FROM met""")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    return ev_ops.source_health(evidence(spark, sf), sources(spark), as_of()).select("connector_code", "n_rows", "lag_seconds", "health")


@query(f"""WITH h AS ({SQL["source_health"]})
SELECT count(*) FILTER (health = 'healthy') AS n_healthy, count(*) FILTER (health = 'delayed') AS n_delayed, count(*) FILTER (health = 'unavailable') AS n_unavailable,
       count(*) FILTER (health <> 'healthy') > 0 AS degraded FROM h""")
def source_health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    counts = [F.count_if(F.col("health") == h).alias(f"n_{h}") for h in ("healthy", "delayed", "unavailable")]
    return source_health(spark, sf).agg(*counts, (F.count_if(F.col("health") != "healthy") > 0).alias("degraded"))


# ---- rules: each connector's rows carry the attributes of one feed ------------

RULES = [("algo-crash", "click", "high"), ("algo-incident", "click", "medium"), ("tomtom-corridor-degraded", "error", "medium"), ("nws-alert-active", "purchase", "high"), ("usgs-stream-rapid-rise", "signup", "medium"), ("usgs-earthquake-felt", "view", "high"), ("no-such-rule", "view", "low")]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_code string, connector_code string, severity string")


def with_attributes(ev: DataFrame) -> DataFrame:
    k, cents, c = F.col("k"), F.col("cents"), F.col("connector_code")
    user = F.element_at(F.split("source_event_id", ":"), -1)
    kind = F.when(k % 3 == 0, "Crash").when(k % 3 == 1, "Incident").otherwise("Roadwork")
    json = (
        F.when(c == "click", F.to_json(F.struct(F.lit("traffic_event").alias("layer"), kind.alias("eventType"), user.alias("algoEventId"))))
        .when(c == "error", F.concat(F.lit('{"pointCode":"'), user, F.lit('","currentSpeedMph":'), F.when(k % 10 == 0, "null").otherwise(cents.cast("string")), F.lit(',"freeFlowSpeedMph":10000,"confidence":'), F.when(k < 20, "null").otherwise((k / 100).cast("string")), F.lit("}")))
        .when(c == "purchase", F.to_json(F.struct(user.alias("alertId"), F.when(k % 2 == 0, "Extreme").otherwise("Severe").alias("severity"), F.when(k % 5 != 0, F.date_format(F.col("observed_at") + F.make_dt_interval(hours=k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("expiresAt"))))
        .when(c == "signup", F.to_json(F.struct(F.lit("stream_gauge").alias("layer"), user.alias("siteCode"), (cents / 1000).alias("riseFt"))))
        .otherwise(F.to_json(F.struct(F.lit("earthquake").alias("layer"), user.alias("quakeId"), (k / 16).alias("magnitude"))))
    )
    return ev.withColumn("attributes", F.parse_json(json))


HITS = f"""{EV}, named AS (SELECT *, split_part(source_event_id, ':', 2) AS who FROM ev), fired AS (
  SELECT *, 'algo-crash' AS rule_code, 'algo-event:' || who AS external_key, 'high' AS severity FROM named WHERE connector_code = 'click' AND k % 3 = 0
  UNION ALL SELECT *, 'algo-incident', 'algo-event:' || who, 'medium' FROM named WHERE connector_code = 'click' AND k % 3 = 1
  UNION ALL SELECT *, 'tomtom-corridor-degraded', 'tomtom-point:' || who, 'medium' FROM named
    WHERE connector_code = 'error' AND k >= 70 AND CASE WHEN k % 10 = 0 THEN 0 ELSE cents END / 10000 < 0.6
  UNION ALL SELECT *, 'nws-alert-active', 'nws-alert:' || who, CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'high' END FROM named
    WHERE connector_code = 'purchase' AND (k % 5 = 0 OR date_trunc('second', observed_at + to_hours(CAST(k AS INTEGER))) >= TIMESTAMP '{AS_OF_TEXT}')
  UNION ALL SELECT *, 'usgs-stream-rapid-rise', 'usgs-gauge:' || who, 'medium' FROM named WHERE connector_code = 'signup' AND cents / 1000 >= 2
  UNION ALL SELECT *, 'usgs-earthquake-felt', 'usgs-quake:' || who, CASE WHEN k / 16 >= 5.5 THEN 'critical' ELSE 'high' END FROM named WHERE connector_code = 'view' AND k / 16 >= 4)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return detection.hits(rules(spark), with_attributes(evidence(spark, sf)), as_of())


@query(f"WITH {HITS} SELECT evidence_id, rule_code, external_key, severity FROM fired")
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("evidence_id", "rule_code", "external_key", "severity")


@query(f"WITH {EV} SELECT 'no-such-rule' AS rule_code, connector_code, count(*) AS n_unjudged FROM ev WHERE connector_code = 'view' GROUP BY 2")
def rule_registry_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rules without a predicate, and how much evidence they leave unjudged."""
    n = evidence(spark, sf).groupBy("connector_code").agg(F.count(F.lit(1)).alias("n_unjudged"))
    return detection.unknown_rules(rules(spark)).join(n, "connector_code").select("rule_code", "connector_code", "n_unjudged")


COLLAPSED = f"""{HITS}, placed AS (SELECT *, row_number() OVER (PARTITION BY rule_code, external_key ORDER BY observed_at DESC, evidence_id) AS rn FROM fired),
matches AS (SELECT rule_code, external_key, max(evidence_id) FILTER (rn = 1) AS primary_id, max(severity) FILTER (rn = 1) AS severity, max(observed_at) AS observed_at,
  count(*) AS n_evidence, sha256(string_agg(evidence_id || ':' || content_hash, '|' ORDER BY evidence_id || ':' || content_hash)) AS evidence_hash
  FROM placed WHERE rn <= 12 GROUP BY rule_code, external_key)"""


@query(f"WITH {COLLAPSED} SELECT rule_code, external_key, primary_id, severity, observed_at, n_evidence FROM matches")
def match_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return detection.collapse(_hits(spark, sf)).drop("evidence_hash")


@query(f"WITH {COLLAPSED} SELECT rule_code, external_key, evidence_hash FROM matches")
def match_evidence_hash(spark: SparkSession, sf: str) -> DataFrame:
    return detection.collapse(_hits(spark, sf)).select("rule_code", "external_key", "evidence_hash")


@query(f"""WITH {COLLAPSED} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, observed_at DESC, rule_code, external_key) AS place,
  rule_code, external_key, severity FROM matches QUALIFY place <= 50""")
def match_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    top = detection.ranked(detection.collapse(_hits(spark, sf))).limit(50)
    w = Window.orderBy(match_rank(F.col("severity")), F.desc("observed_at"), "rule_code", "external_key")  # over 50 rows
    return top.select(F.row_number().over(w).cast("long").alias("place"), "rule_code", "external_key", "severity")


@query("""SELECT event_type AS site, max(ts) AS last_at, n AS n_readings, CASE WHEN n > 1 THEN last_value - first_value END AS rise FROM (
  SELECT e.event_type, max(ts) AS ts, count(*) AS n, arg_max(cents, (ts, event_id)) AS last_value, arg_min(cents, (ts, event_id)) AS first_value
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e JOIN (SELECT event_type, max(ts) AS last_at FROM events GROUP BY 1) l ON l.event_type = e.event_type AND e.ts >= l.last_at - INTERVAL 3 HOUR
  GROUP BY e.event_type) GROUP BY ALL""")
def gauge_rise_3h(spark: SparkSession, sf: str) -> DataFrame:
    readings = table(spark, sf, "events").select(F.col("event_type").alias("site"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return views.rise(readings, "site", F.col("ts"), "cents")


@query("""SELECT user_id AS site, arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) FILTER (event_type = 'click') AS height,
  arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) FILTER (event_type = 'view') AS flow, max(ts) AS observed_at FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def gauge_merge_sites(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.col("cents")), F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    return e.groupBy(F.col("user_id").alias("site")).agg(last("click").alias("height"), last("view").alias("flow"), F.max("ts").alias("observed_at"))


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, CAST(round(value * 100) AS BIGINT) AS t, event_type, CAST(props->>'$.k' AS DOUBLE) AS k FROM events)
SELECT user_id, max(t) FILTER (event_type <> 'view') AS max_temperature, max(k) AS max_precip, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS thunder_hours FROM p WHERE place <= 12 GROUP BY user_id""")
def forecast_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    period = F.struct("ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("temperature"), F.when(F.col("event_type") == "view", "C").otherwise("F").alias("unit"), F.get_json_object("props", "$.k").cast("double").alias("precip"), F.when(F.col("event_type") == "error", "Thunderstorms").otherwise("Sunny").alias("text"))
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("rn <= 12")  # what a forecast may use
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(period)).alias("periods"))
    return listed.select("user_id", *[c.alias(n) for n, c in views.forecast(F.col("periods")).items()])


@query("""SELECT c_custkey, CAST(floor(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat - 32.6) / 2), 2) + cos(radians(32.6)) * cos(radians(lat)) * pow(sin(radians(lon + 85.5) / 2), 2)))) + 0.5) AS BIGINT) AS km
FROM (SELECT c_custkey, 25 + (c_custkey % 150) / 10 AS lat, -95 + (c_custkey % 190) / 10 AS lon FROM customer)""")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", (25 + F.col("c_custkey") % 150 / 10).alias("lat"), (-95 + F.col("c_custkey") % 190 / 10).alias("lon"))
    return c.select("c_custkey", haversine_km(F.col("lat"), F.col("lon"), 32.6, -85.5).alias("km"))


@query("""SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, n_name, 25 + (c_custkey % 150) / 10 AS lat, -95 + (c_custkey % 190) / 10 AS lon FROM customer JOIN nation ON n_nationkey = c_nationkey)
WHERE lower(c_mktsegment) IN ('household') OR lower(n_name) IN ('nation_3', 'nation_4') OR (lat BETWEEN 32.5 AND 33 AND lon BETWEEN -86 AND -84)""")
def operating_box_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    lat, lon = 25 + F.col("c_custkey") % 150 / 10, -95 + F.col("c_custkey") % 190 / 10
    return c.where(in_box(F.col("c_mktsegment"), F.col("n_name"), lat, lon, ["household"], ["nation_3", "nation_4"], (32.5, -86.0, 33.0, -84.0))).select("c_custkey")


@query(f"""SELECT event_id FROM events WHERE event_type <> 'error' AND (CAST(props->>'$.k' AS BIGINT) % 10 IN (2, 3) OR (CAST(props->>'$.k' AS BIGINT) + 5) % 10 IN (2, 3))
AND ts + INTERVAL 24 HOUR >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 10 DAY""")
def zone_overlap_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    zones = F.array(*[F.concat(F.lit("ALZ"), z.cast("string")) for z in (k % 10, (k + 5) % 10)])
    live = F.col("ts") + F.expr("INTERVAL 24 HOURS") >= as_of() - F.expr("INTERVAL 10 DAYS")
    return table(spark, sf, "events").where((F.col("event_type") != "error") & F.arrays_overlap(zones, F.array(F.lit("ALZ2"), F.lit("ALZ3"))) & live).select("event_id")


@query(f"""WITH {EV} SELECT evidence_id, CASE k % 4 WHEN 0 THEN 'KBMX.TO.W.' || lpad(CAST(evidence_id % 10000 AS VARCHAR), 4, '0') || '.26' WHEN 1 THEN 'urn:' || evidence_id ELSE 'unknown' END AS identity FROM ev""")
def vtec_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The identity of a warning from its code, else from its address."""
    k, n = F.col("k"), F.col("evidence_id")
    code = F.concat(F.lit("/O.NEW.KBMX.TO.W."), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(".260912T1800Z-260912T1900Z/"))
    vtec = F.when(k % 4 == 0, code).when(k % 4 == 2, "nonsense")
    fallback = F.when(k % 4 == 1, F.concat(F.lit("urn:"), n)).when(k % 4 == 2, "")
    return evidence(spark, sf).select("evidence_id", event_identity(vtec, fallback).alias("identity"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN x + 0.5 WHEN 1 THEN x + 1 WHEN 4 THEN NULL ELSE x END AS lon, CASE c_custkey % 5 WHEN 0 THEN y + 0.5 WHEN 1 THEN y + 1 WHEN 4 THEN NULL ELSE y END AS lat
FROM (SELECT c_custkey, CAST(c_custkey % 180 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)""")
def representative_points(spark: SparkSession, sf: str) -> DataFrame:
    """One point of each shape; a line gives its middle vertex, an unknown shape none."""
    key, x, y = F.col("c_custkey") % 5, F.col("c_custkey") % 180, F.col("c_nationkey")
    kind = F.when(key == 0, "Point").when(key == 1, "LineString").when(key == 2, "Polygon").when(key == 3, "MultiPolygon").otherwise("Other")
    pair = lambda d: F.concat(F.lit("["), (x + d).cast("string"), F.lit(","), (y + d).cast("string"), F.lit("]"))
    coordinates = (
        F.when(key == 0, pair(0.5))
        .when(key == 1, F.concat(F.lit("["), F.concat_ws(",", pair(0), pair(1), pair(2)), F.lit("]")))
        .when(key == 2, F.concat(F.lit("[["), F.concat_ws(",", pair(0), pair(3)), F.lit("]]")))
        .when(key == 3, F.concat(F.lit("[[["), pair(0), F.lit("]]]")))
        .otherwise(pair(0))
    )
    lon, lat = representative_point(kind, F.parse_json(coordinates))
    return table(spark, sf, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


@query(f"""WITH {EV} SELECT evidence_id, CAST(CASE k % 10 WHEN 0 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN cents WHEN 5 THEN 16 WHEN 7 THEN cents / 4 WHEN 8 THEN cents * 100 WHEN 9 THEN 0 END AS DOUBLE) AS number,
  CASE k % 10 WHEN 3 THEN 'true' WHEN 4 THEN ' ' || cents || ' ' WHEN 5 THEN '0x10' WHEN 6 THEN 'c' || cents WHEN 8 THEN cents || 'e2' WHEN 9 THEN 'false' WHEN 7 THEN 'n' ELSE '' END AS text FROM ev""")
def js_number_semantics(spark: SparkSession, sf: str) -> DataFrame:
    """Members as numbers and as text: null, missing, blank, flags, padded, hexadecimal, words and powers."""
    k, cents = F.col("k") % 10, F.col("cents")
    texts = [F.lit('{"x":null}'), F.lit("{}"), F.lit('{"x":""}'), F.lit('{"x":true}'), F.concat(F.lit('{"x":" '), cents, F.lit(' "}')), F.lit('{"x":"0x10"}'), F.concat(F.lit('{"x":"c'), cents, F.lit('"}')), F.concat(F.lit('{"x":'), (cents / 4).cast("string"), F.lit("}")), F.concat(F.lit('{"x":"'), cents, F.lit('e2"}')), F.lit('{"x":false}')]
    v = F.parse_json(F.get(F.array(*texts), k.cast("int")))
    return evidence(spark, sf).select("evidence_id", js_number(v, "x").alias("number"), F.when(k == 7, "n").otherwise(js_text(v, "x")).alias("text"))


@query(f"""SELECT event_id, least(100.0, greatest(0.0, date_diff('microsecond', TIMESTAMP '2024-01-15 12:00:00', ts) / 1e6 * 100.0 / 5400.0)) AS percent,
  CAST(greatest(0, floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_TEXT}') / 1e6 + 0.5)) AS BIGINT) AS lag_seconds
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16'""")
def timeline_positions(spark: SparkSession, sf: str) -> DataFrame:
    from mobilis.functions.time import span_percent

    day = table(spark, sf, "events").where("ts BETWEEN timestamp_ntz'2024-01-15' AND timestamp_ntz'2024-01-16'")
    return day.select("event_id", span_percent(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 5400).alias("percent"), lag_seconds(F.col("ts"), as_of()).alias("lag_seconds"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 500")
def keyset_audit_page(spark: SparkSession, sf: str) -> DataFrame:
    return views.keyset_page(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_id", 300, 9999)


@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, event_type, user_id, rn, ts AS since, false AS replayed FROM c WHERE rn = 1
  UNION ALL SELECT c.event_id, c.event_type, c.user_id, c.rn, CASE WHEN c.ts < f.since + INTERVAL 24 HOUR THEN f.since ELSE c.ts END, c.ts < f.since + INTERVAL 24 HOUR FROM f JOIN c ON c.event_type = f.event_type AND c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT event_id AS command_id, replayed FROM f""")
def idempotent_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Commands that are answered from memory: their key was applied within a day before."""
    from mobilis.operators.lifecycle import once

    commands = table(spark, sf, "events").select(F.col("event_id").alias("command_id"), "event_type", "user_id", "ts")
    return once(commands, ["event_type", "user_id"], "ts").select("command_id", "replayed")


@query(f"""WITH {SOURCES_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT s.connector_code, l.event_id AS run_id, l.ts AS started_at, CASE WHEN NOT configured THEN 'permission_required' WHEN l.event_id IS NULL THEN 'waiting' ELSE 'connected' END AS status
FROM src s LEFT JOIN last l ON l.event_type = s.connector_code AND rn = 1""")
def lateral_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    last = ev_ops.latest_per(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.asc("event_id")])
    met = sources(spark).join(last, F.col("connector_code") == F.col("event_type"), "left")
    status = F.when(~F.col("configured"), "permission_required").when(F.col("event_id").isNull(), "waiting").otherwise("connected")
    return met.select("connector_code", F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), status.alias("status"))


@query("""WITH rules(pack, rule, connector, active) AS (VALUES ('road', 'r1', 'click', true), ('road', 'r2', 'error', true), ('game', 'r1', 'click', false), ('game', 'r3', 'view', true)),
packs(pack) AS (VALUES ('road'), ('game'), ('cyber')), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT p.pack, count(rule) FILTER (active) AS n_active, coalesce(CAST(sum(n) FILTER (active) AS BIGINT), 0) AS n_events FROM packs p LEFT JOIN rules r ON r.pack = p.pack LEFT JOIN n ON n.event_type = r.connector GROUP BY p.pack""")
def pack_rule_filtered_count(spark: SparkSession, sf: str) -> DataFrame:
    bound = spark.createDataFrame([("road", "r1", "click", True), ("road", "r2", "error", True), ("game", "r1", "click", False), ("game", "r3", "view", True)], "pack string, rule string, connector string, active boolean")
    packs = spark.createDataFrame([("road",), ("game",), ("cyber",)], "pack string")
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("connector")).agg(F.count(F.lit(1)).alias("n"))
    met = packs.join(bound, "pack", "left").join(n, "connector", "left")
    return met.groupBy("pack").agg(F.count_if("active").alias("n_active"), F.coalesce(F.sum(F.when(F.col("active"), F.col("n"))), F.lit(0)).alias("n_events"))
