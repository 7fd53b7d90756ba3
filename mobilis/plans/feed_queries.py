"""Queries of the feeds: payloads made from events, read by each normaliser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators import detection
from mobilis.plans.common import AS_OF_TEXT, EV, as_of, catalogue, evidence, table
from mobilis.sources import canonical, feeds, seeds

Q, SQL, query = catalogue()

EVENTS = "e AS (SELECT event_id AS id, user_id AS u, CAST(props->>'$.k' AS BIGINT) AS k, ts, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS ms FROM events)"


def _now() -> Column:
    return F.lit(AS_OF_TEXT + "Z").cast("timestamp")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    )


def _payloads(spark: SparkSession, sf: str, *parts: str | Column) -> DataFrame:
    """Records with ``v`` from pieces of JSON text and columns."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return canonical.parsed(_events(spark, sf).select(text.alias("payload")))[0]


def _columns() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("k", "u", "id", "ms", "cents"))


def _shown(found: DataFrame, *attributes: str) -> DataFrame:
    """Identity, summary, flags and some attributes of observations, as text."""
    more = [F.get_json_object("attributes", f"$.{a}").alias(a) for a in attributes]
    return found.select("source_event_id", "summary", F.array_join("quality_flags", ",").alias("flags"), *more)


@query(f"""WITH {EVENTS} SELECT 'quake:q' || id AS source_event_id, CASE WHEN k % 3 = 0 THEN 'Felt near P' || u ELSE 'M ' || k % 8 || ' earthquake near ' || CASE WHEN k % 3 = 1 THEN 'P' || u ELSE 'the region' END END AS summary,
  CASE WHEN k % 2 = 0 THEN 'usgs_reviewed' ELSE 'usgs_automatic' END AS flags, date_trunc('millisecond', ts) AS observed_at FROM e WHERE k % 4 <> 0 AND k % 7 <> 6""")
def feed_quakes(spark: SparkSession, sf: str) -> DataFrame:
    k, u, id, ms, _ = _columns()
    made = _payloads(
        spark, sf, '{"id":"', F.when(k % 7 != 6, F.concat(F.lit("q"), id)).otherwise(""), '","properties":{"type":"', F.when(k % 4 == 0, "quarry blast").otherwise("earthquake"), '","mag":', k % 8, ',"time":', ms,
        ',"title":', F.when(k % 3 == 0, F.concat(F.lit('"Felt near P'), u, F.lit('"'))), ',"place":', F.when(k % 3 == 1, F.concat(F.lit('"P'), u, F.lit('"'))), ',"status":"', F.when(k % 2 == 0, "reviewed").otherwise("automatic"), '"},"geometry":{"coordinates":[-85.5,32.6,', k, "]}}",
    )
    found = feeds.quakes(made, _now())
    return _shown(found).join(found.select("source_event_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at")), "source_event_id")


@query(f"""WITH {EVENTS} SELECT 'alert:a' || id AS source_event_id, 'Flood ' || k || ': ' || CASE WHEN k % 2 = 0 THEN 'River ' || u ELSE 'Lee County' END AS summary, CASE WHEN k % 3 = 0 THEN 'nws_alert,severe_or_extreme' ELSE 'nws_alert' END AS flags,
  CASE k % 3 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Minor' ELSE 'Unknown' END AS severity FROM e
WHERE k % 5 <> 0 AND k % 7 <> 1 AND k % 4 <> 2 AND (k % 6 = 5 OR date_trunc('second', ts + to_hours(CAST(k AS INTEGER))) >= TIMESTAMP '{AS_OF_TEXT}')""")
def feed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    k, u, id, _, _ = _columns()
    expires = F.concat(F.lit('"'), F.date_format(F.col("ts") + F.make_dt_interval(hours=k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    made = _payloads(
        spark, sf, '{"properties":{"id":"a', id, '","status":"', F.when(k % 5 == 0, "Test").otherwise("Actual"), '","messageType":"', F.when(k % 7 == 1, "Cancel").otherwise("Update"), '","event":"Flood ', k, '","geocode":{"UGC":["XXX001","',
        F.when(k % 4 == 2, "ALC001").otherwise("ALC081"), '"]},"severity":', F.when(k % 3 == 0, '"Severe"').when(k % 3 == 1, '"Minor"'), ',"headline":', F.when(k % 2 == 0, F.concat(F.lit('"River '), u, F.lit('"'))), ',"areaDesc":"Lee County","expires":', F.when(k % 6 != 5, expires), "}}",
    )
    return _shown(feeds.alerts(made, _now()), "severity")


@query(f"""WITH {EVENTS}, a AS (SELECT *, greatest(0, date_diff('millisecond', make_timestamp(ms * 1000), TIMESTAMP '{AS_OF_TEXT}') / 1000) AS age FROM e)
SELECT 'vehicle:' || u || ':' || ms AS source_event_id, coalesce(r_name, 'Route ' || k % 7) || ': vehicle ' || u || CASE WHEN k % 2 = 1 THEN ' in service' ELSE ' not in service' END AS summary,
  CASE WHEN age > 180 THEN 'stale,outside_freshness_window' WHEN age > 90 THEN 'delayed' ELSE '' END AS flags FROM a LEFT JOIN region ON r_regionkey = k % 7 WHERE k % 11 <> 0 AND (k % 2 = 1 OR age <= 600)""")
def feed_transit(spark: SparkSession, sf: str) -> DataFrame:
    k, u, _, ms, _ = _columns()
    made = _payloads(spark, sf, '{"equipmentID":"', u, '","routeID":', k % 7, ',"lat":', F.when(k % 11 != 0, F.lit("32.6")), ',"lng":-85.5,"inService":', k % 2, ',"receiveTime":', ms, ',"load":', k, "}")
    regions = table(spark, sf, "region").select(F.concat(F.lit('{"id":'), "r_regionkey", F.lit(',"name":"'), "r_name", F.lit('"}')).alias("payload"))
    return _shown(feeds.transit(made, canonical.parsed(regions)[0], _now()))


@query(f"""WITH {EVENTS} SELECT 'flow:p' || id || ':' || strftime(TIMESTAMP '{AS_OF_TEXT}', '%Y-%m-%dT%H:%M') AS source_event_id,
  'Point ' || u || ': ' || CASE WHEN k % 9 = 0 THEN 'unknown' ELSE CAST(k AS VARCHAR) END || ' mph' || CASE WHEN k % 9 <> 0 AND k <> 0 THEN ' (' || CAST(floor(k / 40 * 100 + 0.5) AS BIGINT) || '% of free flow)' ELSE '' END AS summary,
  CASE WHEN k < 70 THEN 'low_confidence' ELSE '' END AS flags, CASE WHEN k % 10 = 3 THEN 'true' ELSE 'false' END AS "roadClosure" FROM e WHERE k % 8 <> 7""")
def feed_probe_flow(spark: SparkSession, sf: str) -> DataFrame:
    k, u, id, _, _ = _columns()
    flow = F.concat(F.lit(',"flow":{"currentSpeed":'), F.when(k % 9 == 0, "null").otherwise(k.cast("string")), F.lit(',"freeFlowSpeed":40,"confidence":'), (k / 100).cast("string"), F.when(k % 10 == 3, ',"roadClosure":true}').otherwise("}"))
    made = _payloads(spark, sf, '{"code":"p', id, '","name":"Point ', u, '","lat":32.6,"lon":-85.4', F.when(k % 8 != 7, flow).otherwise(""), "}")
    return _shown(feeds.probe_flow(made, _now()), "roadClosure")


@query(f"""WITH {EVENTS}, t AS (SELECT *, TIMESTAMP '{AS_OF_TEXT}' + to_days(CAST(k * 3 - 200 AS INTEGER)) AS b, TIMESTAMP '{AS_OF_TEXT}' + to_days(CAST(k * 3 - 180 AS INTEGER)) AS f FROM e)
SELECT 'closure:g' || id AS source_event_id, 'Closure: ' || CASE WHEN k % 3 = 0 THEN 'Unnamed road' ELSE 'Street ' || u END || ' — ' || CASE WHEN k % 4 = 1 THEN 'Works' ELSE 'No public description' END AS summary,
  CASE WHEN k % 5 = 0 THEN 'active_public_record,schedule_not_structured' WHEN b > TIMESTAMP '{AS_OF_TEXT}' THEN 'scheduled_within_24_hours' ELSE 'active_public_record' END AS flags FROM t
WHERE k % 5 = 0 OR (f >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 120 DAY AND b <= TIMESTAMP '{AS_OF_TEXT}' + INTERVAL 45 DAY)""")
def feed_closures(spark: SparkSession, sf: str) -> DataFrame:
    k, u, id, _, _ = _columns()
    now = F.unix_millis(_now())
    day = 86_400_000
    timed = F.when(k % 5 != 0, F.concat(F.lit(',"starttime":'), now + (k * 3 - 200) * day, F.lit(',"EndTime":'), now + (k * 3 - 180) * day)).otherwise(',"starttime":null')
    made = _payloads(spark, sf, '{"properties":{"GlobalID":"g', id, '","StreetName":', F.when(k % 3 != 0, F.concat(F.lit('"Street '), u, F.lit('"'))), ',"Reason":', F.when(k % 4 == 1, '"Works"'), timed, "}}")
    return _shown(feeds.closures({"closure": made}, _now()))


@query(f"""WITH {EVENTS} SELECT 'event:' || CASE k % 3 WHEN 0 THEN 'Crash' WHEN 1 THEN 'Roadwork' ELSE 'unknown' END || ':' || id AS source_event_id,
  CASE k % 3 WHEN 0 THEN 'Crash' WHEN 1 THEN 'Roadwork' ELSE 'Event' END || ': Delay ' || u || ' — ' || CASE WHEN k % 4 = 0 THEN 'near mile ' || k WHEN k % 4 = 1 THEN 'I-85' ELSE 'Unspecified route' END AS summary,
  CASE WHEN k % 3 = 0 THEN 'algo_traveler_event,official_incident' ELSE 'algo_traveler_event,published_roadwork' END AS flags, CASE WHEN k % 10 < 3 THEN 'Auburn' END AS city
FROM e WHERE k % 6 <> 5 AND (k % 10 < 3 OR k % 10 BETWEEN 5 AND 6)""")
def feed_traffic_events(spark: SparkSession, sf: str) -> DataFrame:
    """Ends inside by the name of the city, or by coordinates; inactive events drop out."""
    k, u, id, _, _ = _columns()
    route = F.when(k % 4 == 1, F.lit(',"displayRouteDesignator":"I-85"')).otherwise("")
    made = _payloads(
        spark, sf, '{"id":', id, ',"type":', F.when(k % 3 == 0, '"Crash"').when(k % 3 == 1, '"Roadwork"'), ',"active":', F.when(k % 6 == 5, "false").when(k % 6 == 4, "true"), ',"title":"Delay ', u, '","subTitle":"', F.when(k % 4 == 0, F.concat(F.lit("near mile "), k)).otherwise(""),
        '","startLocation":{"city":', F.when(k % 10 < 3, '"Auburn"').otherwise("null"), route, '},"endLocation":{"latitude":', F.when(F.expr("k % 10 BETWEEN 5 AND 6"), "32.6").otherwise("40.0"), ',"longitude":-85.5', route, "}}",
    )
    return _shown(feeds.traffic_events(made, _now()), "city")


@query(f"""WITH {EVENTS} SELECT 'travel-time:' || id AS source_event_id, 'Exit ' || k || ': ' || CASE WHEN k % 4 = 0 THEN 'unknown' ELSE CAST(k % 70 AS VARCHAR) END || ' mph, ' || u || ' min (' || CASE k % 3 WHEN 0 THEN 'Heavy' WHEN 1 THEN 'Unaffected' ELSE 'unknown' END || ')' AS summary,
  CASE WHEN k % 3 = 0 THEN 'algo_travel_time,congestion_reported' ELSE 'algo_travel_time' END AS flags FROM e WHERE k = 51 OR k % 5 = 0""")
def feed_travel_times(spark: SparkSession, sf: str) -> DataFrame:
    """Kept where the name or an end mentions the corridor, in any case."""
    k, u, id, _, _ = _columns()
    made = _payloads(
        spark, sf, '{"id":', id, ',"name":"Exit ', k, '","origin":{"name":', F.when(k % 5 == 0, '"OPELIKA east"'), '},"averageSpeedMph":', F.when(k % 4 != 0, k % 70), ',"estimatedTimeMinutes":', u, ',"congestionLevel":', F.when(k % 3 == 0, '"Heavy"').when(k % 3 == 1, '"Unaffected"'), "}",
    )
    return _shown(feeds.travel_times(made, _now()))


@query(f"""WITH {EVENTS} SELECT 'station:s' || id || ':' || CASE WHEN k % 2 = 0 THEN '2023' ELSE 'unknown' END AS source_event_id, 'R' || u || ' station s' || id || ': ' || CASE WHEN k % 3 = 0 THEN 'unavailable' ELSE CAST(cents AS VARCHAR) END || ' AADT (' || CASE WHEN k % 2 = 0 THEN '2023' ELSE 'unknown' END || ')' AS summary,
  'reference_data,not_live_traffic' AS flags FROM e WHERE k % 4 <> 1 AND k % 5 <> 2""")
def feed_count_stations(spark: SparkSession, sf: str) -> DataFrame:
    k, u, id, _, cents = _columns()
    made = _payloads(
        spark, sf, '{"attributes":{"Station":"s', id, '","IsActive":', F.when(k % 4 == 1, "0").otherwise("1"), ',"Location":"', F.when(k % 5 == 2, "Opelika").otherwise("near Auburn"), '","RouteID":"R', u, '","YearAADT":', F.when(k % 2 == 0, "2023"), ',"AADT":', F.when(k % 3 != 0, cents), "}}",
    )
    return _shown(feeds.count_stations(made, _now()))


# ---- rules that the other rule queries have no rows for -----------------------

MORE_RULES = [("algo-roadwork", "click", "low"), ("algo-corridor-congestion", "error", "medium"), ("city-restriction-in-effect", "purchase", "medium"), ("siem-critical-alert", "signup", "high")]


@query(f"""WITH {EV}, n AS (SELECT *, split_part(source_event_id, ':', 2) AS who FROM ev)
SELECT evidence_id, 'algo-roadwork' AS rule_code, 'algo-event:' || who AS external_key, 'low' AS severity FROM n WHERE connector_code = 'click' AND k % 3 = 1
UNION ALL SELECT evidence_id, 'algo-corridor-congestion', 'algo-corridor:' || who, CASE k % 5 WHEN 0 THEN 'high' ELSE 'medium' END FROM n WHERE connector_code = 'error' AND k % 5 < 2
UNION ALL SELECT evidence_id, 'city-restriction-in-effect', 'city-closure:' || source_event_id, 'medium' FROM n WHERE connector_code = 'purchase' AND k % 4 <> 0 AND (k % 3 = 0 OR TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)) <= TIMESTAMP '{AS_OF_TEXT}') AND (k % 5 = 0 OR TIMESTAMP '2024-01-15' + to_days(CAST(k AS INTEGER)) >= TIMESTAMP '{AS_OF_TEXT}')
UNION ALL SELECT evidence_id, 'siem-critical-alert', 'siem-alert:' || who, 'critical' FROM n WHERE connector_code = 'signup' AND k % 4 = 0""")
def rule_hits_of_more_rules(spark: SparkSession, sf: str) -> DataFrame:
    ev = evidence(spark, sf)
    k, c, who = F.col("k"), F.col("connector_code"), F.element_at(F.split("source_event_id", ":"), -1)

    def at(day: str) -> Column:
        return F.concat(F.lit('"'), F.date_format(F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(days=k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))

    json = (
        F.when(c == "click", F.concat(F.lit('{"layer":"traffic_event","eventType":"'), F.when(k % 3 == 1, "Roadwork").otherwise("Crash"), F.lit('","algoEventId":'), who, F.lit("}")))
        .when(c == "error", F.concat(F.lit('{"layer":"travel_time","congestionLevel":'), F.when(k % 5 == 0, '"Severe"').when(k % 5 == 1, '"Moderate"').when(k % 5 == 2, '"Unknown"').when(k % 5 == 3, '""').otherwise("null"), F.lit(',"algoTravelTimeId":'), who, F.lit("}")))
        .when(c == "purchase", F.concat(F.lit('{"kind":"'), F.when(k % 4 != 0, "closure").otherwise(""), F.lit('","startsAt":'), F.when(k % 3 == 0, "null").otherwise(at("2024-01-01")), F.lit(',"endsAt":'), F.when(k % 5 == 0, '""').otherwise(at("2024-01-15")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"severity":"'), F.when(k % 4 == 0, "CRITICAL").when(k % 4 == 1, "High").otherwise("low"), F.lit('","alertId":"'), F.when(k % 2 == 0, who).otherwise(""), F.lit('"}')))
    )
    rules = spark.createDataFrame(MORE_RULES, "rule_code string, connector_code string, severity string")
    return detection.hits(rules, ev.withColumn("attributes", F.parse_json(json)), as_of()).select("evidence_id", "rule_code", "external_key", "severity")


# ---- feeds and rows that are read less often -------------------------------------------


@query(f"""WITH {EVENTS}, s AS (SELECT id, CASE WHEN k % 2 = 0 THEN 'North' ELSE '' END AS way, CASE k % 3 WHEN 0 THEN 'Slow / K' || k WHEN 1 THEN 'Two' ELSE 'no text' END AS said, CASE k % 3 WHEN 2 THEN 0 ELSE 1 END AS n FROM e WHERE k % 4 <> 1)
SELECT 'sign:' || id AS source_event_id, trim(regexp_replace('Message sign ' || way || ' Nowhere: ' || said, '\\s+', ' ', 'g')) AS summary, 'algo_message_sign' AS flags, CAST(n AS BIGINT) AS n_pages FROM s""")
def feed_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Message signs inside the area; blank lines and pages are left out."""
    found = feeds.message_signs(_signs(spark, sf), _now())
    pages = F.size(F.from_json(F.get_json_object("attributes", "$.pages"), "array<string>")).cast("long")
    return found.select("source_event_id", "summary", F.array_join("quality_flags", ",").alias("flags"), pages.alias("n_pages"))


def _signs(spark: SparkSession, sf: str) -> DataFrame:
    k, _, id, _, _ = _columns()
    return _payloads(
        spark, sf, '{"id":', id, ',"location":{"latitude":', F.when(k % 4 == 1, "40.0").otherwise("32.6"), ',"longitude":-85.5,"city":"Nowhere","direction":', F.when(k % 2 == 0, '"North"'), '},"pages":',
        F.when(k % 3 == 0, F.concat(F.lit('[{"lines":[{"text":"Slow"},{"text":""},{"text":"K'), k, F.lit('"}]}]'))).when(k % 3 == 1, '[{"lines":[{"text":""}]},{"lines":[{"text":"Two"}]}]'), "}",
    )


@query(f"""WITH {EVENTS} SELECT 'forecast:g' || id AS source_event_id, 'Next 2h: ' || CASE WHEN k % 3 = 0 THEN 'Thunderstorms' ELSE 'Sunny' END || ', up to ' || CASE WHEN k % 4 = 1 THEN 'unknown' ELSE CAST(k + 1 AS VARCHAR) END || 'F, ' || CASE WHEN k % 2 = 0 THEN k ELSE 0 END || '% precipitation' AS summary,
  'nws_gridded_forecast,operating_context' AS flags, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS VARCHAR) AS "thunderstormHours" FROM e WHERE k % 5 <> 0""")
def feed_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly grids as one observation each; an empty one gives none."""
    k, _, id, _, _ = _columns()

    def period(heat: Column) -> tuple[str | Column, ...]:
        return ('{"startTime":"2024-01-31T00:00:00Z","temperature":', heat, ',"temperatureUnit":"', F.when(k % 4 == 1, "C").otherwise("F"), '","probabilityOfPrecipitation":{"value":', F.when(k % 2 == 0, k), '},"shortForecast":"', F.when(k % 3 == 0, "Thunderstorms").otherwise("Sunny"), '"}')

    two = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in (*period(k), ",", *period(k + 1))])
    made = _payloads(spark, sf, '{"gridCode":"g', id, '","periods":[', F.when(k % 5 == 0, "").otherwise(two), "]}")
    return _shown(feeds.forecast(made, _now()), "thunderstormHours")


@query(f"""WITH {EVENTS}, r AS (SELECT u, CASE WHEN k % 2 = 0 THEN '00065' ELSE '00060' END AS p, ts, CASE WHEN k % 6 = 0 THEN -999999 ELSE cents / 100 END AS v, id FROM e), g AS (SELECT *, max(ts) OVER (PARTITION BY u, p) AS last_at FROM r WHERE v <> -999999),
s AS (SELECT u, arg_max(v, ts) FILTER (p = '00065') AS stage, arg_max(v, ts) FILTER (p = '00060') AS flow, arg_min(v, ts) FILTER (p = '00065' AND ts >= last_at - INTERVAL 3 HOUR) AS was, min(ts) FILTER (p = '00065' AND ts >= last_at - INTERVAL 3 HOUR) AS first_at, max(ts) FILTER (p = '00065') AS stage_at FROM g GROUP BY u)
SELECT 'gauge:' || u AS source_event_id, stage, flow, CASE WHEN first_at < stage_at THEN CAST(round(CAST(stage - was AS DECIMAL(18, 6)), 2) AS DOUBLE) END AS rise, CASE WHEN first_at < stage_at AND stage > was THEN 'usgs_provisional,stage_rising' ELSE 'usgs_provisional' END AS flags FROM s""")
def feed_gauges(spark: SparkSession, sf: str) -> DataFrame:
    """Stream gauges: last stage and flow, the rise of three hours; readings that stand for no data are left out."""
    k, u, _, _, cents = _columns()
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    made = _payloads(
        spark, sf, '{"sourceInfo":{"siteCode":[{"value":"', u, '"}],"siteName":"Creek","geoLocation":{"geogLocation":{"latitude":32.6,"longitude":-85.5}}},"variable":{"variableCode":[{"value":"', F.when(k % 2 == 0, "00065").otherwise("00060"),
        '"}]},"values":[{"value":[{"dateTime":"', at, '","value":"', F.when(k % 6 == 0, "-999999").otherwise((cents / 100).cast("string")), '"}]}]}',
    )
    found = feeds.gauges(made, _now())
    value = lambda n: F.get_json_object("attributes", f"$.{n}").cast("double")
    return found.select("source_event_id", value("gageHeightFt").alias("stage"), value("dischargeCfs").alias("flow"), value("riseFt").alias("rise"), F.array_join("quality_flags", ",").alias("flags"))


@query(f"""WITH {EVENTS} SELECT 'a' || id AS alert_id, CASE WHEN k % 2 = 0 THEN 'Flood ' || k ELSE 'Weather alert' END AS event_name, CASE WHEN k % 3 = 0 THEN 'Severe' ELSE 'Unknown' END AS severity, CASE WHEN k % 4 = 0 THEN 'published' ELSE 'operating-box' END AS geometry_source,
  k % 4 = 0 AS own FROM e WHERE k % 5 <> 0 AND k % 7 <> 1""")
def alert_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts in force as shapes of a map; one without a polygon gets that of the operating area."""
    k, _, id, _, _ = _columns()
    made = _payloads(
        spark, sf, '{"properties":{"id":"a', id, '","status":"', F.when(k % 5 == 0, "Test").otherwise("Actual"), '","messageType":"', F.when(k % 7 == 1, "Cancel").otherwise("Alert"), '","event":', F.when(k % 2 == 0, F.concat(F.lit('"Flood '), k, F.lit('"'))),
        ',"severity":', F.when(k % 3 == 0, '"Severe"'), ',"geocode":{"UGC":["', F.lit(feeds.ZONES[0]), '"]}},"geometry":', F.when(k % 4 == 0, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}').when(k % 4 == 1, '{"type":"Point","coordinates":[0,0]}'), "}",
    )
    found = feeds.alert_overlay(made, _now())
    own = F.get_json_object("geometry", "$.coordinates[0][1][0]") == "1"
    return found.select("alert_id", "event_name", "severity", "geometry_source", own.alias("own"))


@query(f"""WITH {EVENTS} SELECT 'message_sign' AS layer, count(*) AS n FROM e WHERE k % 4 <> 1 UNION ALL SELECT 'travel_time', count(*) FROM e WHERE k % 3 = 0 UNION ALL SELECT 'traffic_event', count(*) FROM e WHERE k % 2 = 0""")
def feed_of_three_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Events, travel times and signs as one feed, by layer."""
    k, _, id, _, _ = _columns()
    events = _payloads(spark, sf, '{"id":', id, ',"type":"Crash","startLocation":{"latitude":', F.when(k % 2 == 0, "32.6").otherwise("50"), ',"longitude":-85.5}}')
    times = _payloads(spark, sf, '{"id":', id, ',"name":"', F.when(k % 3 == 0, feeds.CORRIDOR_NAMES[0]).otherwise("elsewhere"), '"}')
    found = feeds.traffic(events, times, _signs(spark, sf), _now())
    return found.groupBy(F.get_json_object("attributes", "$.layer").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS} SELECT 'usgs-natural-hazards-v1#quake:q' || id AS evidence_id, 'usgs-quake:q' || id AS external_key, CASE WHEN k % 8 >= 5.5 THEN 'critical' ELSE 'high' END AS severity FROM e WHERE k % 4 <> 0 AND k % 8 >= 4""")
def rule_hits_of_a_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A feed's observations as evidence, judged by the rules of a pack."""
    k, _, id, ms, _ = _columns()
    made = _payloads(spark, sf, '{"id":"q', id, '","properties":{"type":"', F.when(k % 4 == 0, "quarry blast").otherwise("earthquake"), '","mag":', k % 8, ',"time":', ms, '},"geometry":{"coordinates":[-85.5,32.6,1]}}')
    rules = seeds.rules(spark, "severe_weather").select("rule_code", "connector_code", "severity")
    return detection.hits(rules, canonical.for_detection(feeds.quakes(made, _now())), as_of()).select("evidence_id", "external_key", "severity")


_FEED_OF = {"click": "aldot-algo-traffic-v1", "error": "tomtom-traffic-flow-v1", "purchase": "nws-weather-alerts-v1", "signup": "usgs-natural-hazards-v1", "view": "coa-road-closures-v1"}


@query(f"""WITH {EV}, m(connector_code, rule_code) AS (VALUES ('click', 'algo-crash'), ('click', 'algo-incident'), ('click', 'algo-corridor-congestion'), ('view', 'city-restriction-in-effect'), ('error', 'tomtom-corridor-degraded'), ('purchase', 'nws-alert-active'), ('signup', 'usgs-stream-rapid-rise'))
SELECT rule_code, count(*) AS n FROM ev JOIN m ON m.connector_code = ev.connector_code GROUP BY 1""")
def evidence_of_seeded_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How much evidence the rules of a seeded pack look at."""
    feed = F.create_map(*[F.lit(x) for pair in _FEED_OF.items() for x in pair])
    rows = evidence(spark, sf).select(F.element_at(feed, F.col("connector_code")).alias("connector_code"))
    return rows.groupBy("connector_code").agg(F.count(F.lit(1)).alias("n")).join(seeds.rules(spark, "road_closure"), "connector_code").select("rule_code", "n")
