"""Feeds: raw payloads to canonical observations, and on to rules."""

import json

import pytest
from pyspark.sql import functions as F

from mobilis.operators import detection
from mobilis.sources import canonical, feeds

NOW = "2026-09-12T18:00:00Z"


@pytest.fixture(scope="module")
def now():
    return F.lit(NOW).cast("timestamp")


def records(spark, *items):
    lines = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in items], "payload string")
    return canonical.parsed(lines)[0]


def seen(df):
    return {r["source_event_id"]: r for r in df.collect()}


def attributes(row):
    return json.loads(row["attributes"])


def test_lines_that_are_no_json_are_set_aside(spark):
    lines = spark.createDataFrame([("{}",), ("{broken",), (None,)], "payload string")
    good, bad = canonical.parsed(lines)
    assert (good.count(), bad.count()) == (1, 2)


def test_closures(spark, now):
    day = 86_400_000
    at = 1789236000000  # the instant of the fetch
    features = records(
        spark,
        {"properties": {"globalid": "a", "street": "Main", "description": "Works", "starttime": at - day, "endtime": at + day}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"properties": {"globalid": "b", "starttime": at - 300 * day, "endtime": at - 200 * day}},
        {"properties": {"globalid": "c", "starttime": at + 60 * day}},
        {"properties": {"globalid": "d", "starttime": None, "endtime": None, "reason": "Festival"}},
        {"properties": {"globalid": "e", "starttime": at + 2 * day}},
    )
    found = seen(feeds.closures({"closure": features}, now))
    assert set(found) == {"closure:a", "closure:d", "closure:e"}
    assert found["closure:a"]["summary"] == "Closure: Main — Works"
    assert json.loads(found["closure:a"]["geometry"]) == {"coordinates": [1, 2], "type": "Point"}
    assert found["closure:d"]["summary"] == "Closure: Unnamed road — Festival"
    assert found["closure:d"]["quality_flags"] == ["active_public_record", "schedule_not_structured"]
    assert found["closure:e"]["quality_flags"] == ["scheduled_within_24_hours"]
    assert attributes(found["closure:d"])["startsAt"] is None


def test_traffic(spark, now):
    inside, outside = {"latitude": 32.6, "longitude": -85.5}, {"latitude": 40.0, "longitude": -85.5, "city": "Elsewhere"}
    events = records(
        spark,
        {"id": 1, "type": "Crash", "title": "Crash on route", "startLocation": inside, "lastUpdatedAt": "2026-09-12T17:00:00Z"},
        {"id": 2, "type": "Roadwork", "startLocation": outside, "endLocation": {"city": "OPELIKA", "displayRouteDesignator": "I-85"}},
        {"id": 3, "type": "Crash", "startLocation": inside, "active": False},
        {"id": 4, "type": "Crash", "startLocation": outside},
    )
    times = records(spark, {"id": 7, "name": "Exit 51 east", "averageSpeedMph": 31, "congestionLevel": "Heavy"}, {"id": 8, "name": "Far away"})
    signs = records(spark, {"id": 9, "location": {"county": "Lee", "direction": "North"}, "pages": [{"lines": [{"text": "SLOW"}, {"text": None}, {"text": "AHEAD"}]}, {"lines": []}]})
    found = seen(feeds.traffic(events, times, signs, now))
    assert set(found) == {"event:Crash:1", "event:Roadwork:2", "travel-time:7", "sign:9"}
    assert found["event:Crash:1"]["quality_flags"] == ["algo_traveler_event", "official_incident"]
    assert found["event:Roadwork:2"]["summary"] == "Roadwork: Traveler event — I-85"
    assert found["travel-time:7"]["summary"] == "Exit 51 east: 31 mph, unknown min (Heavy)"
    assert attributes(found["sign:9"])["pages"] == ["SLOW / AHEAD"]
    assert found["sign:9"]["summary"] == "Message sign North : SLOW / AHEAD"
    counts = {(r["kind"], r["n"]) for r in canonical.records_by_kind(feeds.traffic(events, times, signs, now)).collect()}
    assert counts == {("event", 2), ("travel-time", 1), ("sign", 1)}


def alert(**changes):
    p = {"id": "urn:1", "status": "Actual", "messageType": "Alert", "event": "Tornado Warning", "severity": "Extreme", "expires": "2026-09-12T19:00:00Z", "geocode": {"UGC": ["ALC081"]}, "parameters": {"VTEC": ["/O.NEW.KBMX.TO.W.0012.260912T1700Z-260912T1900Z/"]}}
    return {"properties": p | changes}


def test_alerts_and_overlay(spark, now):
    features = records(spark, alert(), alert(status="Test", id="urn:2"), alert(messageType="Cancel"), alert(expires="2026-09-12T17:59:00Z"), alert(geocode={"UGC": ["XX"]}), alert(id="urn:9", parameters={}, expires=None, severity=None))
    found = seen(feeds.alerts(features, now))
    assert set(found) == {"alert:KBMX.TO.W.0012.26", "alert:urn:9"}
    assert attributes(found["alert:urn:9"])["severity"] == "Unknown"
    assert found["alert:KBMX.TO.W.0012.26"]["quality_flags"] == ["nws_alert", "severe_or_extreme"]
    assert {r["geometry_source"] for r in feeds.alert_overlay(features, now).collect()} == {"operating-box"}


def test_forecast_counts_a_null_chance_as_zero(spark, now):
    period = lambda t, unit, rain, text: {"startTime": NOW, "temperature": t, "temperatureUnit": unit, "probabilityOfPrecipitation": rain, "shortForecast": text}
    grid = {"gridCode": "B/1,2", "periods": [period(80, "F", {"value": None}, "Sunny"), period(99, "C", {"value": 40}, "Thunderstorms"), period(84, "F", None, None)]}
    (row,) = feeds.forecast(records(spark, grid, {"gridCode": "C", "periods": []}), now).collect()
    a = attributes(row)
    assert (a["maxTemperatureF"], a["maxPrecipitationProbability"], a["thunderstormHours"]) == (84, 40, 1)
    assert row["summary"] == "Next 3h: Sunny, up to 84F, 40% precipitation"


def series(site, parameter, *points):
    return {"sourceInfo": {"siteName": f"Creek {site}", "siteCode": [{"value": site}], "geoLocation": {"geogLocation": {"latitude": 32.5, "longitude": -85.4}}}, "variable": {"variableCode": [{"value": parameter}]}, "values": [{"value": [{"dateTime": t, "value": v} for t, v in points]}]}


def test_gauges(spark, now):
    table = records(
        spark,
        series("1", "00065", ("2026-09-12T12:00:00Z", "1.0"), ("2026-09-12T15:30:00Z", "2.5"), ("2026-09-12T18:00:00Z", "5.005"), ("2026-09-12T17:00:00Z", "-999999")),
        series("1", "00060", ("2026-09-12T18:10:00Z", "77")),
        series("2", "00065", ("2026-09-12T18:00:00Z", "3.0")),
        series("3", "00065", ("2026-09-12T18:00:00Z", "-999999")),
    )
    found = seen(feeds.gauges(table, now))
    assert set(found) == {"gauge:1", "gauge:2"}
    one, two = attributes(found["gauge:1"]), attributes(found["gauge:2"])
    assert (one["gageHeightFt"], one["dischargeCfs"]) == (5.005, 77.0)
    assert one["riseFt"] == pytest.approx(2.505, abs=0.006)
    assert two["riseFt"] is None
    assert found["gauge:1"]["quality_flags"] == ["usgs_provisional", "stage_rising"]
    assert found["gauge:2"]["summary"] == "Creek 2: 3.0 ft stage"


def test_quakes(spark, now):
    found = seen(feeds.quakes(records(spark, {"id": "q1", "properties": {"type": "earthquake", "mag": 4.2, "place": "X", "time": 1789232400000}, "geometry": {"coordinates": [-85.49, 32.6025, 7]}}, {"id": "q2", "properties": {"type": "quarry blast"}}, {"properties": {"type": "earthquake"}}), now))
    assert set(found) == {"quake:q1"}
    assert attributes(found["quake:q1"])["distanceKm"] == 0
    assert found["quake:q1"]["summary"] == "M 4.2 earthquake near X"


def test_transit(spark, now):
    bus = lambda n, at, serving, lat=32.6: {"equipmentID": n, "routeID": 5 if n == "1" else 6, "lat": lat, "lng": -85.4, "inService": serving, "receiveTime": at}
    vehicles = records(spark, bus("1", "2026-09-12T17:59:30Z", 1), bus("2", "2026-09-12T17:52:00Z", 0), bus("3", "2026-09-12T17:00:00Z", 0), bus("4", NOW, 1, None))
    found = {r["summary"]: r for r in feeds.transit(vehicles, records(spark, {"id": 5, "name": "Gold"}), now).collect()}
    assert set(found) == {"Gold: vehicle 1 in service", "Route 6: vehicle 2 not in service"}
    assert found["Route 6: vehicle 2 not in service"]["quality_flags"] == ["stale", "outside_freshness_window"]


def test_probe_flow_and_the_rule_over_it(spark, now):
    place = {"code": "p1", "name": "Exit", "lat": 32.5, "lon": -85.5}
    slow = place | {"flow": {"currentSpeed": 20, "freeFlowSpeed": 60, "confidence": 0.9}}
    unsure = place | {"code": "p2", "flow": {"currentSpeed": 20, "freeFlowSpeed": 60, "confidence": 0.5}}
    silent = place | {"code": "p3", "flow": {"freeFlowSpeed": 60, "confidence": 0.9}}
    observed = feeds.probe_flow(records(spark, slow, unsure, silent, place | {"code": "p4"}), now)
    found = seen(observed)
    assert set(found) == {f"flow:p{k}:2026-09-12T18:00" for k in (1, 2, 3)}
    assert found["flow:p1:2026-09-12T18:00"]["summary"] == "Exit: 20 mph (33% of free flow)"
    rules = spark.createDataFrame([("tomtom-corridor-degraded", "tomtom-traffic-flow-v1", "medium")], "rule_code string, connector_code string, severity string")
    hits = detection.hits(rules, canonical.for_detection(observed), now).collect()
    # a speed that is null counts as standing still
    assert {r["external_key"] for r in hits} == {"tomtom-point:p1", "tomtom-point:p3"}


def test_reference_data(spark, now):
    station = lambda k, **a: {"attributes": {"Station": k, "IsActive": 1, "Location": "North of Auburn", "YearAADT": 2024, "AADT": 900} | a}
    found = seen(feeds.count_stations(records(spark, station("1", RouteID="US 29"), station("2", IsActive=0), station("3", Location="Mobile")), now))
    assert {k: r["summary"] for k, r in found.items()} == {"station:1:2024": "US 29 station 1: 900 AADT (2024)"}
    lamp = lambda x, y, **p: {"geometry": {"coordinates": [x, y]}, "properties": p}
    layer = feeds.reference_layer(records(spark, lamp(-85.5, 32.6, name="A", owner=None), lamp(0, 0, name="B")), ["name", "owner"]).collect()
    assert [r["fields"] for r in layer] == [{"name": "A"}]
    ways = feeds.road_ways(records(spark, {"type": "way", "id": 1, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 3}], "tags": {"ref": "US 29"}}, {"type": "way", "id": 2, "geometry": [{"lat": 1, "lon": 2}]}, {"type": "way", "id": 3, "geometry": [{"lat": 1, "lon": 2}, {"lat": 2, "lon": 2}]})).collect()
    assert {(r["way_id"], r["keeper"]) for r in ways} == {("1", "state"), ("3", "city")}


def test_a_payload_is_parsed_once_whatever_reads_it(spark):
    lines = spark.createDataFrame([('{"id":1,"name":"Exit 51","averageSpeedMph":30}',), ("no json",), (None,)], "payload string")
    records, broken = canonical.parsed(lines)
    found = feeds.travel_times(records, F.lit("2024-01-31T00:00:00Z").cast("timestamp")).select("source_event_id", "summary", "quality_flags")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [r.source_event_id for r in found.collect()] == ["travel-time:1"] and broken.count() == 2
