"""A detection pass from evidence to commitments, on rows small enough to read."""

import json

import pytest
from pyspark.sql import functions as F

from mobilis.operators import desks, detection, graph, lifecycle
from mobilis.sources import seeds

NOW = "2026-09-12 18:00:00"
ROWS = [
    ("e1", "aldot-algo-traffic-v1", "event:1", "2026-09-12 17:00:00", {"layer": "traffic_event", "eventType": "Crash", "algoEventId": 1}),
    ("e2", "aldot-algo-traffic-v1", "event:1", "2026-09-12 17:30:00", {"layer": "traffic_event", "eventType": "Crash", "algoEventId": 1}),
    ("e3", "aldot-algo-traffic-v1", "tt:1", "2026-09-12 17:30:00", {"layer": "travel_time", "congestionLevel": "Severe", "algoTravelTimeId": 4}),
    ("e4", "aldot-algo-traffic-v1", "tt:2", "2026-09-12 17:30:00", {"layer": "travel_time", "congestionLevel": "Unknown", "algoTravelTimeId": 5}),
    ("e5", "coa-road-closures-v1", "closure:a", "2026-09-12 17:00:00", {"kind": "closure", "startsAt": 1789232400000, "endsAt": None}),
    ("e6", "coa-road-closures-v1", "closure:b", "2026-09-12 17:00:00", {"kind": "closure", "startsAt": 1789322400000}),
    ("e7", "tomtom-traffic-flow-v1", "flow:1", "2026-09-12 17:00:00", {"pointCode": "p", "currentSpeedMph": None, "freeFlowSpeedMph": 60, "confidence": 0.9}),
    ("e8", "tomtom-traffic-flow-v1", "flow:2", "2026-09-12 17:00:00", {"pointCode": "q", "currentSpeedMph": 10, "freeFlowSpeedMph": 60, "confidence": None}),
    ("e9", "tomtom-traffic-flow-v1", "flow:3", "2026-09-12 17:00:00", {"pointCode": "r", "currentSpeedMph": 59, "freeFlowSpeedMph": 60, "roadClosure": True}),
    ("e10", "nws-weather-alerts-v1", "alert:1", "2026-09-12 17:00:00", {"alertId": "A", "severity": "Extreme"}),
    ("e11", "siem-alerts-v1", "s:1", "2026-09-12 17:00:00", {"severity": "CRITICAL", "alertId": 7}),
]


@pytest.fixture(scope="module")
def evidence(spark):
    rows = [(i, c, s, at, "h" + i, json.dumps(a)) for i, c, s, at, a in ROWS]
    df = spark.createDataFrame(rows, "evidence_id string, connector_code string, source_event_id string, observed_at string, content_hash string, json string")
    return df.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")).withColumn("attributes", F.parse_json("json"))


def matches(spark, evidence, pack):
    rules = seeds.rules(spark, pack).select("rule_code", "connector_code", "severity")
    return {r["external_key"]: r for r in detection.collapse(detection.hits(rules, evidence, F.lit(NOW).cast("timestamp_ntz"))).collect()}


def test_road_pack(spark, evidence):
    found = matches(spark, evidence, "road_closure")
    assert set(found) == {"algo-event:1", "algo-corridor:4", "city-closure:closure:a", "tomtom-point:p", "tomtom-point:r", "nws-alert:A"}
    crash = found["algo-event:1"]
    assert (crash["primary_id"], crash["n_evidence"], crash["severity"]) == ("e2", 2, "high")
    assert found["algo-corridor:4"]["severity"] == "high"
    assert found["nws-alert:A"]["severity"] == "critical"


def test_rules_speak_only_for_their_connector(spark, evidence):
    assert set(matches(spark, evidence, "cyber_incident")) == {"siem-alert:7"}


def test_match_order_and_unknown_rules(spark, evidence):
    rules = seeds.rules(spark, "road_closure").select("rule_code", "connector_code", "severity")
    order = [r["severity"] for r in detection.ranked(detection.collapse(detection.hits(rules, evidence, F.lit(NOW).cast("timestamp_ntz")))).collect()]
    assert order == ["critical", "high", "high", "high", "medium", "medium"]  # a closure is high
    assert detection.unknown_rules(seeds.rules(spark)).count() == 0


def test_every_rule_of_a_pack_reads_a_connector_of_it(spark):
    listed = seeds.packs(spark).select("pack_code", F.explode("connectors").alias("connector_code"))
    assert seeds.rules(spark).join(listed, ["pack_code", "connector_code"], "left_anti").count() == 0
    assert seeds.permissions(spark).count() == 13


def test_commitments_skip_unknown_agencies(spark):
    agencies = spark.createDataFrame([("city-traffic",)], "agency_code string")
    planned = lifecycle.planned_commitments(seeds.rules(spark, "sec_gameday"), agencies, F.lit(NOW).cast("timestamp_ntz")).collect()
    assert {(r["rule_code"], r["agency_code"]) for r in planned} == {(r, "city-traffic") for r in ("algo-crash", "algo-incident", "city-restriction-in-effect", "nws-alert-active")}
    assert min(str(r["due_at"]) for r in planned) == "2026-09-12 18:45:00"


def test_desks_without_a_feed_abstain_for_another_reason(spark, evidence):
    seen = desks.visible(evidence, seeds.permissions(spark))
    staffed = spark.createDataFrame([("atlas",), ("aqua",), ("sentinel",)], "desk_code string")
    stance = {r["desk_code"]: r["stance"] for r in desks.assessed(seen, F.col("connector_code").like("aldot%"), staffed, F.lit(0.5), F.lit(False)).collect()}
    assert stance == {"atlas": "contributed", "aqua": "no_feed", "sentinel": "abstained"}


def test_a_new_label_is_no_change_of_a_node(spark):
    kind = "node_id string, state string, geometry string, quality_flags array<string>, active boolean, valid_until timestamp_ntz, label string"
    old = spark.createDataFrame([("a", "1", None, [], True, None, "x"), ("b", "1", None, [], True, None, "x"), ("d", "1", None, [], True, None, "x")], kind).withColumn("version", F.lit(3).cast("long"))
    new = spark.createDataFrame([("a", "1", None, [], True, None, "y"), ("b", "1", None, ["stale"], True, None, "y"), ("c", "1", None, [], True, None, "y")], kind)
    got = {r["node_id"]: (r["change"], r["label"], r["version"]) for r in graph.merged(old, new, "node_id").collect()}
    assert got == {"a": ("unchanged", "x", 3), "b": ("updated", "y", 4), "c": ("created", "y", 1), "d": ("untouched", "x", 3)}


def test_neighbours_are_counted_once_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node_id string")
    assert {tuple(r) for r in graph.neighborhood(edges, start, 4).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    walks = {"".join(r["path"]) for r in graph.impact(edges, start).collect()}
    assert walks == {"ab", "abc", "abcd"}
