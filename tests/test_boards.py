"""Cards, rows, requirements and records on rows small enough to read, nulls and empty tables among them."""

from datetime import datetime

from pyspark.sql import functions as F

from mobilis.operators import boards, lifecycle, records

T = datetime(2024, 1, 1, 9, 30)


def test_cards_of_a_desk_show_the_first_member_that_is_there(spark):
    rows = [("e1", "auburn-eta-spot-v1", "s", T, '{"routeName":"Loop","occupancyPct":0.5,"inService":true}'), ("e2", "auburn-parking-occupancy-v1", "s", T, '{"occupancy":null,"occupancyPct":7}'), ("e3", "coa-road-closures-v1", "s", T, "{}")]
    evidence = spark.createDataFrame(rows, "evidence_id string, connector_code string, summary string, observed_at timestamp_ntz, json string").withColumn("attributes", F.parse_json("json"))
    got = {r.evidence_id: r for r in boards.evidence_cards(evidence, "aqua").collect()}
    assert set(got) == {"e1", "e2"}
    assert (got["e1"].route_name, got["e1"].occupancy, got["e1"].in_service, got["e1"].load) == ("Loop", "0.5", "true", None)
    assert got["e2"].occupancy == "7"
    assert boards.evidence_cards(evidence, "atlas").count() == 0 and boards.evidence_cards(evidence, "aqua", 1).count() == 1


def test_queue_cards_fall_back_to_the_recommendation(spark):
    r = "recommendation_id long, incident_id long, state string, priority string, why_it_matters string, what_changed string, recommended_action string, created_at timestamp_ntz, expires_at timestamp_ntz"
    i = "incident_id long, title string, severity string, why_it_matters string, detected_at timestamp_ntz, affected_services array<string>"
    recommendations = spark.createDataFrame([(1, 7, "delegated", "low", "Own words. More", "changed", "act", T, T), (2, 8, "escalated", "very_high", None, "changed", "Act now! Then rest", None, None), (3, 7, "approved", "low", "", "", "", T, T), (4, None, "awaiting_approval", None, None, None, None, None, None)], r)
    incidents = spark.createDataFrame([(7, "Crash", "critical", "", T, ["traffic", "odd_one", "transit", "parking"])], i)
    got = {x.recommendation_id: tuple(x)[2:] for x in boards.queue_cards(recommendations, incidents).collect()}
    assert got == {
        1: ("Critical", "09:30", "exp 09:30", "Own words", "Crash", ["Roads", "odd one", "Transit"]),
        2: ("Very high", "—", "exp —", "Act now", "changed", []),
        4: (None, "—", "exp —", "", "", []),
    }


def test_requirements_are_written_once_and_hold_up_the_approval(spark):
    approvals = spark.createDataFrame([("r", [("a", "x"), ("b", "y"), ("a", "x"), ("zz", "x")])], "rule_code string, approvals array<struct<agency_code:string,role_code:string>>")
    agencies = spark.createDataFrame([("a",), ("b",)], "agency_code string")
    recommendations = spark.createDataFrame([(1, "r"), (2, "r"), (3, "none")], "recommendation_id long, rule_code string")
    none = spark.createDataFrame([], "recommendation_id long, agency_code string, role_code string, sequence long, status string")
    first = lifecycle.required(recommendations, approvals, agencies, none)
    assert sorted(map(tuple, first.collect())) == [(k, a, role, n, "pending") for k in (1, 2) for a, role, n in (("a", "x", 1), ("b", "y", 2))]
    again = lifecycle.required(recommendations, approvals, agencies, first.withColumn("status", F.lit("satisfied")))
    assert {r.status for r in again.collect()} == {"satisfied"} and again.count() == 4
    states = recommendations.select("recommendation_id", F.lit("awaiting_approval").alias("state"))
    signed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "recommendation_id long, agency_code string")
    got = {r.recommendation_id: (r.n_pending, r.state) for r in lifecycle.after_approval(states, first, signed).collect()}
    assert got == {1: (0, "approved"), 2: (1, "awaiting_approval"), 3: (0, "approved")}


def test_desks_together_in_words(spark):
    rows = [(1, 1, "Traffic", "contributed", None), (1, 2, "Water", "dissent", "the creek rises"), (1, 3, "Routes", "abstained", None), (2, 1, "Traffic", "no_feed", None), (3, 1, "Traffic", "contributed", None)]
    got = {r.incident_id: tuple(r)[1:] for r in boards.composed_text(spark.createDataFrame(rows, "incident_id long, place long, desk_name string, stance string, concern string")).collect()}
    assert got[1][:2] == ("Traffic, Water contributed. Routes had no evidence to offer.", "The desks do not fully agree. Water: the creek rises")
    assert got[2][0] == "No staffed desk could evaluate this incident. Traffic all reported no usable evidence." and got[2][3] == "abstained"
    assert got[3][0] == "Traffic contributed. Every staffed desk reported." and got[3][2].startswith("Composed from")


def test_maps_leave_out_what_is_stale_or_weather(spark):
    rows = [(1, "a", [], "Point", None), (2, "a", ["stale"], "Point", None), (3, "city-weather", None, "Point", None), (4, "a", ["nws_alert"], "Polygon", None), (5, "a", None, "Polygon", "reference"), (6, "a", None, "Point", "reference"), (7, None, None, "LineString", None)]
    seen = spark.createDataFrame(rows, "evidence_id long, source_code string, quality_flags array<string>, geometry_type string, data_class string")
    assert [r.evidence_id for r in boards.map_points(seen, [F.asc("evidence_id")]).collect()] == [1]
    assert sorted(r.evidence_id for r in boards.map_shapes(seen).collect()) == [5, 7]


def test_checkpoints_and_live_feeds(spark):
    old = spark.createDataFrame([("a", "1", T), ("b", "1", T)], "source_id string, metadata string, updated_at timestamp_ntz")
    batches = spark.createDataFrame([("a", "2", T, 1), ("a", "3", T, 2), ("a", None, T, 3), ("c", "9", T, 1)], "source_id string, metadata string, updated_at timestamp_ntz, n long")
    got = {r.source_id: r.metadata for r in records.checkpointed(old, batches, ["updated_at", "n"]).collect()}
    assert got == {"a": "3", "b": "1", "c": "9"}
    feeds = spark.createDataFrame([(None, "healthy"), ("connected", "healthy"), ("connected", None), ("not_connected", "healthy")], "c string, h string")
    assert [r[0] for r in feeds.select(records.is_live(F.col("c"), F.col("h"))).collect()] == [True, True, False, False]
    assert records.checkpointed(old.limit(0), batches.limit(0), ["n"]).count() == 0
