"""Literal relations: connectors, scenario packs, detection rules, desks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, cadence and staleness in seconds, class, how it connects before anyone configures it.
CONNECTORS = [
    ("coa-road-closures-v1", 60, 300, "live", "connected"),
    ("aldot-algo-traffic-v1", 60, 300, "live", "connected"),
    ("nws-weather-alerts-v1", 300, 1800, "live", "connected"),
    ("usgs-natural-hazards-v1", 900, 3600, "live", "connected"),
    ("auburn-eta-spot-v1", 15, 90, "live", "permission_required"),
    ("tomtom-traffic-flow-v1", 60, 180, "live", "configuration_required"),
    ("aldot-traffic-counts-v1", 86400, 31536000, "reference", "connected"),
    ("auburn-parking-occupancy-v1", 30, 120, "live", "permission_required"),
    ("auburn-emergency-access-v1", None, 120, "live", "permission_required"),
]

#: Pack, default phase, connectors, desks.
PACKS = [
    ("road_closure", "steady_state", ["coa-road-closures-v1", "aldot-algo-traffic-v1", "tomtom-traffic-flow-v1", "aldot-traffic-counts-v1", "nws-weather-alerts-v1", "usgs-natural-hazards-v1"], ["atlas", "forge"]),
    ("sec_gameday", "readiness", ["coa-road-closures-v1", "aldot-algo-traffic-v1", "tomtom-traffic-flow-v1", "auburn-eta-spot-v1", "auburn-parking-occupancy-v1", "auburn-emergency-access-v1", "nws-weather-alerts-v1"], ["atlas", "aqua", "sentinel", "phoenix", "echo"]),
    ("severe_weather", "response", ["nws-weather-alerts-v1", "usgs-natural-hazards-v1", "coa-road-closures-v1", "aldot-algo-traffic-v1", "auburn-eta-spot-v1"], ["sentinel", "phoenix", "atlas", "forge", "echo"]),
    ("cyber_incident", "response", ["siem-alerts-v1", "coa-road-closures-v1"], ["echo", "forge"]),
]

#: Pack, rule, connector, desk, severity, services, commitments (agency, minutes).
RULES = [
    ("road_closure", "algo-crash", "aldot-algo-traffic-v1", "atlas", "high", ["traffic", "emergency_access"], [("city-traffic", 60)]),
    ("road_closure", "algo-incident", "aldot-algo-traffic-v1", "atlas", "medium", ["traffic"], [("city-traffic", 120)]),
    ("road_closure", "algo-corridor-congestion", "aldot-algo-traffic-v1", "atlas", "medium", ["traffic"], [("city-traffic", 90)]),
    ("road_closure", "city-restriction-in-effect", "coa-road-closures-v1", "forge", "medium", ["traffic", "public_works"], [("city-traffic", 120)]),
    ("road_closure", "tomtom-corridor-degraded", "tomtom-traffic-flow-v1", "atlas", "medium", ["traffic"], [("city-traffic", 60)]),
    ("road_closure", "nws-alert-active", "nws-weather-alerts-v1", "forge", "high", ["traffic", "public_works"], [("city-traffic", 90)]),
    ("road_closure", "usgs-stream-rapid-rise", "usgs-natural-hazards-v1", "forge", "medium", ["traffic", "public_works"], [("city-traffic", 90)]),
    ("sec_gameday", "algo-crash", "aldot-algo-traffic-v1", "atlas", "high", ["traffic", "ingress", "emergency_access"], [("city-traffic", 45), ("parking-transit", 60)]),
    ("sec_gameday", "algo-incident", "aldot-algo-traffic-v1", "atlas", "medium", ["traffic", "ingress"], [("city-traffic", 90)]),
    ("sec_gameday", "algo-corridor-congestion", "aldot-algo-traffic-v1", "atlas", "medium", ["traffic", "ingress", "parking"], [("parking-transit", 60)]),
    ("sec_gameday", "city-restriction-in-effect", "coa-road-closures-v1", "forge", "medium", ["traffic", "ingress", "event_command"], [("city-traffic", 90), ("parking-transit", 120)]),
    ("sec_gameday", "tomtom-corridor-degraded", "tomtom-traffic-flow-v1", "atlas", "medium", ["traffic", "ingress"], [("parking-transit", 60)]),
    ("sec_gameday", "nws-alert-active", "nws-weather-alerts-v1", "sentinel", "critical", ["public_safety", "traffic", "transit", "parking"], [("parking-transit", 30), ("city-traffic", 45)]),
    ("severe_weather", "nws-alert-active", "nws-weather-alerts-v1", "sentinel", "high", ["public_safety", "traffic", "transit"], [("city-traffic", 60)]),
    ("severe_weather", "usgs-stream-rapid-rise", "usgs-natural-hazards-v1", "forge", "high", ["public_safety", "traffic", "public_works"], [("city-traffic", 60)]),
    ("severe_weather", "usgs-earthquake-felt", "usgs-natural-hazards-v1", "forge", "high", ["public_safety", "traffic", "public_works"], [("city-traffic", 120)]),
    ("cyber_incident", "siem-critical-alert", "siem-alerts-v1", "echo", "high", ["communications", "operational_technology"], [("event-mobility-command", 30)]),
]

#: Desk and the connectors it may read.
DESKS = [
    ("atlas", ["aldot-algo-traffic-v1", "tomtom-traffic-flow-v1", "aldot-traffic-counts-v1"]),
    ("sentinel", ["nws-weather-alerts-v1", "auburn-emergency-access-v1"]),
    ("phoenix", ["auburn-emergency-access-v1", "coa-road-closures-v1"]),
    ("forge", ["coa-road-closures-v1", "usgs-natural-hazards-v1"]),
    ("aqua", ["auburn-eta-spot-v1", "auburn-parking-occupancy-v1"]),
    ("echo", ["aldot-algo-traffic-v1", "siem-alerts-v1"]),
]


def connectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONNECTORS, "connector_code string, cadence_seconds long, stale_after_seconds long, data_class string, default_status string")


def packs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACKS, "pack_code string, phase string, connectors array<string>, desks array<string>")


def rules(spark: SparkSession, pack: str | None = None) -> DataFrame:
    """The rules of all packs or of one, with what each commits agencies to."""
    kind = "pack_code string, rule_code string, connector_code string, desk_code string, severity string, services array<string>, commitments array<struct<agency_code:string,due_minutes:int>>"
    return spark.createDataFrame([r for r in RULES if pack in (None, r[0])], kind)


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, c) for d, cs in DESKS for c in cs], "desk_code string, connector_code string")
