"""One normaliser a feed: payload records in, canonical observations out.

Every function takes tables with ``v``, one upstream record as VARIANT (see
:func:`mobilis.sources.canonical.parsed`), and the instant of the fetch.  Nothing is
collected; filters stand before the projection so that Spark drops rows early.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import is_json_null, js_date, js_number, member
from mobilis.functions.text import capitalised, event_identity, haversine_km, in_box, squeezed
from mobilis.functions.time import published, quality_flags, seconds_between
from mobilis.sources.canonical import first_date, first_text, flags, number, observations, point, text

#: The operating area, its zones and the feeds' places.
CITIES, COUNTIES = ["auburn", "opelika"], ["lee"]
BOX = (32.48, -85.62, 32.72, -85.32)
CORRIDOR_NAMES = ["auburn", "exit 51", "opelika"]
ZONES = ["ALC081", "ALZ047"]
ORIGIN = (32.6025, -85.49)
GAGE_HEIGHT, DISCHARGE, NO_DATA = "00065", "00060", -999999.0
RISE_HOURS, FORECAST_HOURS = 3, 12
OPERATING_POLYGON = '{"type":"Polygon","coordinates":[[[-85.57,32.55],[-85.39,32.55],[-85.39,32.67],[-85.57,32.67],[-85.57,32.55]]]}'


def record() -> Column:
    """The record of a row."""
    return F.col("v")


def _or(value: Column, other: str) -> Column:
    return F.coalesce(value, F.lit(other))


def _inside(path: str) -> Column:
    return in_box(text(record(), f"{path}.city"), text(record(), f"{path}.county"), number(record(), f"{path}.latitude"), number(record(), f"{path}.longitude"), CITIES, COUNTIES, BOX)


def _geometry(path: str = "geometry") -> Column:
    """A member that holds GeoJSON, as text; NULL where it is null or missing."""
    return F.when(~is_json_null(record(), path), F.to_json(F.try_variant_get(record(), f"$.{path}", "variant")))


def closures(layers: dict[str, DataFrame], now: Column) -> DataFrame:
    """Road blocks, closures and detours: layers of GeoJSON features by kind."""

    def one(kind: str, features: DataFrame) -> DataFrame:
        p = "properties."
        begins = F.when(first_text(record(), p + "starttime", p + "StartTime").isNotNull(), first_date(record(), [p + "starttime", p + "StartTime"], now))
        ends = F.when(first_text(record(), p + "endtime", p + "EndTime").isNotNull(), first_date(record(), [p + "endtime", p + "EndTime"], now))
        road = _or(first_text(record(), *[p + n for n in ("street", "StreetName", "RoadName", "FullStreetName", "Name", "Location")]), "Unnamed road")
        about = _or(first_text(record(), *[p + n for n in ("description", "Description", "ClosureDescription", "reason", "Reason", "Notes")]), "No public description")
        number_ = _or(first_text(record(), p + "GlobalID", p + "globalid", p + "OBJECTID", p + "objectid", "id"), "0")
        state = F.when(begins.isNull() & ends.isNull(), flags("active_public_record", "schedule_not_structured")).when(begins > now, flags("scheduled_within_24_hours")).otherwise(flags("active_public_record"))
        return observations(
            features.where(published(begins, ends, now)),
            "coa-road-closures-v1",
            {"kind": F.lit(kind), "road": road, "description": about, "startsAt": F.unix_millis(begins), "endsAt": F.unix_millis(ends)},
            source_event_id=F.concat(F.lit(f"{kind}:"), number_),
            observed_at=first_date(record(), [p + n for n in ("EditDate", "last_edited_date", "UpdatedAt", "StartDate")], now),
            summary=F.concat(capitalised(F.lit(kind)), F.lit(": "), road, F.lit(" — "), about),
            geometry=_geometry(),
            quality_flags=state,
        )

    return reduce(DataFrame.unionByName, [one(k, df) for k, df in layers.items()])


def traffic_events(events: DataFrame, now: Column) -> DataFrame:
    """Active traveller events that begin or end inside the operating area."""
    first, last = _inside("startLocation"), _inside("endLocation")

    def at(name: str, read=text) -> Column:
        return F.when(first, read(record(), f"startLocation.{name}")).otherwise(read(record(), f"endLocation.{name}"))

    kind = text(record(), "type")
    route = _or(F.coalesce(at("displayRouteDesignator"), at("routeDesignator")), "Unspecified route")
    named = lambda c: F.when(c != "", c)
    place = F.coalesce(named(text(record(), "shortSubTitle")), named(text(record(), "subTitle")), route)
    title = _or(text(record(), "title"), "Traveler event")
    active = F.coalesce(member(record(), "active", "boolean"), F.lit(True))
    return observations(
        events.where(active & (first | last)),
        "aldot-algo-traffic-v1",
        {
            "layer": F.lit("traffic_event"), "algoEventId": text(record(), "id"), "eventType": _or(kind, "Unknown"), "severity": text(record(), "severity"), "title": title, "subtitle": place,
            "description": _or(text(record(), "description"), ""), "route": route, "city": at("city"), "county": at("county"), "startsAt": text(record(), "start"), "endsAt": text(record(), "end"),
            "latitude": at("latitude", number), "longitude": at("longitude", number),
        },
        source_event_id=F.concat(F.lit("event:"), _or(kind, "unknown"), F.lit(":"), text(record(), "id")),
        observed_at=first_date(record(), ["lastUpdatedAt", "start"], now),
        summary=F.concat(_or(kind, "Event"), F.lit(": "), title, F.lit(" — "), place),
        geometry=point(at("longitude", number), at("latitude", number)),
        quality_flags=F.when(kind.isin("Crash", "Incident"), flags("algo_traveler_event", "official_incident")).otherwise(flags("algo_traveler_event", "published_roadwork")),
    )


def travel_times(items: DataFrame, now: Column) -> DataFrame:
    """Travel times whose name or ends mention the corridor."""
    hay = F.lower(F.concat_ws(" ", _or(text(record(), "name"), ""), _or(text(record(), "origin.name"), ""), _or(text(record(), "destination.name"), "")))
    level = text(record(), "congestionLevel")
    shown = lambda p: _or(text(record(), p), "unknown")
    return observations(
        items.where(reduce(Column.__or__, [hay.contains(n) for n in CORRIDOR_NAMES])),
        "aldot-algo-traffic-v1",
        {
            "layer": F.lit("travel_time"), "algoTravelTimeId": text(record(), "id"), "name": _or(text(record(), "name"), "Corridor travel time"), "origin": text(record(), "origin.name"), "destination": text(record(), "destination.name"),
            "averageSpeedMph": number(record(), "averageSpeedMph"), "estimatedTimeMinutes": number(record(), "estimatedTimeMinutes"), "congestionLevel": level, "totalDistanceMiles": number(record(), "totalDistanceMiles"),
        },
        source_event_id=F.concat(F.lit("travel-time:"), text(record(), "id")),
        observed_at=js_date(record(), "lastUpdated", now),
        summary=F.concat(_or(text(record(), "name"), "Corridor"), F.lit(": "), shown("averageSpeedMph"), F.lit(" mph, "), shown("estimatedTimeMinutes"), F.lit(" min ("), shown("congestionLevel"), F.lit(")")),
        geometry=point(F.lit(-85.5209), F.lit(32.5558)),
        quality_flags=F.when((level != "") & (level != "Unaffected"), flags("algo_travel_time", "congestion_reported")).otherwise(flags("algo_travel_time")),
    )


def message_signs(signs: DataFrame, now: Column) -> DataFrame:
    """Signs inside the area with their pages: lines joined, blank ones left out."""
    lines = F.try_variant_get(record(), "$.pages", "array<struct<lines:array<struct<text:string>>>>")
    shown = F.transform(lines, lambda p: F.array_join(F.filter(F.transform(F.coalesce(p["lines"], F.array().cast("array<struct<text:string>>")), lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: t != ""), " / "))
    pages = F.coalesce(F.filter(shown, lambda t: t != ""), F.array().cast("array<string>"))
    spot = "location."
    return observations(
        signs.where(_inside("location")),
        "aldot-algo-traffic-v1",
        {
            "layer": F.lit("message_sign"), "algoSignId": text(record(), "id"), "route": text(record(), spot + "displayRouteDesignator"), "direction": text(record(), spot + "direction"), "city": text(record(), spot + "city"),
            "pages": pages, "latitude": number(record(), spot + "latitude"), "longitude": number(record(), spot + "longitude"),
        },
        source_event_id=F.concat(F.lit("sign:"), text(record(), "id")),
        observed_at=now,
        summary=squeezed(F.concat(F.lit("Message sign "), _or(text(record(), spot + "direction"), ""), F.lit(" "), _or(text(record(), spot + "city"), ""), F.lit(": "), F.coalesce(F.get(pages, 0), F.lit("no text")))),
        geometry=point(number(record(), spot + "longitude"), number(record(), spot + "latitude")),
        quality_flags=flags("algo_message_sign"),
    )


def traffic(events: DataFrame, times: DataFrame, signs: DataFrame, now: Column) -> DataFrame:
    """Events, travel times and signs as one feed."""
    return traffic_events(events, now).unionByName(travel_times(times, now)).unionByName(message_signs(signs, now))


def operational_alert(now: Column, zones: list[str] | None = None) -> Column:
    """Real, not cancelled, not over, and for one of the zones."""
    p = "properties."
    named = F.coalesce(F.try_variant_get(record(), "$.properties.geocode.UGC", "array<string>"), F.array().cast("array<string>"))
    over = F.coalesce(F.try_to_timestamp(text(record(), p + "expires")) < now.cast("timestamp"), F.lit(False))
    kind = F.coalesce(text(record(), p + "messageType"), F.lit(""))
    return F.coalesce(text(record(), p + "status") == "Actual", F.lit(False)) & (kind != "Cancel") & ~over & F.arrays_overlap(named, F.array(*[F.lit(z) for z in zones or ZONES]))


def alert_key() -> Column:
    code = F.coalesce(F.try_variant_get(record(), "$.properties.parameters.VTEC[0]", "string"), F.try_variant_get(record(), "$.properties.parameters.VTEC", "string"))
    return event_identity(code, text(record(), "properties.id"))


def alerts(features: DataFrame, now: Column) -> DataFrame:
    """Weather alerts in force for the area; an update keeps the identity of its event."""
    p = "properties."
    key, severity = alert_key(), text(record(), p + "severity")
    name = _or(text(record(), p + "event"), "Weather alert")
    plain = {n: text(record(), p + n) for n in ("headline", "description", "instruction", "areaDesc", "senderName")}
    known = {n: _or(text(record(), p + n), "Unknown") for n in ("severity", "urgency", "certainty")}
    return observations(
        features.where(operational_alert(now)),
        "nws-weather-alerts-v1",
        {
            "layer": F.lit("weather_alert"), "alertId": key, "messageId": text(record(), p + "id"), "eventName": name, **plain, **known, "messageType": _or(text(record(), p + "messageType"), "Alert"),
            "onsetAt": first_text(record(), p + "onset", p + "effective"), "expiresAt": text(record(), p + "expires"), "endsAt": text(record(), p + "ends"),
        },
        source_event_id=F.concat(F.lit("alert:"), key),
        observed_at=first_date(record(), [p + "sent", p + "effective"], now),
        summary=F.concat(name, F.lit(": "), _or(first_text(record(), p + "headline", p + "areaDesc"), "operating area")),
        geometry=_geometry(),
        quality_flags=F.when(severity.isin("Extreme", "Severe"), flags("nws_alert", "severe_or_extreme")).otherwise(flags("nws_alert")),
    )


def alert_overlay(features: DataFrame, now: Column) -> DataFrame:
    """Shapes of the alerts in force; one without a polygon gets that of the operating area."""
    shape = F.try_variant_get(record(), "$.geometry.type", "string").isin("Polygon", "MultiPolygon")
    shape = F.coalesce(shape, F.lit(False))
    return features.where(operational_alert(now)).select(
        alert_key().alias("alert_id"),
        _or(text(record(), "properties.event"), "Weather alert").alias("event_name"),
        _or(text(record(), "properties.severity"), "Unknown").alias("severity"),
        F.when(shape, _geometry()).otherwise(F.lit(OPERATING_POLYGON)).alias("geometry"),
        F.when(shape, "published").otherwise("operating-box").alias("geometry_source"),
    )


def forecast(grids: DataFrame, now: Column) -> DataFrame:
    """The first hours of an hourly grid (``gridCode``, ``periods``) as one observation; an empty grid gives none."""
    kind = "array<struct<startTime:string,temperature:double,temperatureUnit:string,probabilityOfPrecipitation:variant,shortForecast:string>>"
    first = F.slice(F.try_variant_get(record(), "$.periods", kind), 1, FORECAST_HOURS)
    rain = F.transform(first, lambda x: F.when(F.is_variant_null(F.try_variant_get(x["probabilityOfPrecipitation"], "$.value", "variant")), F.lit(0.0)).otherwise(F.try_variant_get(x["probabilityOfPrecipitation"], "$.value", "double")))
    heat = F.array_max(F.filter(F.transform(first, lambda x: F.when(x["temperatureUnit"] == "F", x["temperature"])), lambda t: t.isNotNull()))
    thunder = F.size(F.filter(first, lambda x: F.coalesce(F.lower(x["shortForecast"]).contains("thunder"), F.lit(False))))
    told = F.coalesce(F.get(first, 0)["shortForecast"], F.lit("no forecast text"))
    whole = lambda c: c.cast("long").cast("string")
    return observations(
        grids.where(F.size(first) > 0),
        "nws-weather-alerts-v1",
        {"layer": F.lit("hourly_forecast"), "gridCode": text(record(), "gridCode"), "hours": F.size(first), "maxTemperatureF": heat, "maxPrecipitationProbability": F.array_max(rain), "thunderstormHours": thunder},
        source_event_id=F.concat(F.lit("forecast:"), text(record(), "gridCode")),
        observed_at=F.coalesce(F.try_to_timestamp(F.get(first, 0)["startTime"]), now.cast("timestamp")),
        summary=F.concat(F.lit("Next "), F.size(first).cast("string"), F.lit("h: "), told, F.lit(", up to "), _or(whole(heat), "unknown"), F.lit("F, "), _or(whole(F.array_max(rain)), "0"), F.lit("% precipitation")),
        geometry=point(F.lit(-85.49), F.lit(32.6025)),
        quality_flags=flags("nws_gridded_forecast", "operating_context"),
    )


def gauges(series: DataFrame, now: Column) -> DataFrame:
    """Stream gauges: the last reading of each parameter of a site, and the rise of its stage.

    The rise is the last stage less the first reading of the hours up to it; one
    reading alone, and readings marked as no data, give none.
    """
    code = F.try_variant_get(record(), "$.sourceInfo.siteCode[0].value", "string")
    spot = "sourceInfo.geoLocation.geogLocation."
    each = series.where(F.coalesce(code, F.lit("")) != "").select(
        code.alias("site"),
        F.coalesce(text(record(), "sourceInfo.siteName"), code).alias("name"),
        js_number(record(), spot + "latitude").alias("lat"),
        js_number(record(), spot + "longitude").alias("lon"),
        F.try_variant_get(record(), "$.variable.variableCode[0].value", "string").alias("parameter"),
        F.explode(F.try_variant_get(record(), "$.values[0].value", "array<struct<dateTime:string,value:string>>")).alias("r"),
    )
    read = each.select("site", "name", "lat", "lon", "parameter", F.try_to_timestamp("r.dateTime").alias("at"), F.col("r.value").try_cast("double").alias("value")).where((F.col("at").isNotNull()) & (F.col("value") != NO_DATA))
    last_at = F.max("at").over(Window.partitionBy("site", "parameter"))
    read = read.withColumn("fresh", F.col("at") >= last_at - F.expr(f"INTERVAL {RISE_HOURS} HOURS"))
    stage = F.col("parameter") == GAGE_HEIGHT
    from_, to = F.when(stage & F.col("fresh"), F.col("at")), F.when(stage, F.col("at"))
    rise = F.round((F.max_by("value", to) - F.min_by("value", from_)).cast("decimal(18,6)"), 2).cast("double")
    sites = read.groupBy("site").agg(
        F.first("name").alias("name"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.max("at").alias("at"),
        F.max_by("value", to).alias("stage"),
        F.max_by("value", F.when(F.col("parameter") == DISCHARGE, F.col("at"))).alias("flow"),
        F.when(F.min(from_) < F.max(to), rise).alias("rise"),
    )
    signed = F.when(F.col("rise").isNotNull(), F.concat(F.lit(", "), F.when(F.col("rise") >= 0, "+").otherwise(""), F.col("rise").cast("string"), F.lit(f" ft over {RISE_HOURS}h")))
    return observations(
        sites,
        "usgs-natural-hazards-v1",
        {
            "layer": F.lit("stream_gauge"), "siteCode": F.col("site"), "siteName": F.col("name"), "gageHeightFt": F.col("stage"), "dischargeCfs": F.col("flow"), "riseFt": F.col("rise"),
            "riseWindowHours": F.lit(RISE_HOURS), "latitude": F.col("lat"), "longitude": F.col("lon"),
        },
        source_event_id=F.concat(F.lit("gauge:"), F.col("site")),
        observed_at=F.coalesce("at", now.cast("timestamp")),
        summary=F.concat(F.col("name"), F.lit(": "), _or(F.col("stage").cast("string"), "unknown"), F.lit(" ft stage"), _or(signed, "")),
        geometry=point(F.col("lon"), F.col("lat")),
        quality_flags=F.when(F.col("rise") > 0, flags("usgs_provisional", "stage_rising")).otherwise(flags("usgs_provisional")),
    )


def quakes(features: DataFrame, now: Column) -> DataFrame:
    """Earthquakes with an id; a distance that cannot be known stays null."""
    lon, lat, depth = (F.try_variant_get(record(), f"$.geometry.coordinates[{k}]", "double") for k in range(3))
    p = "properties."
    at = js_date(record(), p + "time", now.cast("timestamp"))
    told = F.concat(F.lit("M "), _or(text(record(), p + "mag"), "?"), F.lit(" earthquake near "), _or(text(record(), p + "place"), "the region"))
    return observations(
        features.where((text(record(), p + "type") == "earthquake") & (F.coalesce(text(record(), "id"), F.lit("")) != "")),
        "usgs-natural-hazards-v1",
        {
            "layer": F.lit("earthquake"), "quakeId": text(record(), "id"), "magnitude": js_number(record(), p + "mag"), "place": text(record(), p + "place"), "depthKm": depth,
            "distanceKm": haversine_km(lat, lon, *ORIGIN), "reviewStatus": text(record(), p + "status"), "latitude": lat, "longitude": lon,
        },
        source_event_id=F.concat(F.lit("quake:"), text(record(), "id")),
        observed_at=at,
        summary=F.coalesce(text(record(), p + "title"), told),
        geometry=point(lon, lat),
        quality_flags=F.when(text(record(), p + "status") == "reviewed", flags("usgs_reviewed")).otherwise(flags("usgs_automatic")),
    )


def transit(vehicles: DataFrame, routes: DataFrame, now: Column, stale_after: int = 90, keep_seconds: int = 600) -> DataFrame:
    """Vehicles in service or heard of lately, with the names of their routes."""
    names = routes.select(text(record(), "id").alias("route_id"), text(record(), "name").alias("route_name")).dropDuplicates(["route_id"])
    seen = vehicles.withColumn("at", js_date(record(), "receiveTime", now.cast("timestamp"))).withColumn("route_id", text(record(), "routeID"))
    age = F.greatest(F.lit(0.0), seconds_between(F.col("at"), now.cast("timestamp")))
    serving = F.coalesce(number(record(), "inService") == 1, F.lit(False))
    kept = seen.where(number(record(), "lat").isNotNull() & number(record(), "lng").isNotNull() & (serving | (age <= keep_seconds)))
    met = kept.join(names, "route_id", "left")
    route = F.coalesce("route_name", F.concat(F.lit("Route "), F.col("route_id")))
    return observations(
        met,
        "auburn-eta-spot-v1",
        {
            "equipmentId": text(record(), "equipmentID"), "routeId": F.col("route_id"), "routeName": route, "patternId": text(record(), "patternID"), "tripId": text(record(), "tripID"), "latitude": number(record(), "lat"), "longitude": number(record(), "lng"),
            "inService": serving, "load": number(record(), "load"), "capacity": number(record(), "capacity"), "nextStopId": text(record(), "nextStopID"), "nextStopEtaSeconds": number(record(), "nextStopETA"),
            "scheduleDeviationSeconds": number(record(), "onSchedule"), "vehicleType": _or(text(record(), "vehicleType"), "Bus"),
        },
        source_event_id=F.concat_ws(":", F.lit("vehicle"), text(record(), "equipmentID"), text(record(), "receiveTime")),
        observed_at=F.col("at"),
        summary=F.concat(route, F.lit(": vehicle "), text(record(), "equipmentID"), F.when(serving, " in service").otherwise(" not in service")),
        geometry=point(number(record(), "lng"), number(record(), "lat")),
        quality_flags=quality_flags(age, F.lit(stale_after)),
    )


def probe_flow(points: DataFrame, now: Column) -> DataFrame:
    """Speeds at fixed points (``code``, ``name``, ``lat``, ``lon``, ``flow``), one identity a minute; missing speeds become nulls."""
    f = "flow."
    speed, free, trust = (number(record(), f + n) for n in ("currentSpeed", "freeFlowSpeed", "confidence"))
    ratio = F.when((speed != 0) & (free != 0), speed / free)
    part = F.when(ratio.isNotNull(), F.concat(F.lit(" ("), F.floor(ratio * 100 + 0.5).cast("string"), F.lit("% of free flow)")))
    minute = F.date_format(now.cast("timestamp"), "yyyy-MM-dd'T'HH:mm")
    return observations(
        points.where(F.try_variant_get(record(), "$.flow", "variant").isNotNull()),
        "tomtom-traffic-flow-v1",
        {
            "pointCode": text(record(), "code"), "pointName": text(record(), "name"), "currentSpeedMph": speed, "freeFlowSpeedMph": free, "currentTravelTimeSeconds": number(record(), f + "currentTravelTime"),
            "freeFlowTravelTimeSeconds": number(record(), f + "freeFlowTravelTime"), "confidence": trust, "roadClosure": F.coalesce(member(record(), f + "roadClosure", "boolean"), F.lit(False)), "functionalRoadClass": text(record(), f + "frc"),
        },
        source_event_id=F.concat_ws(":", F.lit("flow"), text(record(), "code"), minute),
        observed_at=now.cast("timestamp"),
        summary=F.concat(text(record(), "name"), F.lit(": "), _or(text(record(), f + "currentSpeed"), "unknown"), F.lit(" mph"), _or(part, "")),
        geometry=point(number(record(), "lon"), number(record(), "lat")),
        quality_flags=F.when(trust < 0.7, flags("low_confidence")).otherwise(F.array().cast("array<string>")),
    )


def count_stations(stations: DataFrame, now: Column) -> DataFrame:
    """Active traffic-count stations of the area: reference data, not live traffic."""
    a = "attributes."
    lat, lon = F.coalesce(number(record(), a + "Latitude"), number(record(), "geometry.y")), F.coalesce(number(record(), a + "Longitude"), number(record(), "geometry.x"))
    station, year = _or(first_text(record(), a + "Station", a + "TrafficCounterDetailID"), "unknown"), _or(text(record(), a + "YearAADT"), "unknown")
    dated = lambda n: F.when(number(record(), a + n) > 0, js_date(record(), a + n, now.cast("timestamp")))
    return observations(
        stations.where((number(record(), a + "IsActive") == 1) & text(record(), a + "Location").like("%Auburn%")),
        "aldot-traffic-counts-v1",
        {"station": station, "routeId": text(record(), a + "RouteID"), "yearAadt": text(record(), a + "YearAADT"), "aadt": number(record(), a + "AADT"), "averageCount": number(record(), a + "AverageCount"), "location": text(record(), a + "Location"), "totalLanes": number(record(), a + "TotalNumLanes"), "latitude": lat, "longitude": lon},
        source_event_id=F.concat_ws(":", F.lit("station"), station, year),
        observed_at=F.coalesce(dated("UpdatedOnDate"), dated("LastLocationUpdateDate"), now.cast("timestamp")),
        summary=F.concat(_or(text(record(), a + "RouteID"), "Route"), F.lit(" station "), station, F.lit(": "), _or(text(record(), a + "AADT"), "unavailable"), F.lit(" AADT ("), year, F.lit(")")),
        geometry=point(lon, lat),
        quality_flags=flags("reference_data", "not_live_traffic"),
    )


def reference_layer(features: DataFrame, fields: list[str], box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """Points of a city layer inside the box with the fields that are known (never evidence)."""
    south, west, north, east = box
    lon, lat = (F.try_variant_get(record(), f"$.geometry.coordinates[{k}]", "double") for k in range(2))
    known = F.map_filter(F.create_map(*[c for f in fields for c in (F.lit(f), text(record(), f"properties.{f}"))]), lambda _, v: v.isNotNull())
    return features.where(lat.between(south, north) & lon.between(west, east)).select(lon.alias("lon"), lat.alias("lat"), known.alias("fields"))


def road_ways(elements: DataFrame) -> DataFrame:
    """Ways of a road map with two points or more, and whether the state or the city keeps them."""
    path = F.try_variant_get(record(), "$.geometry", "array<struct<lat:double,lon:double>>")
    ref = F.coalesce(text(record(), "tags.ref"), F.lit(""))
    return elements.where((text(record(), "type") == "way") & (F.size(path) > 1)).select(text(record(), "id").alias("way_id"), ref.alias("ref"), F.when(ref.rlike(r"^(I|US|AL)[\s-]"), "state").otherwise("city").alias("keeper"), F.size(path).alias("n_points"))


def relation_members(elements: DataFrame) -> DataFrame:
    """Member ways of the relations of a road map: relation, member (its place), way_id, a and b, the places where it ends.

    A member without a geometry of two points or more is no line; a relation without
    members has no rows.
    """
    shape = "array<struct<type:string,ref:bigint,geometry:array<struct<lat:double,lon:double>>>>"
    members = F.try_variant_get(record(), "$.members", shape)
    each = elements.where(text(record(), "type") == "relation").select(text(record(), "id").alias("relation"), F.posexplode(members).alias("member", "m"))
    at = lambda k: F.concat_ws(",", F.element_at("m.geometry", k)["lat"], F.element_at("m.geometry", k)["lon"])
    return each.where(F.size("m.geometry") > 1).select("relation", F.col("member").cast("long").alias("member"), F.col("m.ref").alias("way_id"), at(1).alias("a"), at(-1).alias("b"))
