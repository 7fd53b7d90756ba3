"""Text, geometry and rank expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
SEVERITIES = ["critical", "high", "medium", "low", "informational"]


def match_rank(severity: Column) -> Column:
    """critical 0 .. informational 4, all different; unknown last."""
    rank = F.lit(5)
    for k, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == s, F.lit(k)).otherwise(rank)
    return rank


def queue_rank(severity: Column) -> Column:
    """As :func:`match_rank` from 1, but everything below medium ties at 4."""
    return F.when(severity == "critical", 1).when(severity == "high", 2).when(severity == "medium", 3).otherwise(4)


def haversine_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    dlat, dlon = F.radians(lat - lat0), F.radians(lon - lon0)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(dlon / 2), 2)
    return F.floor(2 * F.lit(EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))) + 0.5)


def in_box(city: Column, county: Column, lat: Column, lon: Column, cities: list[str], counties: list[str], box: tuple[float, float, float, float]) -> Column:
    """Named city or county, or inside (south, west, north, east), edges included; the unknown is outside."""
    south, west, north, east = box
    named = F.lower(city).isin(cities) | F.lower(county).isin(counties)
    return F.coalesce(named, F.lit(False)) | F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def event_identity(vtec: Column, fallback: Column) -> Column:
    """office.phenomenon.significance.tracking.yy of a warning code, else the fallback, else ``unknown``."""
    p = r"[.]([A-Z]{4})[.]([A-Z]{2})[.]([A-Z])[.]([0-9]{4})[.]([0-9]{2})"
    parts = [F.regexp_extract(vtec, p, k) for k in range(1, 6)]
    return F.when(F.coalesce(vtec, F.lit("")).rlike(p), F.concat_ws(".", *parts)).otherwise(F.coalesce(F.when(fallback != "", fallback), F.lit("unknown")))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def capitalised(text: Column) -> Column:
    plain = F.regexp_replace(text, "_", " ")
    return F.concat(F.upper(plain.substr(1, 1)), F.substring(plain, 2, 1 << 30))


def first_clause(text: Column, most: int = 80) -> Column:
    """Up to the first stop; longer ones are cut between words and end in an ellipsis."""
    clause = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^([^.;:]*)", 1))
    cut = F.regexp_replace(clause.substr(1, most), r"\s+\S*$", "")
    return F.when(F.length(clause) > most, F.concat(cut, F.lit("…"))).otherwise(clause)


def lead_clause(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark; all of it if nothing stands before."""
    clause = F.trim(F.regexp_extract(text, r"^([^.!?]*)", 1))
    return F.when(clause != "", clause).otherwise(F.trim(text))


def short_hash(h: Column) -> Column:
    return F.when(F.length(h) > 8, F.concat(h.substr(1, 4), F.lit("…"), F.right(h, F.lit(3)))).otherwise(h)


def listed(names: Column, last: str = "and") -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit(f" {last} "), F.element_at(names, -1)))


def representative_point(kind: Column, coordinates: Column) -> tuple[Column, Column]:
    """(lon, lat) of a geometry given as VARIANT coordinates; a line gives its middle vertex."""

    def at(path: str) -> tuple[Column, Column]:
        return F.try_variant_get(coordinates, f"{path}[0]", "double"), F.try_variant_get(coordinates, f"{path}[1]", "double")

    line = F.try_variant_get(coordinates, "$", "array<array<double>>")
    middle = F.get(line, F.floor(F.size(line) / 2).cast("int"))
    out = []
    for k in range(2):
        out.append(F.when(kind == "Point", at("$")[k]).when(kind == "LineString", F.get(middle, k)).when(kind.isin("MultiLineString", "Polygon"), at("$[0][0]")[k]).when(kind == "MultiPolygon", at("$[0][0][0]")[k]))
    return out[0], out[1]


#: How states of a connection are shown.
CONNECTION_LABELS = {"connected": "Connected", "permission_required": "Needs a partner agreement", "configuration_required": "Not set up yet", "not_connected": "Not connected"}
#: Lengths that a map's scale bar may stand for, in metres.
NICE_METRES = [50, 100, 200, 250, 500, 1000, 2000]


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; one that has none is shown with blanks for underscores."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(known, code), F.replace(code, F.lit("_"), F.lit(" ")))


#: The patterns, warnings and owner codes of the two functions below are fixed values.
def queue_alert(why: Column) -> Column:
    """What a queue card warns of: access before congestion, else the first clause, at most 42 characters."""
    text = F.trim(F.coalesce(why, F.lit("")))
    first = F.trim(F.regexp_extract(text, r"^([^.!?]*)", 1))
    first = F.when(first == "", text).otherwise(first)
    short = F.when(F.length(first) > 42, F.concat(F.trim(F.substring(first, 1, 39)), F.lit("…"))).otherwise(first)
    return F.when(text.rlike("(?i)emergency[- ]access|corridor"), "Emergency access at risk").when(text.rlike("(?i)spillback|congestion|queue"), "Approach is backing up").otherwise(short)


def nearest_nice(target: Column) -> Column:
    """The scale nearest to a target length, the smaller one on ties, with its unit."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(float(n)) - target).alias("off"), F.lit(n).alias("n")) for n in NICE_METRES]))["n"]
    return F.when(best >= 1000, F.concat((best / 1000).cast("int").cast("string"), F.lit(" km"))).otherwise(F.concat(best.cast("string"), F.lit(" m")))


def feed_owners(names: Column) -> Column:
    """The first three distinct owners that an array of feed names tells of, in order."""

    def owner(name: Column) -> Column:
        n = F.lower(name)
        return (
            F.when(n.contains("city") | (n.contains("auburn") & n.contains("closure")), "coa")
            .when(n.contains("aldot") | n.contains("algo"), "aldot")
            .when(n.contains("nws") | n.contains("weather"), "nws")
            .when(n.contains("tomtom"), "tomtom")
            .when(n.contains("usgs"), "usgs")
        )

    found = F.array_join(F.slice(F.array_distinct(F.array_compact(F.transform(names, owner))), 1, 3), " · ")
    return F.when(found == "", "feeds").otherwise(found)


def named_in(hay: Column, name: str, aliases: list[str]) -> Column:
    """Whether a text mentions a source by its id or one of its aliases, in any case."""
    low = F.lower(F.coalesce(hay, F.lit("")))
    out = low.contains(name.lower())
    for alias in aliases:
        out = out | low.contains(alias)
    return out
