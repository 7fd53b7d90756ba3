"""Reference layers: fetched rarely, read often, never evidence.

A fetch lands what the source published; its features are stored as typed columns in
order of place, one folder a fetch, named by its time.  Reads within the time to live
take the newest folder and do not touch what was landed.  As a snapshot is columns in
order, a box and a list of fields reach the scan: it reads those columns only, and only
the row groups whose bounds meet the box.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.sources.canonical import text
from mobilis.sources.folders import removed, versions

TTL_HOURS = 12
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def typed_features(features: DataFrame, fields: list[str]) -> DataFrame:
    """lon, lat and the fields of point features (``v``, a GeoJSON feature); others have no place and drop out."""
    v = F.col("v")
    lon, lat = (F.try_variant_get(v, f"$.geometry.coordinates[{k}]", "double") for k in range(2))
    rows = features.select(lon.alias("lon"), lat.alias("lat"), *[text(v, f"properties.{f}").alias(f) for f in fields])
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL")


def typed_stations(stations: DataFrame) -> DataFrame:
    """Traffic-count stations (``v``) as columns, so that area and activity can be asked of the scan."""
    a = "attributes."
    names = ["Station", "RouteID", "YearAADT", "AADT", "Location", "IsActive"]
    return stations.select(*[text(F.col("v"), a + n).alias(n) for n in names])


def micros(at: datetime) -> int:
    """Microseconds of an instant; one without a zone is taken as UTC."""
    aware = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (aware - _EPOCH) // timedelta(microseconds=1)


def reused(spark: SparkSession, folder: str, layer: str, now: datetime, fetch: Callable[[], DataFrame], order: list[str], hours: float = TTL_HOURS) -> DataFrame:
    """A layer that is at most ``hours`` old: the stored snapshot, or what ``fetch`` gives now.

    ``fetch`` is called only if no snapshot is younger than ``hours``.  Each row has
    ``retrieved_at``.  The snapshot before the newest stays for readers that hold it.
    """
    home = f"{folder}/{layer}"
    done = versions(spark, home)
    if not done or micros(now) - done[-1] >= hours * 3_600_000_000:
        at = micros(now)
        rows = fetch().withColumn("retrieved_at", F.timestamp_micros(F.lit(at)))
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{home}/{at}")
        for old in done[:-1]:
            removed(spark, f"{home}/{old}")
        done.append(at)
    return spark.read.parquet(f"{home}/{done[-1]}")


def within(layer: DataFrame, box: tuple[float, float, float, float], fields: list[str]) -> DataFrame:
    """The features of a layer in a box (south, west, north, east) with some fields; empty ones are left out of ``known``."""
    south, west, north, east = box
    inside = layer.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    known = F.map_filter(F.create_map(*[c for f in fields for c in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())
    return inside.select("lon", "lat", known.alias("known"))


def active_near(stations: DataFrame, place: str) -> DataFrame:
    """Active stations whose location names a place."""
    return stations.where((F.col("IsActive") == "1") & F.col("Location").contains(place))
