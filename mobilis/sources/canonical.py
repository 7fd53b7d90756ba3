"""The one shape that all feeds are brought to, and reading their raw payloads.

A landing zone holds payloads as JSON lines, one upstream record a line.  They stay
text until a feed's normaliser reads members from VARIANT, where a member that is
``null`` and one that is missing stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.functions.coerce import canonical_json_hash, is_json_null, js_date, member

COLUMNS = ["connector_code", "source_event_id", "observed_at", "summary", "geometry", "attributes", "quality_flags", "content_hash"]


def raw(spark: SparkSession, path: str) -> DataFrame:
    """The payload lines below a path: ``payload`` as text."""
    return spark.read.text(path).select(F.col("value").alias("payload"))


def parsed(lines: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(records with ``v``, the payload as VARIANT; lines that are no JSON).

    A generator holds ``v`` apart from what reads it: a projection would be merged into its
    readers, and each member that they read would parse the payload again.
    """
    read = lines.withColumn("v", F.explode(F.array(F.try_parse_json(payload))))
    return read.where("v IS NOT NULL"), read.where("v IS NULL").drop("v")


def text(v: Column, path: str) -> Column:
    """A member as text; NULL if missing, ``null`` or not a plain value."""
    return F.when(~is_json_null(v, path), member(v, path, "string"))


def first_text(v: Column, *paths: str) -> Column:
    """The first of several members that is there and not ``null``."""
    return F.coalesce(*[text(v, p) for p in paths])


def first_date(v: Column, paths: list[str], fallback: Column) -> Column:
    """The time in the first of several members that is there and not ``null``; else ``fallback``."""
    out = fallback
    for p in reversed(paths):
        there = member(v, p, "string").isNotNull() & ~is_json_null(v, p)
        out = F.when(there, js_date(v, p, fallback)).otherwise(out)
    return out


def number(v: Column, path: str) -> Column:
    """A finite number that is there as a number or numeric text; NULL else."""
    return F.when(~is_json_null(v, path), member(v, path, "double"))


def point(lon: Column, lat: Column) -> Column:
    """A point as GeoJSON text, NULL where a coordinate is unknown."""
    there = lon.isNotNull() & lat.isNotNull()
    return F.when(there, F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))


def observations(rows: DataFrame, connector: str, attributes: dict[str, Column], **columns: Column) -> DataFrame:
    """Canonical observations of one connector from a feed's rows.

    ``attributes`` are written as JSON with their nulls, since a known ``null`` is
    not a missing member; their canonical text decides the content hash.
    """
    packed = F.to_json(F.struct(*[c.alias(n) for n, c in attributes.items()]), {"ignoreNullFields": "false"})
    made = rows.select(
        F.lit(connector).alias("connector_code"),
        columns["source_event_id"].alias("source_event_id"),
        columns["observed_at"].cast("timestamp").alias("observed_at"),
        columns["summary"].alias("summary"),
        columns.get("geometry", F.lit(None).cast("string")).alias("geometry"),
        packed.alias("attributes"),
        columns["quality_flags"].alias("quality_flags"),
    )
    return made.withColumn("content_hash", canonical_json_hash(F.col("attributes"))).select(*COLUMNS)


def flags(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def for_detection(observed: DataFrame) -> DataFrame:
    """Observations as evidence for rules: an id and VARIANT attributes, ``{}`` where there are none."""
    evidence_id = F.concat_ws("#", "connector_code", "source_event_id")
    return observed.withColumn("evidence_id", evidence_id).withColumn("attributes", F.coalesce(F.try_parse_json("attributes"), F.parse_json(F.lit("{}"))))


def records_by_kind(observed: DataFrame) -> DataFrame:
    """What a run brought, by the kind that the upstream identity begins with."""
    kind = F.substring_index("source_event_id", ":", 1)
    return observed.groupBy("connector_code", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
