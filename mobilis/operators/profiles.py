"""Profiles of desks as they are stored: known tools, policies once, and when they last changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.functions.arrays import first_of_each, kept_in_order, trimmed

TEXTS = ["role", "backstory", "instructions", "model"]


def normalized(drafts: DataFrame, previous: DataFrame, catalogue: list[str], required: list[str]) -> DataFrame:
    """Drafts as profiles: desk_code, texts trimmed, temperature, enabled_tools, policies, updated_at, changed.

    Tools that the catalogue lacks are dropped and required ones added, in the catalogue's
    order; of policies with one id the first stays, its texts trimmed; the temperature has
    two places.  A draft that says what is stored keeps its ``updated_at``, any other gets its
    ``submitted_at``.  ``previous`` holds profiles by desk_code.  Null arrays are empty ones,
    null texts stay null.
    """
    names, must = (F.array(*[F.lit(x) for x in tools]).cast("array<string>") for tools in (catalogue, required))
    policies = F.transform(
        first_of_each(F.coalesce("policies", F.array().cast(drafts.schema["policies"].dataType))),
        lambda p: F.struct(p["id"].alias("id"), trimmed(p["title"]).alias("title"), p["jurisdiction"].alias("jurisdiction"), trimmed(p["source"]).alias("source"), trimmed(p["body"]).alias("body")),
    )
    clean = drafts.select(
        "desk_code",
        *[trimmed(F.col(c)).alias(c) for c in TEXTS],
        (F.floor(F.col("temperature") * 100 + 0.5) / 100).alias("temperature"),
        kept_in_order(names, F.col("enabled_tools"), must).alias("enabled_tools"),
        policies.alias("policies"),
        "submitted_at",
    )
    said = [*TEXTS, "temperature", "enabled_tools", "policies"]
    old = previous.select("desk_code", F.struct(*said).alias("_old"), F.col("updated_at").alias("_at"))
    met = clean.join(old, "desk_code", "left")
    same = F.col("_at").isNotNull() & F.struct(*said).eqNullSafe(F.col("_old"))
    return met.select("desk_code", *said, F.when(same, F.col("_at")).otherwise(F.col("submitted_at")).alias("updated_at"), (~same).alias("changed"))
