"""Coercions with the semantics of the feeds' original readers.

JSON ``null`` and a missing member are different things here: a number that is
``null`` counts as 0, one that is missing is unknown.  VARIANT keeps them apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def member(variant: Column, path: str, kind: str) -> Column:
    """A member by its path; an empty path is the value itself."""
    return F.try_variant_get(variant, f"$.{path}" if path else "$", kind)


def is_json_null(variant: Column, path: str) -> Column:
    return F.coalesce(F.is_variant_null(member(variant, path, "variant")), F.lit(False))


def js_number(variant: Column, path: str) -> Column:
    """A finite number: ``null`` and blank text are 0, booleans 0 or 1, the missing and the rest NULL."""
    v = member(variant, path, "variant") if path else variant
    kind = F.schema_of_variant(v)
    text = F.trim(member(v, "", "string"))
    hexed = F.conv(F.substring(text, 3, 16), 16, 10).try_cast("double")
    number = (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(F.is_variant_null(v), F.lit(0.0))
        .when(kind == "BOOLEAN", member(v, "", "boolean").cast("double"))
        .when(kind != "STRING", member(v, "", "double"))
        .when(text == "", F.lit(0.0))
        .when(text.rlike("^0[xX][0-9a-fA-F]+$"), hexed)
        .when(text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    )
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def js_text(variant: Column, path: str) -> Column:
    """A member as text, empty where it is missing or ``null``."""
    return F.coalesce(member(variant, path, "string"), F.lit(""))


def js_date(variant: Column, path: str, fallback: Column) -> Column:
    """A time: ``null`` is the epoch, numbers are milliseconds, what does not parse is ``fallback``."""
    number = member(variant, path, "double")
    text = F.when(number.isNull(), member(variant, path, "string"))
    return F.coalesce(
        F.when(is_json_null(variant, path), F.lit(EPOCH).cast("timestamp")),
        F.timestamp_millis(number.cast("long")),
        F.try_to_timestamp(text),
        fallback,
    )


def epoch_millis(text: Column) -> Column:
    """Milliseconds of a time given as text: digits are milliseconds already; blank is unknown."""
    clean = F.when(F.trim(text) != "", F.trim(text))
    return F.coalesce(clean.try_cast("double"), F.unix_millis(F.try_to_timestamp(clean)).cast("double"))


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of columns joined by ``|``, nulls as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def canonical_json_hash(json: Column) -> Column:
    """SHA-256 of a JSON text with its members sorted at every depth."""
    return F.sha2(F.to_json(F.parse_json(json)), 256)


def stable_id(kind: Column, key: Column) -> Column:
    """An identifier in the shape of a UUID from a digest of its kind and key."""
    d = F.sha2(F.concat(kind, F.lit(":"), key), 256)
    return F.concat_ws("-", d.substr(1, 8), d.substr(9, 4), d.substr(13, 4), d.substr(17, 4), d.substr(21, 12))
