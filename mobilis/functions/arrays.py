"""Arrays of structs that keep their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ids(items: Column, key: str) -> Column:
    return F.transform(items, lambda x: F.struct(x[key].alias("id")))  # in a struct a null id is a value


def first_of_each(items: Column, key: str = "id") -> Column:
    """The first item of each id, in order; a null id is one id.  A null array stays null."""
    ids = _ids(items, key)
    return F.filter(items, lambda x, i: F.array_position(ids, F.struct(x[key].alias("id"))) == i + 1)


def last_of_each(items: Column, key: str = "id") -> Column:
    """One item an id, in the order in which ids came first, each with what came last for it."""
    ids = _ids(items, key)
    backwards, reversed_ids = F.reverse(items), F.reverse(ids)

    def last(x: Column) -> Column:
        return F.element_at(backwards, F.array_position(reversed_ids, F.struct(x[key].alias("id"))).cast("int"))

    return F.transform(first_of_each(items, key), last)


def kept_in_order(catalogue: Column, chosen: Column, required: Column) -> Column:
    """The names of a catalogue that are chosen or required, in the catalogue's order; unknown ones drop out."""
    wanted = F.array_union(F.coalesce(chosen, F.array().cast("array<string>")), required)
    return F.filter(catalogue, lambda name: F.array_contains(wanted, name))


def trimmed(text: Column) -> Column:
    """Text without the blanks, no-break spaces and byte-order marks around it."""
    return F.regexp_replace(text, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")
