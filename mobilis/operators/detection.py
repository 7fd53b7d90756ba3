"""Detection rules over evidence, and their collapse into ranked matches.

A rule is a row (which connector, desk, severity) and, by its code, an entry of
``PREDICATES``: expressions over the evidence's attributes.  All rules run in one pass
over the evidence of the connectors that have a rule: the members that rules read are
taken out of the VARIANT once a row and typed once a row, each predicate gives what it
finds, and what was found joins the rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import epoch_millis, js_number, member
from mobilis.functions.text import match_rank
from mobilis.functions.time import in_effect

MATCH_EVIDENCE = 12


@dataclass
class Predicate:
    hit: Column
    key: Column
    severity: Column | None = None


#: The members of attributes that rules read as text, as numbers and as flags.
TEXTS = ["alertId", "algoEventId", "algoTravelTimeId", "congestionLevel", "endsAt", "eventType", "expiresAt", "kind", "layer", "pointCode", "quakeId", "severity", "siteCode", "startsAt"]
NUMBERS = ["confidence", "currentSpeedMph", "freeFlowSpeedMph", "magnitude", "riseFt"]
FLAGS = ["roadClosure"]
#: Limits of the rules.
SLOW, SURE, RISE_FT, FELT, STRONG = 0.6, 0.7, 2, 4, 5.5

#: A typed member by its name; text that is missing is empty, a number is null.
Member = Callable[[str], Column]
Builder = Callable[[Member, Column, Column], Predicate]


def _key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *[F.coalesce(p, F.lit("")) for p in parts])


def _traffic(kind: str) -> Builder:
    def build(a: Member, source_id: Column, now: Column) -> Predicate:
        return Predicate((a("layer") == "traffic_event") & (a("eventType") == kind), _key("algo-event:", a("algoEventId")))

    return build


def _congestion(a: Member, source_id: Column, now: Column) -> Predicate:
    level = a("congestionLevel")
    hit = (a("layer") == "travel_time") & ~level.isin("", "Unaffected", "Unknown")
    return Predicate(hit, _key("algo-corridor:", a("algoTravelTimeId")), F.when(level.isin("Heavy", "Severe"), "high"))


def _instant(a: Member, name: str) -> Column:
    return F.timestamp_millis(epoch_millis(a(name)).cast("long"))


def _restriction(a: Member, source_id: Column, now: Column) -> Predicate:
    kind = a("kind")
    return Predicate((kind != "") & in_effect(_instant(a, "startsAt"), _instant(a, "endsAt"), now.cast("timestamp")), _key("city-", kind, F.lit(":"), source_id))


def _degraded(a: Member, source_id: Column, now: Column) -> Predicate:
    closed, code = a("roadClosure"), a("pointCode")
    slow = (a("freeFlowSpeedMph") > 0) & (a("currentSpeedMph") / a("freeFlowSpeedMph") < SLOW)
    sure = a("confidence").isNull() | (a("confidence") >= SURE)
    return Predicate((code != "") & sure & (closed | F.coalesce(slow, F.lit(False))), _key("tomtom-point:", code), F.when(closed, "high"))


def _alert(a: Member, source_id: Column, now: Column) -> Predicate:
    expires = _instant(a, "expiresAt")
    hit = (a("alertId") != "") & (expires.isNull() | (expires >= now.cast("timestamp")))
    return Predicate(hit, _key("nws-alert:", a("alertId")), F.when(a("severity") == "Extreme", "critical"))


def _rise(a: Member, source_id: Column, now: Column) -> Predicate:
    return Predicate((a("layer") == "stream_gauge") & F.coalesce(a("riseFt") >= RISE_FT, F.lit(False)), _key("usgs-gauge:", a("siteCode")))


def _quake(a: Member, source_id: Column, now: Column) -> Predicate:
    size = a("magnitude")
    hit = (a("layer") == "earthquake") & F.coalesce(size >= FELT, F.lit(False))
    return Predicate(hit, _key("usgs-quake:", a("quakeId")), F.when(size >= STRONG, "critical"))


def _siem(a: Member, source_id: Column, now: Column) -> Predicate:
    level = F.lower(a("severity"))
    return Predicate((a("alertId") != "") & level.isin("critical", "high"), _key("siem-alert:", a("alertId")), F.when(level == "critical", "critical"))


PREDICATES: dict[str, Builder] = {
    "algo-crash": _traffic("Crash"),
    "algo-incident": _traffic("Incident"),
    "algo-roadwork": _traffic("Roadwork"),
    "algo-corridor-congestion": _congestion,
    "city-restriction-in-effect": _restriction,
    "tomtom-corridor-degraded": _degraded,
    "nws-alert-active": _alert,
    "usgs-stream-rapid-rise": _rise,
    "usgs-earthquake-felt": _quake,
    "siem-critical-alert": _siem,
}


def freeflow(a: Column) -> dict[str, Column]:
    """Current against free-flow speed (``a`` is VARIANT): whether both are known, the ratio to three places, whether it calls for a review."""
    current, free = js_number(a, "currentSpeedMph"), js_number(a, "freeFlowSpeedMph")
    comparable = F.coalesce(free > 0, F.lit(False)) & current.isNotNull()
    ratio = F.when(comparable, current / free)
    return {"comparable": comparable, "ratio": F.floor(ratio * 1000 + 0.5) / 1000, "below_threshold": F.coalesce(ratio < SLOW, F.lit(False))}


def unknown_rules(rules: DataFrame) -> DataFrame:
    """Rules without a predicate: they are skipped and reported."""
    return rules.where(~F.col("rule_code").isin(list(PREDICATES)))


def typed(evidence: DataFrame) -> DataFrame:
    """Evidence with the members that rules read as columns ``_t_<name>``.

    Both steps are generators of one row: a projection would be merged into what reads it
    and each member would be parsed again wherever it is named.
    """
    shape = "struct<" + ", ".join([f"{m}:string" for m in TEXTS] + [f"{m}:variant" for m in [*NUMBERS, *FLAGS]]) + ">"
    read_once = F.struct(F.try_variant_get("attributes", "$", shape).alias("_a"))
    a = evidence.select("*", F.inline(F.array(read_once)))
    texts = [F.coalesce(F.col(f"_a.{m}"), F.lit("")).alias(f"_t_{m}") for m in TEXTS]
    taken = a.select(*evidence.columns, F.inline(F.array(F.struct(*texts, *[F.col(f"_a.{m}").alias(f"_v_{m}") for m in [*NUMBERS, *FLAGS]]))))
    flag = lambda v: F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & member(v, "", "boolean"), F.lit(False))
    read = [*[js_number(F.col(f"_v_{m}"), "").alias(f"_t_{m}") for m in NUMBERS], *[flag(F.col(f"_v_{m}")).alias(f"_t_{m}") for m in FLAGS]]
    return taken.select(*evidence.columns, *[f"_t_{m}" for m in TEXTS], F.inline(F.array(F.struct(*read))))


def hits(rules: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """One row per rule and evidence it fires on: with ``external_key`` and the severity that holds.

    ``attributes`` is VARIANT.  Rules have rule_code, connector_code and severity; a rule
    without a predicate finds nothing.
    """
    spoken = evidence.join(rules.select("connector_code").distinct(), "connector_code", "left_semi")
    built = {name: make(lambda m: F.col(f"_t_{m}"), F.col("source_event_id"), now) for name, make in PREDICATES.items()}
    none = F.lit(None).cast("string")
    found = [F.when(p.hit, F.struct(F.lit(name).alias("rule_code"), p.key.alias("external_key"), (none if p.severity is None else p.severity).alias("_severity"))) for name, p in built.items()]
    fired = typed(spoken).select(*evidence.columns, F.inline(F.array_compact(F.array(*found))))
    met = fired.join(rules, ["connector_code", "rule_code"])
    return met.withColumn("severity", F.coalesce("_severity", "severity")).drop("_severity")


def collapse(fired: DataFrame, keys: list[str] | None = None, most: int = MATCH_EVIDENCE) -> DataFrame:
    """One match per rule and external key: newest evidence first, at most ``most`` of it.

    The newest observation decides severity (the first by evidence_id on ties).
    ``evidence_hash`` is over the kept evidence only, sorted by id.
    """
    keys = keys or ["rule_code", "external_key"]
    w = Window.partitionBy(*keys).orderBy(F.desc("observed_at"), "evidence_id")
    ranked = fired.withColumn("rn", F.row_number().over(w))
    kept = ranked.where(F.col("rn") <= most).groupBy(*keys).agg(
        F.min_by("evidence_id", "rn").alias("primary_id"),
        F.min_by("severity", "rn").alias("severity"),
        F.max("observed_at").alias("observed_at"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "evidence_id", "content_hash"))), "|"), 256).alias("evidence_hash"),
    )
    return kept


def ranked(matches: DataFrame) -> DataFrame:
    """Matches by severity, then newest first."""
    return matches.orderBy(match_rank(F.col("severity")), F.desc("observed_at"), "rule_code", "external_key")
