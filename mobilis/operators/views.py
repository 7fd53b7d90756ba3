"""Read models for operators' screens: flows, timelines, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import js_number, js_round, js_text
from mobilis.operators.numbering import first_rows, numbered


def flow_nodes(edges: DataFrame) -> DataFrame:
    """Value of each node of a flow diagram: the larger of what comes in and goes out, at least 1."""
    w = F.greatest(F.lit(1), F.col("weight"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.sum(w).alias("out_sum"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.sum(w).alias("in_sum"))
    met = outs.join(ins, "node", "full").fillna(0)
    return met.withColumn("value", F.greatest(F.lit(1), "in_sum", "out_sum"))


def ribbon_offsets(edges: DataFrame, node: str, order: list[str], width: str) -> DataFrame:
    """Where each edge's ribbon starts at its node: the widths of those before it."""
    w = Window.partitionBy(node).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("ribbon_offset", F.coalesce(F.sum(width).over(w), F.lit(0)))


def stance_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts by stance, and the share of staffed desks that contributed, in percent."""
    counts = findings.groupBy(*by).agg(*[F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in ("contributed", "dissent", "abstained")], F.count_if(F.col("stance") != "not_staffed").alias("n_staffed"))
    return counts.withColumn("percent", F.when(F.col("n_staffed") > 0, js_round(F.col("n_contributed") * 100.0 / F.col("n_staffed"))).otherwise(0).cast("long"))


def keyset_page(log: DataFrame, cursor: str, after: int, most: int) -> DataFrame:
    """The rows after a cursor in its order, at most ``most`` and never over 500."""
    return log.where(F.col(cursor) > after).orderBy(cursor).limit(min(most, 500))


def search(policies: DataFrame, query: str, columns: list[str], most: int = 8, excerpt: int = 277) -> DataFrame:
    """Policies that hold the text of a query of two characters or more, any case; with an excerpt of each."""
    if len(query.strip()) < 2:
        return policies.limit(0).withColumn("excerpt", F.lit(""))
    hay = F.lower(F.concat_ws(" ", *columns))
    body = F.col(columns[-1])
    cut = F.when(F.length(body) > excerpt + 3, F.concat(body.substr(1, excerpt), F.lit("..."))).otherwise(body)
    return policies.where(hay.contains(query.strip().lower())).orderBy(policies.columns[0]).limit(most).withColumn("excerpt", cut)


def rise(readings: DataFrame, site: str, at: Column, value: str, hours: int = 3) -> DataFrame:
    """Per site the last reading less the first of the ``hours`` up to it; null with one reading."""
    last = readings.groupBy(site).agg(F.max(at).alias("last_at"))
    near = readings.withColumn("_at", at).join(last, site).where(F.col("_at") >= F.col("last_at") - F.expr(f"INTERVAL {hours} HOURS"))
    order = F.struct("_at", "event_id")
    return near.groupBy(site).agg(
        F.max("last_at").alias("last_at"),
        F.count(F.lit(1)).alias("n_readings"),
        F.when(F.count(F.lit(1)) > 1, F.max_by(value, order) - F.min_by(value, order)).alias("rise"),
    )


def forecast(periods: Column) -> dict[str, Column]:
    """Summary of the first 12 of an array of structs (temperature, unit, precip, text)."""
    first = F.slice(periods, 1, 12)
    return {
        "max_temperature": F.array_max(F.transform(F.filter(first, lambda p: p["unit"] == "F"), lambda p: p["temperature"])),
        "max_precip": F.array_max(F.transform(first, lambda p: F.coalesce(p["precip"], F.lit(0.0)))),
        "thunder_hours": F.size(F.filter(first, lambda p: F.lower(p["text"]).contains("thunder"))),
    }


def connection_status(configured: str, needs_approval: str, default: str) -> Column:
    """How a connector stands: unconfigured ones wait for a permission or a setting."""
    missing = F.when(F.col(needs_approval), "permission_required").otherwise("configuration_required")
    return F.when(~F.col(configured), missing).when(F.col(default) == "configuration_required", "connected").otherwise(F.col(default))


def badges(services: Column, words: dict[str, list[str]], other: str, most: int = 3) -> Column:
    """Categories of an array of services by the first key word each holds; once each, in order."""

    def kind(service: Column) -> Column:
        out = F.lit(other)
        for name, keys in reversed(words.items()):
            hit = F.lit(False)
            for k in keys:
                hit = hit | service.contains(k)
            out = F.when(hit, name).otherwise(out)
        return out

    return F.slice(F.array_distinct(F.transform(services, kind)), 1, most)


#: What a commitment has been through, by the state that shows it.
STAGES = [("requested", "asked"), ("acknowledged", "seen"), ("approved", "accepted"), ("executing", "in progress"), ("verified", "done")]


def stages_done(state: str) -> Column:
    """The stages that a commitment has reached; states off the way show the first alone."""
    out = F.array(F.lit(STAGES[0][1]))
    for k in range(1, len(STAGES)):
        out = F.when(F.col(state) == STAGES[k][0], F.array(*[F.lit(name) for _, name in STAGES[: k + 1]])).otherwise(out)
    return out


#: States in which a recommendation waits for somebody.
PENDING = ["awaiting_acknowledgement", "awaiting_approval", "delegated", "escalated"]


def playbook(v: Column, defaults: dict[str, str]) -> list[Column]:
    """The text fields of a playbook (VARIANT), with ``defaults`` where its author left one out, and the sizes of its lists.

    Lists that are no arrays are empty ones.
    """
    texts = [F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(other)).alias(name) for name, other in defaults.items()]
    lists = [F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")) for name in ("approvals", "commitments")]
    return [*texts, *[F.size(x).alias(name) for x, name in zip(lists, ("approvals", "commitments"), strict=True)]]


#: The wording is a fixed value: titles are compared with what was stored before.
def titles(rule_code: Column, a: Column) -> Column:
    """The title of a match from the attributes (VARIANT) of its first evidence, rule by rule."""

    def named(path: str, other: str) -> Column:
        return F.when(js_text(a, path) != "", js_text(a, path)).otherwise(F.lit(other))

    share = F.floor(js_number(a, "currentSpeedMph") / js_number(a, "freeFlowSpeedMph") * 100 + 0.5).cast("string")
    closed = F.coalesce(F.try_variant_get(a, "$.roadClosure", "boolean"), F.lit(False))
    point = js_text(a, "pointName")
    traffic = lambda kind: F.concat(F.lit(f"{kind} reported on "), named("route", "the Auburn approach"))
    away = F.when(js_text(a, "distanceKm") == "", "in the region").otherwise(F.concat(js_text(a, "distanceKm"), F.lit(" km from Auburn")))
    return (
        F.when(rule_code == "algo-crash", traffic("Crash"))
        .when(rule_code == "algo-incident", traffic("Incident"))
        .when(rule_code == "algo-roadwork", traffic("Roadwork"))
        .when(rule_code == "algo-corridor-congestion", F.concat(js_text(a, "congestionLevel"), F.lit(" congestion on "), js_text(a, "name")))
        .when(rule_code == "city-restriction-in-effect", F.concat(F.lit("City "), js_text(a, "kind"), F.lit(" in effect on "), js_text(a, "road")))
        .when(rule_code == "tomtom-corridor-degraded", F.when(closed, F.concat(F.lit("Road closure reported at "), point)).otherwise(F.concat(point, F.lit(" running at "), share, F.lit("% of free flow"))))
        .when(rule_code == "nws-alert-active", F.concat(js_text(a, "eventName"), F.lit(" in effect for the operating area")))
        .when(rule_code == "usgs-stream-rapid-rise", F.concat(F.lit("Stream stage rising fast at "), js_text(a, "siteName")))
        .when(rule_code == "usgs-earthquake-felt", F.concat(F.lit("M "), js_text(a, "magnitude"), F.lit(" earthquake "), away))
        .when(rule_code == "siem-critical-alert", F.concat(named("title", "Security alert"), F.lit(" affecting operational systems")))
    )


def snapshot_conflict(version: Column, state: Column, evidence_hash: Column, seen_version: Column, seen_state: Column, seen_hash: Column) -> Column:
    """What of a recommendation changed since it was opened: the first of version, state, evidence; else null."""
    return F.when(~version.eqNullSafe(seen_version), "version").when(~state.eqNullSafe(seen_state), "state").when(~evidence_hash.eqNullSafe(seen_hash), "evidence")


def shown_first(rows: DataFrame, key: list[str], preferred: Column, order: list[Column]) -> DataFrame:
    """Per key the first row that ``preferred`` holds for, else the first of all."""
    w = Window.partitionBy(*key).orderBy(F.coalesce(preferred, F.lit(False)).desc(), *order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def flow_scale(flows: DataFrame, height: Column) -> DataFrame:
    """The largest scale at which the load of every node (node, value) fits 78 percent of its height; 3 without any."""
    return flows.agg(F.coalesce(F.min(F.when(F.col("value") != 0, height * 0.78 / F.col("value"))), F.lit(3.0)).alias("scale"))


def first_per(rows: DataFrame, key: str, order: list[Column], n: int = 2) -> DataFrame:
    """The first ``n`` rows of each key: what a smoke scan shows of a connector."""
    return first_rows(rows, [key], order, n)


def dry_run(observed: DataFrame, order: list[Column]) -> DataFrame:
    """Observations with the ids of a dry run, ``connector#index`` from 0, and nothing written."""
    placed = numbered(observed, ["connector_code"], order, "_number")
    return placed.withColumn("evidence_id", F.concat_ws("#", "connector_code", F.col("_number").cast("string"))).drop("_number")
