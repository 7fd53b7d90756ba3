"""Desks review the evidence they may read: they contribute with citations, or abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import js_number, js_text
from mobilis.functions.text import listed
from mobilis.operators.numbering import first_rows

CARDS = 24
CITED = 12
#: The connectors that each desk may read.
DESK_CONNECTORS = {
    "atlas": ["aldot-algo-traffic-v1", "tomtom-traffic-flow-v1", "aldot-traffic-counts-v1"],
    "sentinel": ["nws-weather-alerts-v1", "auburn-emergency-access-v1"],
    "phoenix": ["auburn-emergency-access-v1", "coa-road-closures-v1"],
    "forge": ["coa-road-closures-v1", "usgs-natural-hazards-v1"],
    "aqua": ["auburn-eta-spot-v1", "auburn-parking-occupancy-v1"],
    "echo": ["aldot-algo-traffic-v1", "siem-alerts-v1"],
}
#: Feeds whose presence raises what a desk may conclude.
PARKING, ACCESS, TRANSIT, SECURITY = "auburn-parking-occupancy-v1", "auburn-emergency-access-v1", "auburn-eta-spot-v1", "siem-alerts-v1"


def visible(evidence: DataFrame, permissions: DataFrame) -> DataFrame:
    """Evidence per desk that may read its connector."""
    return evidence.join(permissions.select("desk_code", "connector_code").distinct(), "connector_code")


def assessed(seen: DataFrame, relevant: Column, desks: DataFrame, confidence: Column, conflict: Column) -> DataFrame:
    """One finding per desk: stance, counts and confidence.

    ``relevant`` marks rows that make a desk contribute; ``confidence`` and
    ``conflict`` are expressions over n_seen and n_relevant.
    """
    counts = seen.groupBy("desk_code").agg(F.count(F.lit(1)).alias("n_seen"), F.count_if(relevant).alias("n_relevant"))
    met = desks.join(counts, "desk_code", "left").fillna(0, ["n_seen", "n_relevant"])
    stance = F.when(F.col("n_seen") == 0, "no_feed").when(F.col("n_relevant") == 0, "abstained").when(conflict, "dissent").otherwise("contributed")
    return met.withColumn("stance", stance).withColumn("confidence", F.when(F.col("n_relevant") > 0, confidence))


def bearing(a: Column, connector: Column) -> list[tuple[str, str, Column]]:
    """(desk, part, condition): what of the evidence bears on a desk's domain, in the order it is cited.

    ``a`` is the VARIANT of attributes.  ``displaying`` marks signs that show text; they
    are counted, and cited as signs.
    """

    def layer(name: str) -> Column:
        return js_text(a, "layer") == name

    current, free = js_number(a, "currentSpeedMph"), js_number(a, "freeFlowSpeedMph")
    slow = F.coalesce((free > 0) & (current / free < 0.6), F.lit(False))
    restricted = js_text(a, "kind") != ""
    pages = F.try_variant_get(a, "$.pages", "array<string>")
    shown = F.coalesce(F.exists(pages, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(False))
    return [
        ("atlas", "events", layer("traffic_event")),
        ("atlas", "congested", layer("travel_time") & ~js_text(a, "congestionLevel").isin("", "Unaffected", "Unknown")),
        ("atlas", "degraded", slow),
        ("sentinel", "alerts", layer("weather_alert")),
        ("sentinel", "thunder", layer("hourly_forecast") & F.coalesce(js_number(a, "thunderstormHours") > 0, F.lit(False))),
        ("phoenix", "restrictions", restricted),
        ("forge", "restrictions", restricted),
        ("forge", "rising", layer("stream_gauge") & F.coalesce(js_number(a, "riseFt") > 0, F.lit(False))),
        ("aqua", "vehicles", connector == TRANSIT),
        ("echo", "signs", layer("message_sign")),
        ("echo", "security", connector == SECURITY),
        ("echo", "displaying", layer("message_sign") & shown),
    ]


def pictures(snapshot: DataFrame) -> DataFrame:
    """desk_code, n_seen, n (map of parts to counts), cited: what each desk makes of a snapshot.

    Evidence has evidence_id, connector_code, observed_at and ``attributes`` (VARIANT);
    newest first, then by evidence_id, is its order.  One pass: each row is tagged with
    the desks it bears on, counts are combined before the shuffle, and each of
    several buckets a desk keeps the first ``CITED`` rows before they meet.  One row a desk, six in all.
    """
    spark = snapshot.sparkSession
    a, c = F.col("attributes"), F.col("connector_code")
    tags = []
    for desk, connectors in DESK_CONNECTORS.items():
        parts = [F.when(F.coalesce(cond, F.lit(False)), part) for d, part, cond in bearing(a, c) if d == desk]
        tags.append(F.when(c.isin(connectors), F.struct(F.lit(desk).alias("desk_code"), F.array_compact(F.array(*parts)).alias("parts"))))
    tagged = snapshot.select("evidence_id", "observed_at", F.explode(F.array_compact(F.array(*tags))).alias("t")).select("evidence_id", "observed_at", "t.*")
    names = sorted({part for _, part, _ in bearing(a, c)})
    counts = tagged.groupBy("desk_code").agg(
        F.count(F.lit(1)).alias("n_seen"), F.create_map(*[x for p in names for x in (F.lit(p), F.count_if(F.array_contains("parts", p)))]).alias("n")
    )
    order = [part for desk in DESK_CONNECTORS for d, part, _ in bearing(a, c) if d == desk and part != "displaying"]
    place = F.array_position(F.array(*[F.lit(p) for p in dict.fromkeys(order)]), F.get("parts", F.lit(0)))
    ranked = tagged.where(F.size("parts") > 0).withColumn("place", place).withColumn("bucket", F.pmod(F.xxhash64("evidence_id"), F.lit(64)))
    by = ["place", F.desc("observed_at"), "evidence_id"]
    few = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("desk_code", "bucket").orderBy(*by))).where(F.col("rn") <= CITED)
    first = few.withColumn("rn", F.row_number().over(Window.partitionBy("desk_code").orderBy(*by))).where(F.col("rn") <= CITED)
    cited_ = first.groupBy("desk_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "evidence_id"))), lambda x: x["evidence_id"]).alias("cited"))
    roster = spark.createDataFrame([(d,) for d in DESK_CONNECTORS], "desk_code string")
    met = roster.join(counts, "desk_code", "left").join(cited_, "desk_code", "left")
    return met.select("desk_code", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "n", F.coalesce("cited", F.array().cast(snapshot.select(F.array("evidence_id").alias("x")).schema["x"].dataType)).alias("cited"))


def findings_on(picture: DataFrame, matches: DataFrame, live: list[str]) -> DataFrame:
    """One finding per match and desk: stance, confidence, concern and citations.

    ``picture`` is :func:`pictures` (six rows, which are broadcast); matches have
    match_id, agent_code, constraints (array) and recommended_action; ``live`` names the
    connectors that reported.  A desk without evidence has no feed; one whose evidence
    does not bear on the match abstains; a concern makes it dissent.
    """

    def n(part: str) -> Column:
        return F.coalesce(F.element_at("n", part), F.lit(0))

    def desk(code: str) -> Column:
        return F.col("desk_code") == code

    other = ~F.col("agent_code").eqNullSafe(F.col("desk_code"))
    corridor = F.exists(F.coalesce("constraints", F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike("(?i)emergency corridor"), F.lit(False)))
    speaks = (
        F.when(desk("atlas"), n("events") + n("congested") + n("degraded") > 0)
        .when(desk("sentinel"), n("alerts") + n("thunder") > 0)
        .when(desk("phoenix"), corridor & (n("restrictions") > 0))
        .when(desk("forge"), n("restrictions") + n("rising") > 0)
        .when(desk("aqua"), n("vehicles") > 0)
        .when(desk("echo"), n("signs") + n("security") > 0)
        .otherwise(False)
    )
    confidence = (
        F.when(desk("atlas"), F.when(n("congested") + n("degraded") > 0, 0.68).otherwise(0.5))
        .when(desk("sentinel"), F.when(n("alerts") > 0, 0.7).otherwise(0.45))
        .when(desk("phoenix"), F.lit(0.62 if ACCESS in live else 0.3))
        .when(desk("forge"), F.lit(0.6))
        .when(desk("aqua"), F.lit(0.6 if PARKING in live else 0.35))
        .otherwise(F.lit(0.55))
    )
    concern = (
        F.when(desk("sentinel") & other & (n("alerts") > 0), "weather")
        .when(desk("phoenix") & F.lit(ACCESS not in live), "corridor")
        .when(desk("forge") & other & (n("rising") > 0), "water")
        .when(desk("echo") & (n("displaying") > 0) & F.coalesce(F.col("recommended_action").rlike("(?i)messag|advis|inform"), F.lit(False)), "message")
    )
    met = matches.crossJoin(F.broadcast(picture))  # six rows
    stance = F.when(F.col("n_seen") == 0, "no_feed").when(~speaks, "abstained").when(concern.isNotNull(), "dissent").otherwise("contributed")
    met = met.withColumn("stance", stance)
    spoke = F.col("stance").isin("dissent", "contributed")
    return met.select(
        "match_id", "desk_code", "n_seen", "stance", F.when(spoke, confidence).alias("confidence"), F.when(spoke, concern).alias("concern"), F.when(spoke, F.col("cited")).otherwise(F.slice("cited", 1, 0)).alias("cited")
    )


def cited(findings: DataFrame, most: int = CARDS) -> DataFrame:
    """Per incident the distinct evidence that its findings cite, in order, at most ``most``."""
    each = findings.select("incident_id", F.explode("cited").alias("evidence_id")).distinct()
    first = first_rows(each, ["incident_id"], [F.asc("evidence_id")], most)
    kept = first.groupBy("incident_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("cited"))
    none = F.array().cast(findings.schema["cited"].dataType)
    return findings.select("incident_id").distinct().join(kept, "incident_id", "left").withColumn("cited", F.coalesce("cited", none))


def composed(findings: DataFrame) -> DataFrame:
    """The summary of each incident: who contributed, who was silent, and whether anyone dissents."""

    def names(stances: list[str]) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("stance").isin(stances), F.col("desk_code"))))

    both = findings.groupBy("incident_id").agg(names(["contributed", "dissent"]).alias("spoke"), names(["abstained", "no_feed"]).alias("silent"), F.count_if(F.col("stance") == "dissent").alias("n_conflicts"))
    text = F.concat(F.when(F.size("spoke") > 0, listed(F.col("spoke"))).otherwise("no desk"), F.lit(" contributed; silent: "), F.when(F.size("silent") > 0, F.array_join("silent", ", ")).otherwise("none"))
    return both.select("incident_id", text.alias("summary"), F.when(F.size("spoke") > 0, "contributed").otherwise("abstained").alias("status"), "n_conflicts")


def invalid_citations(drafts: DataFrame, forbidden: list[str] | None = None, actions: list[str] | None = None) -> DataFrame:
    """Drafts with what disqualifies them: citations not allowed or not read, length, confidence,
    wording that matches a pattern of ``forbidden``, and an action that ``actions`` lacks."""
    unread = F.array_except("cited", F.array_intersect("allowed", "read"))
    faults = [
        F.when(F.size(unread) > 0, "citation"),
        F.when(~F.length("statement").between(12, 600), "length"),
        F.when(~F.col("confidence").between(0.2, 0.85), "confidence"),
    ]
    if forbidden:
        faults.append(F.when(F.coalesce(F.col("statement").rlike("(?i)" + "|".join(forbidden)), F.lit(False)), "wording"))
    if actions is not None:
        faults.append(F.when(~F.coalesce(F.col("action").isin(actions), F.lit(False)), "action"))
    return drafts.withColumn("faults", F.array_compact(F.array(*faults)))


def cards(evidence: DataFrame, desk: str, most: int = CARDS) -> DataFrame:
    """The newest evidence that a desk may read, at most ``most``: what its tools list."""
    seen = evidence.where(F.col("connector_code").isin(DESK_CONNECTORS[desk]))
    return seen.orderBy(F.desc("observed_at"), "evidence_id").limit(most)


def roster(desks: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a desk (desk_code, staffed) by stance: what it says, that it is silent, or that nobody is there."""
    met = desks.join(findings.select("desk_code", "stance"), "desk_code", "left")
    status = F.when(~F.col("staffed"), "not staffed").when(F.col("stance").isin("dissent", "contributed"), F.col("stance")).otherwise("abstained")
    return met.select("desk_code", status.alias("status"))
