"""Queries of reference layers, roads, point lookups and profiles."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.functions.arrays import last_of_each
from mobilis.operators import profiles, roads
from mobilis.plans.common import EV, catalogue, evidence, table
from mobilis.sources import canonical, feeds, layers
from mobilis.sources.folders import new_folder
from mobilis.sources.store import Store

Q, SQL, query = catalogue()

_T0 = datetime(2024, 1, 31)
BOX = (32.58, -85.55, 32.65, -85.42)


def _published(spark: SparkSession, sf: str, edition: int) -> str:
    """Land what the source publishes: suppliers as signals, one in seven without a facility."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    lon, lat = (F.lit(-85.57) + (k * 7 % 180) / 1000), (F.lit(32.55) + (k * 11 % 120) / 1000)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(k.alias("OBJECTID"), F.when(k % 7 != 2, F.concat(F.lit(f"edition {edition} "), "s_name")).alias("FacilityID"), F.col("s_nationkey").alias("MountApp")).alias("properties"),
    )
    folder = new_folder(spark, "landed")
    s.select(F.to_json(feature).alias("value")).write.text(folder)
    return folder


@query("""WITH s AS (SELECT s_suppkey AS k, s_name, -85.57 + (s_suppkey * 7 % 180) / 1000 AS lon, 32.55 + (s_suppkey * 11 % 120) / 1000 AS lat FROM supplier),
r AS (SELECT * FROM (VALUES (0, 1, 0), (11, 1, 0), (12, 2, 12)) AS r(hour, edition, fetched))
SELECT CAST(hour AS BIGINT) AS hour, TIMESTAMP '2024-01-31' + to_hours(fetched) AS fetched_at, CAST(k AS VARCHAR) AS object_id, CASE WHEN k % 7 <> 2 THEN 'edition ' || edition || ' ' || s_name END AS facility FROM s, r
WHERE lat BETWEEN 32.58 AND 32.65 AND lon BETWEEN -85.55 AND -85.42""")
def reference_layer_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """A layer read at once, eleven hours later from the snapshot, and after twelve from a new edition."""
    folder, fields = new_folder(spark, "layers"), ["OBJECTID", "FacilityID", "MountApp"]
    out = None
    for hour, edition in ((0, 1), (11, 2), (12, 2)):

        def fetch(edition: int = edition) -> DataFrame:
            lines = canonical.raw(spark, _published(spark, sf, edition))
            return layers.typed_features(canonical.parsed(lines)[0], fields)

        layer = layers.reused(spark, folder, "signals", _T0 + timedelta(hours=hour), fetch, ["lat", "lon"])
        south, west, north, east = BOX
        seen = layer.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
        part = seen.select(F.lit(hour).cast("long").alias("hour"), F.col("retrieved_at").cast("timestamp_ntz").alias("fetched_at"), F.col("OBJECTID").alias("object_id"), F.col("FacilityID").alias("facility"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT lon, lat, known FROM (SELECT -85.57 + (s_suppkey * 7 % 180) / 1000 AS lon, 32.55 + (s_suppkey * 11 % 120) / 1000 AS lat,
  CASE WHEN s_suppkey % 7 <> 2 THEN 'FacilityID=edition 1 ' || s_name || ';' ELSE '' END || 'OBJECTID=' || s_suppkey AS known FROM supplier) WHERE lat BETWEEN 32.58 AND 32.65 AND lon BETWEEN -85.55 AND -85.42""")
def reference_layer_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points of a layer in a box with the fields that are known."""
    fields = ["OBJECTID", "FacilityID"]
    fetch = lambda: layers.typed_features(canonical.parsed(canonical.raw(spark, _published(spark, sf, 1)))[0], fields)
    layer = layers.reused(spark, new_folder(spark, "layers"), "signals", _T0, fetch, ["lat", "lon"])
    known = F.array_join(F.array_sort(F.transform(F.map_entries("known"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return layers.within(layer, BOX, fields).select("lon", "lat", known.alias("known"))


@query("""SELECT 's' || event_id AS station, 'R' || user_id AS route FROM events WHERE CAST(props->>'$.k' AS BIGINT) % 4 <> 1 AND CAST(props->>'$.k' AS BIGINT) % 5 <> 2""")
def stations_near(spark: SparkSession, sf: str) -> DataFrame:
    """Active count stations near a town, asked of the scan of a stored layer."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    record = F.struct(F.struct(F.concat(F.lit("s"), "event_id").alias("Station"), F.when(F.col("k") % 4 == 1, 0).otherwise(1).alias("IsActive"), F.when(F.col("k") % 5 == 2, "Opelika").otherwise("near Auburn").alias("Location"), F.concat(F.lit("R"), "user_id").alias("RouteID")).alias("attributes"))
    fetch = lambda: layers.typed_stations(canonical.parsed(e.select(F.to_json(record).alias("payload")))[0])
    layer = layers.reused(spark, new_folder(spark, "layers"), "stations", _T0, fetch, ["Location", "Station"])
    return layers.active_near(layer, "Auburn").select(F.col("Station").alias("station"), F.col("RouteID").alias("route"))


# ---- roads -----------------------------------------------------------------------

#: Lines of an order are the ways of a relation; parts and suppliers make the places where they end.
_WAYS = """w AS (SELECT l_orderkey AS relation, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS member, l_partkey % 6 AS a, l_suppkey % 6 AS b FROM lineitem),
d AS (SELECT relation, member, false AS back, a AS tail, b AS head FROM w UNION ALL SELECT relation, member, true, b, a FROM w),
j AS (SELECT relation, tail FROM d GROUP BY ALL HAVING count(*) = 2),
s AS (SELECT x.relation, x.member, x.back, y.member AS m2, y.back AS b2 FROM d x JOIN j ON j.relation = x.relation AND j.tail = x.head JOIN d y ON y.relation = x.relation AND y.tail = x.head AND NOT (y.member = x.member AND y.back <> x.back)),
walk AS (SELECT relation, member, back, member AS m, back AS b, 0 AS n FROM d
  UNION ALL SELECT w.relation, w.member, w.back, s.m2, s.b2, n + 1 FROM walk w JOIN s ON s.relation = w.relation AND s.member = w.m AND s.back = w.b WHERE NOT (s.m2 = w.member AND s.b2 = w.back)),
c AS (SELECT *, arg_max(m, n) OVER g AS last_m, arg_max(b, n) OVER g AS last_b, min(m) OVER g AS least FROM walk WINDOW g AS (PARTITION BY relation, member, back)),
f AS (SELECT c.*, s.m2 IS NOT NULL AS ring FROM c LEFT JOIN s ON s.relation = c.relation AND s.member = last_m AND s.back = last_b),
heads AS (SELECT * FROM f WHERE CASE WHEN ring THEN member = least AND NOT back ELSE (relation, member, back) NOT IN (SELECT (relation, m2, b2) FROM s) AND (member < last_m OR (member = last_m AND NOT back)) END)"""


@query(f"""WITH RECURSIVE {_WAYS}
SELECT h.relation, h.m AS member, min(h.m) OVER (PARTITION BY h.relation, h.member, h.back) AS chain, CAST(h.n AS BIGINT) AS place, h.b AS reversed, ring OR w.a = w.b AS closed FROM heads h JOIN w ON w.relation = h.relation AND w.member = h.m""")
def road_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Where each way of each relation lies in its lines and rings, and whether it is passed backwards."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    # bare keys move, once, and are made into ways where an order's lines have met
    l = table(spark, sf, "lineitem").select("l_orderkey", *keys).repartition("l_orderkey")
    way = lambda m: F.struct(F.lit("way").alias("type"), m["l_suppkey"].alias("ref"), F.array(*[F.struct(F.lit(0.0).alias("lat"), (m[c] % 6).cast("double").alias("lon")) for c in ("l_partkey", "l_suppkey")]).alias("geometry"))
    members = F.transform(F.array_sort(F.collect_list(F.struct(*keys))), way)
    elements = l.groupBy("l_orderkey").agg(members.alias("members")).select(F.to_json(F.struct(F.lit("relation").alias("type"), F.col("l_orderkey").alias("id"), "members")).alias("payload"))
    found = roads.chained(feeds.relation_members(canonical.parsed(elements)[0]))
    return found.withColumn("relation", F.col("relation").cast("long"))


# ---- lookups ---------------------------------------------------------------------


@query(f"WITH {EV} SELECT evidence_id, connector_code, source_event_id, content_hash FROM ev WHERE evidence_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence by id from a store that keeps it in buckets of ids."""
    store = Store(spark, new_folder(spark, "stores"), {"evidence": ("evidence_id long, connector_code string, source_event_id string, content_hash string", ["evidence_id"])}, bloom={"evidence": "evidence_id"})
    store.commit(store.state(), {"evidence": (evidence(spark, sf), list(range(store.buckets)))})
    return store.lookup("evidence", table(spark, sf, "orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("evidence_id")))


# ---- profiles --------------------------------------------------------------------

CATALOGUE = ["system", "tool", "assistant", "search", "user", "draft"]


@query("""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations),
d AS (SELECT conv_id, ' ' || any_value(text ORDER BY turn) || chr(10) AS role, list(role ORDER BY turn) AS tools, list(struct_pack(id := role, title := text, body := turn) ORDER BY turn) AS policies FROM t WHERE text IS NOT NULL GROUP BY 1),
n AS (SELECT conv_id, trim(role, ' ' || chr(10)) AS role, [x FOR x IN ['system', 'tool', 'assistant', 'search', 'user', 'draft'] IF list_contains(tools, x) OR x IN ('search', 'draft')] AS tools,
  [p FOR p, i IN policies IF list_position([q.id FOR q IN policies], p.id) = i] AS policies FROM d)
SELECT conv_id, role, array_to_string(tools, ',') AS tools, array_to_string([p.id || ':' || p.body FOR p IN policies], ',') AS policies, conv_id % 3 <> 1 AS changed, CASE WHEN conv_id % 3 = 1 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS updated_at FROM n""")
def profile_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts of profiles made of conversations: known tools in order, each policy once, unchanged ones keep their time."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line"))))
    policy = lambda t: F.struct(t["role"].alias("id"), t["line"].alias("title"), F.lit("state").alias("jurisdiction"), F.lit(" handbook ").alias("source"), t["turn"].cast("string").alias("body"))
    drafts = c.groupBy("conv_id").agg(turns.alias("turns")).select(
        F.col("conv_id").alias("desk_code"), F.concat(F.lit(" "), F.element_at("turns", 1)["line"], F.lit("\n")).alias("role"), F.lit("").alias("backstory"), F.lit(None).cast("string").alias("instructions"), F.lit(" m ").alias("model"), F.lit(0.125).alias("temperature"),
        F.transform("turns", lambda t: t["role"]).alias("enabled_tools"), F.transform("turns", policy).alias("policies"), F.lit("2024-01-02").cast("timestamp_ntz").alias("submitted_at"),
    )
    none = drafts.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz")).limit(0)
    stored_ = profiles.normalized(drafts.withColumn("submitted_at", F.lit("2024-01-01").cast("timestamp_ntz")), none, CATALOGUE, ["search", "draft"]).where("desk_code % 3 <> 2")
    before = stored_.withColumn("role", F.when(F.col("desk_code") % 3 == 0, "another").otherwise(F.col("role")))
    found = profiles.normalized(drafts, before, CATALOGUE, ["search", "draft"])
    told = F.array_join(F.transform("policies", lambda p: F.concat_ws(":", p["id"], p["body"])), ",")
    return found.select(F.col("desk_code").alias("conv_id"), "role", F.array_join("enabled_tools", ",").alias("tools"), told.alias("policies"), "changed", "updated_at")


@query("""WITH l AS (SELECT l_orderkey, l_partkey % 4 AS id, l_suppkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
f AS (SELECT l_orderkey, id, min(pos) AS first_at, arg_max(v, pos) AS v FROM l GROUP BY 1, 2)
SELECT l_orderkey AS draft_id, string_agg(id || '=' || v, ',' ORDER BY first_at) AS cited FROM f GROUP BY 1""")
def distinct_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Three lists of an order as one: each id where it came first, with what came last for it."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("draft_id")).agg(*[F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, item))).alias(flag) for flag in "RNA"])
    items = F.transform(F.concat("R", "N", "A"), lambda x: F.struct((x["l_partkey"] % 4).alias("id"), x["l_suppkey"].alias("v")))
    kept = F.transform(last_of_each(F.col("items")), lambda x: F.concat_ws("=", x["id"], x["v"]))
    return lists.select("draft_id", items.alias("items")).select("draft_id", F.array_join(kept, ",").alias("cited"))
