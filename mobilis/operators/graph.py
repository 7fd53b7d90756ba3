"""Temporal property graph: snapshots, walks, change log and lineage.

Nodes have node_id, node_type, valid_from, valid_until, active; edges have edge_id,
edge_type, src, dst and the same validity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.functions.coerce import canonical_hash, stable_id
from mobilis.functions.time import valid_at
from mobilis.operators.numbering import numbered
from mobilis.sources.folders import stored


def snapshot(nodes: DataFrame, edges: DataFrame, as_of: Column, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (of some types) valid at an instant and the valid edges among them."""
    at = valid_at(F.col("valid_from"), F.col("valid_until"), as_of) & F.col("active")
    live = nodes.where(at if types is None else at & F.col("node_type").isin(types))
    ids = live.select("node_id")
    among = edges.where(at).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return live, among


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, so that an undirected step is an equi-join."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth, path) of all cycle-free walks from the start nodes, up to ``depth`` steps.

    ``start`` has node_id.  Every step is one join of the frontier with the edges; the
    edges and each frontier are stored, so a plan never holds more than one step.
    """
    frontier = start.select("node_id", F.lit(0).cast("long").alias("depth"), F.array("node_id").alias("path"))
    found = frontier
    step = stored(edges.select("src", "dst").distinct())
    for d in range(1, depth + 1):
        met = frontier.join(step, F.col("node_id") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        frontier = stored(met.select(F.col("dst").alias("node_id"), F.lit(d).cast("long").alias("depth"), F.array_append("path", F.col("dst")).alias("path")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def reached(step: DataFrame, start: DataFrame, most: int | None = None, undirected: bool = False) -> DataFrame:
    """(node_id, depth) of all nodes that ``step`` (stored src, dst) leads to, with their distance.

    Distances need no paths: a level is the neighbours of the last that no earlier
    level had, so hubs do not multiply walks.  Each level is stored, so its size is known
    and Spark broadcasts it while it is small; the walk ends with the first empty one, or
    after ``most`` steps.  If ``step`` has every edge both ways, a neighbour lies in the
    last two levels or is new, and no older level is read again.
    """
    frontier = stored(start.select("node_id").distinct())
    seen, d, before = frontier.withColumn("depth", F.lit(0).cast("long")), 0, None
    while most is None or d < most:
        d += 1
        met = step.join(frontier.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        near = frontier if before is None else frontier.unionByName(before)
        before, frontier = frontier, stored(met.join(near if undirected else seen.select("node_id"), "node_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d).cast("long")))
    return seen


def neighborhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` undirected steps with their distance; at most 4 steps."""
    return reached(stored(both_ways(edges).distinct()), start, min(depth, 4), undirected=True)


def impact(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """Directed paths downstream of the start nodes, at most 6 steps, without the start itself.

    :func:`in_order` puts them as a reader expects them.
    """
    return paths(edges, start, min(depth, 6)).where("depth > 0")


def in_order(walked: DataFrame, labels: DataFrame) -> DataFrame:
    """Walked nodes with their label (node_id, label), by depth and then by label and id."""
    return walked.join(labels.select("node_id", "label"), "node_id").orderBy("depth", "label", "node_id")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node_id, direction) of everything up and downstream of the start nodes, however far."""
    down = stored(edges.select("src", "dst").distinct())
    up = down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached(down, start).where("depth > 0").select("node_id", F.lit("down").alias("direction")).unionByName(reached(up, start).where("depth > 0").select("node_id", F.lit("up").alias("direction")))


def change_log(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Versions of entities with the state before and the kind of change.

    Rows have state, geometry and active.  Deactivation and reactivation go before a
    change of geometry, that before one of state; a row that changes nothing is left out.
    """
    w = Window.partitionBy(key).orderBy(*order)
    lagged = versions.withColumns({f"previous_{c}": F.lag(c).over(w) for c in ("state", "geometry", "active")}).withColumn("first", F.row_number().over(w) == 1)
    kind = (
        F.when(F.col("first"), "created")
        .when(F.col("previous_active") & ~F.col("active"), "deactivated")
        .when(~F.col("previous_active") & F.col("active"), "reactivated")
        .when(~F.col("previous_geometry").eqNullSafe(F.col("geometry")), "geometry_updated")
        .when(~F.col("previous_state").eqNullSafe(F.col("state")), "state_updated")
    )
    changed = lagged.withColumn("change_type", kind).where("change_type IS NOT NULL").drop("first", "previous_active", "previous_geometry")
    return changed.withColumn("version", F.row_number().over(w))


#: What a change of a node is; labels, owners and the start of validity are not among it.
NODE_STATE = ["state", "geometry", "quality_flags", "active", "valid_until"]


def state_hash(columns: list[str]) -> Column:
    return canonical_hash(*[F.to_json(F.struct(c)) for c in columns])


def merged(state: DataFrame, batch: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Stored entities after a batch (one row a key), with ``change`` and the next version.

    A row whose hash over ``columns`` is the stored one is unchanged, whatever else
    differs, and keeps what is stored; entities the batch does not name are untouched.
    """
    columns = columns or NODE_STATE
    old = state.withColumn("old_hash", state_hash(columns)).select(key, F.struct(*[c for c in state.columns if c not in (key, "version")]).alias("old"), "old_hash", "version")
    kept = [c for c in state.columns if c not in (key, "version")]
    new = batch.withColumn("new_hash", state_hash(columns)).select(key, F.struct(*kept).alias("new"), "new_hash")
    met = old.join(new, key, "full")
    change = F.when(F.col("new_hash").isNull(), "untouched").when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    row = F.when(change.isin("created", "updated"), F.col("new")).otherwise(F.col("old"))
    version = F.coalesce("version", F.lit(0)) + change.isin("created", "updated").cast("long")
    return met.select(key, row.alias("row"), version.alias("version"), change.alias("change")).select(key, "row.*", "version", "change")


def ledger(batches: DataFrame, order: list[str]) -> DataFrame:
    """What becomes of each batch: a key applies once, again it is replayed, with another body it conflicts."""
    w = Window.partitionBy("idempotency_key").orderBy(*order)
    first = F.first("body_hash").over(w)
    outcome = F.when(F.row_number().over(w) == 1, "applied").when(first == F.col("body_hash"), "replayed").otherwise("conflict")
    return batches.withColumn("outcome", outcome)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges that leave (up) and reach (down) each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(True).alias("up")), F.struct(F.col("dst").alias("node_id"), F.lit(False).alias("up")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.count_if("e.up").alias("n_up"), F.count_if(~F.col("e.up")).alias("n_down"))


def split_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an edge needs both its ends among the active nodes."""
    ids = nodes.where("active").select("node_id").distinct()
    ends = edges.join(ids.select(F.col("node_id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(ids.select(F.col("node_id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    whole = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    reason = F.when(F.col("has_src").isNull(), "unknown_source").otherwise("unknown_target")
    return ends.where(whole).drop("has_src", "has_dst"), ends.where(~whole).withColumn("reason", reason).drop("has_src", "has_dst")


def stale(nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """Nodes and edges that are over, flagged stale, or from a source in bad health."""
    bad = (F.col("valid_until") <= now) | F.array_contains("quality_flags", "stale") | F.col("health").isin("delayed", "unavailable")
    bad = F.coalesce(bad, F.lit(False))
    a = nodes.where(bad).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "label")
    return a.unionByName(edges.where(bad).select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "label"))


def lineage_edges(links: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Typed edges from tables of pairs: {edge_type: (table, from column, to column)}; duplicates stay."""
    out = None
    for kind, (table, a, b) in links.items():
        part = table.select(F.lit(kind).alias("edge_type"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"))
        out = part if out is None else out.unionByName(part)
    key = F.concat_ws(":", "edge_type", "src", "dst")
    return out.withColumn("edge_id", stable_id(F.lit("edge"), key))


#: States in which a recommendation or commitment is closed.
CLOSED_RECOMMENDATION = ["approved", "rejected", "expired", "superseded"]
CLOSED_COMMITMENT = ["verified", "failed", "expired", "cancelled"]


def lineage(incidents: DataFrame, recommendations: DataFrame, evidence: DataFrame, findings: DataFrame, decisions: DataFrame, commitments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the way from evidence to verification.

    Nodes have node_id, node_type, label, flag: seven types, each id once (evidence of
    several recommendations counts for the first, by their order ``rank``).  A finding
    cites evidence that its recommendation or one of a smaller rank has; other citations
    are left out.  A commitment hangs on its decision, else on its recommendation, else on
    nothing.  Earlier decisions of a recommendation stay, flagged as historical.  ``place`` is
    the order in which rows came: findings of one id show what that of the smallest rank says,
    the first of these, and of decisions alike in time and id the first is the current one.

    incidents(incident_id, title); recommendations(recommendation_id, incident_id, rank,
    action, state); evidence(recommendation_id, evidence_id, summary); findings(
    recommendation_id, desk_code, status, created_at, cited, place); decisions(decision_id,
    recommendation_id, action, actor, decided_at, place); commitments(commitment_id,
    decision_id, recommendation_id, outcome, state, rule).  Ids are text, cited an array.
    """

    def node(df: DataFrame, kind: str, key: str | Column, label: str | Column, flag: Column) -> DataFrame:
        key, label = (F.col(c) if isinstance(c, str) else c for c in (key, label))
        return df.select(key.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), flag.alias("flag"))

    def edge(df: DataFrame, kind: str | Column, src: str, dst: str) -> DataFrame:
        return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), F.col(src).alias("src"), F.col(dst).alias("dst"))

    known = recommendations.join(incidents.select("incident_id", F.lit(True).alias("has_incident")), "incident_id", "left")
    of = known.select("recommendation_id", "incident_id", "rank", "has_incident")
    placed = evidence.join(of, "recommendation_id")
    first = placed.groupBy("evidence_id").agg(F.min("rank").alias("first_rank"), F.min_by("summary", "rank").alias("summary"))
    spoken = findings.join(of, "recommendation_id").withColumn("finding_id", stable_id(F.lit("finding"), F.concat_ws(":", "incident_id", "desk_code", F.col("created_at").cast("string"))))
    cites = spoken.select("finding_id", "rank", F.explode(F.array_distinct("cited")).alias("evidence_id")).join(first.select("evidence_id", "first_rank"), "evidence_id").where("first_rank <= rank")
    said = spoken.groupBy("finding_id").agg(F.min_by(F.struct("desk_code", "status"), F.struct("rank", "place")).alias("said")).select("finding_id", "said.*")
    latest = F.row_number().over(Window.partitionBy("recommendation_id").orderBy(F.desc("decided_at"), F.desc("decision_id"), "place")) == 1
    marked = decisions.withColumn("latest", latest)
    ends = commitments.join(decisions.select("decision_id", F.lit(True).alias("has_decision")), "decision_id", "left").join(of.select("recommendation_id", F.lit(True).alias("has_recommendation")), "recommendation_id", "left")
    verified = commitments.where("state = 'verified'").withColumn("verification_id", stable_id(F.lit("verification"), F.col("commitment_id")))

    def current(state: str, closed: list[str]) -> Column:
        return F.when(F.col(state).isin(closed), "closed").otherwise("current")

    nodes = (
        node(incidents, "incident", "incident_id", "title", F.lit("current"))
        .unionByName(node(recommendations, "recommendation", "recommendation_id", "action", current("state", CLOSED_RECOMMENDATION)))
        .unionByName(node(first, "evidence", "evidence_id", "summary", F.lit("current")))
        .unionByName(node(said, "finding", "finding_id", F.concat_ws(" · ", "desk_code", "status"), F.when(F.col("status") == "abstained", "abstained").otherwise("contributed")))
        .unionByName(node(marked, "decision", "decision_id", F.concat_ws(" · ", F.regexp_replace("action", "_", " "), "actor"), F.when(F.col("latest"), "current").otherwise("historical")))
        .unionByName(node(commitments, "commitment", "commitment_id", "outcome", current("state", CLOSED_COMMITMENT)))
        .unionByName(node(verified, "verification", "verification_id", "rule", F.lit("current")))
    )
    edges = (
        edge(known.where("has_incident"), "triggered", "incident_id", "recommendation_id")
        .unionByName(edge(placed, "supports", "evidence_id", "recommendation_id"))
        .unionByName(edge(placed.where("has_incident"), "supports", "evidence_id", "incident_id"))
        .unionByName(edge(spoken.where("has_incident"), "informed", "finding_id", "incident_id"))
        .unionByName(edge(spoken, "informed", "finding_id", "recommendation_id"))
        .unionByName(edge(cites, "supports", "evidence_id", "finding_id"))
        .unionByName(edge(decisions, F.when(F.col("action") == "approve", "approved").otherwise(F.col("action")), "recommendation_id", "decision_id"))
        .unionByName(edge(ends.where("has_decision"), "assigned", "decision_id", "commitment_id"))
        .unionByName(edge(ends.where("has_decision IS NULL AND has_recommendation"), "assigned", "recommendation_id", "commitment_id"))
        .unionByName(edge(verified, "verified", "commitment_id", "verification_id"))
    )
    return nodes, edges


def _parts(child: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """The rows of each key as an ordered array of structs without the key."""
    columns = [c for c in child.columns if c != key]
    rank = F.struct(*order, *[c for c in columns if c not in order])
    found = child.groupBy(key).agg(F.array_sort(F.collect_list(rank)).alias("rows"))
    return found.select(key, F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias(name))


def decision_documents(recommendations: DataFrame, incidents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """recommendation_id and lineage: the recommendation, its incident and its children as one JSON document.

    ``children`` gives each part its rows (with recommendation_id) and their order.  Every
    part is grouped on recommendation_id before it is joined on it, so that each table
    moves once and no join multiplies rows; only recommendations move twice, as they meet
    their incident first.  Members that are null stay in the document, a part without rows
    is an empty array, and a recommendation without an incident has no document.
    """
    recommendation = F.struct(*recommendations.columns).alias("recommendation")
    incident = F.struct(*incidents.columns).alias("incident")
    met = recommendations.select("recommendation_id", "incident_id", recommendation).join(incidents.select("incident_id", incident), "incident_id").drop("incident_id")
    for name, (child, order) in children.items():
        met = met.join(_parts(child, "recommendation_id", name, order), "recommendation_id", "left")
        met = met.withColumn(name, F.coalesce(name, F.array().cast(met.schema[name].dataType)))
    document = F.struct("recommendation", "incident", *children)
    return met.select("recommendation_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("lineage"))


def columns_of(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node_id, column) of the nodes of an acyclic graph: how many edges the longest path to a node has.

    Round d holds the nodes that some path of d edges leads to; each is stored, and the last
    round that has a node is its column.  A walk that is not over after ``most`` rounds goes
    round in a circle and is refused.
    """
    step = stored(edges.select("src", "dst").distinct())
    frontier = stored(step.select(F.col("src").alias("node_id")).distinct().join(step.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti"))
    found, d = frontier.withColumn("column", F.lit(0).cast("long")), 0
    while True:
        d += 1
        met = step.join(frontier.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        frontier = stored(met)
        if not frontier.head(1):
            break
        if d >= most:
            raise ValueError(f"there is a path of {most} edges or a circle")
        found = found.unionByName(frontier.withColumn("column", F.lit(d).cast("long")))
    return found.groupBy("node_id").agg(F.max("column").alias("column"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight), those between the same two nodes as one with their weights summed."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def layered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a view in columns, of edges (src, dst, weight).

    Nodes have node_id, column (by the longest path), position (from 0 within its column),
    n_in and n_out, the weights that reach and leave them.  Edges between the same two nodes
    are one, their weights summed.  The first column is in order of ids; in each later one a
    node stands by the weighted mean position of what leads to it, ties by id.
    """
    summed = stored(merged_edges(edges))
    column = stored(columns_of(summed))
    # each edge meets the column that it leads to once; a round reads only its own
    placing = stored(summed.join(column.select(F.col("node_id").alias("dst"), "column"), "dst"))
    last = column.agg(F.max("column")).first()[0]
    placed = stored(numbered(column.where("column = 0"), ["column"], ["node_id"], "position"))
    for c in range(1, (last or 0) + 1):
        into = placing.where(F.col("column") == c).join(placed.select(F.col("node_id").alias("src"), "position"), "src")
        mean = into.groupBy(F.col("dst").alias("node_id"), "column").agg((F.sum(F.col("weight") * F.col("position")) / F.sum("weight")).alias("mean"))
        placed = placed.unionByName(numbered(mean, ["column"], ["mean", "node_id"], "position").drop("mean"))
        placed = stored(placed) if c % 4 == 0 else placed
    loads = summed.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).cast("long").alias("n_in"), F.col("weight").alias("n_out")), F.struct(F.col("dst").alias("node_id"), F.col("weight").alias("n_in"), F.lit(0).cast("long").alias("n_out")))).alias("e"))
    load = loads.groupBy("e.node_id").agg(F.sum("e.n_in").alias("n_in"), F.sum("e.n_out").alias("n_out"))
    return placed.join(load, "node_id").select("node_id", "column", "position", "n_in", "n_out"), summed
