"""A batch of nodes, edges and their evidence taken into the graph as one.

The tables of a graph live in a store whose pointer names all of them: a batch is there
with its links, its changes, its place in the ledger and its message, or it is not there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.operators import graph
from mobilis.sources.folders import stored
from mobilis.sources.store import Conflict, State, Store

_STATE = "state string, geometry string, quality_flags array<string>, active boolean, valid_from timestamp_ntz, valid_until timestamp_ntz"
#: Nodes and edges come in these columns without ``version``, and with ``evidence_ids``.
TABLES = {
    "nodes": (f"node_id string, node_type string, label string, {_STATE}, version long", ["node_id"]),
    "edges": (f"edge_id string, edge_type string, src string, dst string, {_STATE}, version long", ["edge_id"]),
    "evidence": ("entity_id string, entity string, evidence_id string", ["entity_id"]),
    "ledger": ("source_id string, request_id string, payload_hash string, status string, n_nodes long, n_edges long, n_unchanged long, n_rejected long", ["source_id", "request_id"]),
    "changes": ("entity string, entity_id string, version long, change_type string, previous_state string, state string, request_id string", []),
    "outbox": ("event_type string, aggregate_id string, payload string", []),
}
EDGE_STATE = ["src", "dst", *graph.NODE_STATE]


@dataclass(frozen=True)
class Taken:
    """What became of a batch: ``applied``, ``replayed`` (with the counts of the first time) or ``conflict``."""

    request_id: str
    outcome: str
    status: str | None = None
    n_nodes: int | None = None
    n_edges: int | None = None
    n_unchanged: int | None = None
    n_rejected: int | None = None


def graph_store(spark: SparkSession, folder: str, buckets: int = 16) -> Store:
    return Store(spark, folder, TABLES, buckets, bloom={"nodes": "node_id", "edges": "edge_id"})


def payload_hash(*tables: DataFrame) -> str:
    """One hash of the rows of some tables, in whatever order they lie."""
    parts = []
    for df in tables:
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        one, two = F.xxhash64(text), F.xxhash64(F.lit(7), text)
        told = df.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum((one % (1 << 31)).cast("decimal(38,0)")), F.bit_xor(two), F.sum((two % (1 << 31)).cast("decimal(38,0)"))).first()
        parts.append("/".join(map(str, told)))
    return tables[0].sparkSession.range(1).select(F.sha2(F.lit(";".join(parts)), 256)).first()[0]


def _merged(store: Store, state: State, name: str, batch: DataFrame, columns: list[str]) -> tuple[DataFrame, list[int]]:
    """The touched buckets after a batch, with what became of each row, and their numbers."""
    (key,) = store.keys[name]
    buckets = store.touched(name, batch, state)
    old = store.read(name, state, buckets)
    now = graph.merged(old, batch.select(*[c for c in old.columns if c != "version"]), key, columns)
    before = old.select(key, F.struct("state", "geometry", "active").alias("before"))
    return stored(now.join(before, key, "left")), buckets


def _changes(now: DataFrame, entity: str, key: str, request_id: str) -> DataFrame:
    was = lambda c: F.col(f"before.{c}")
    kind = (
        F.when(F.col("change") == "created", "created")
        .when(was("active") & ~F.col("active"), "deactivated")
        .when(~was("active") & F.col("active"), "reactivated")
        .when(~was("geometry").eqNullSafe(F.col("geometry")), "geometry_updated")
        .otherwise("state_updated")
    )
    rows = now.where(F.col("change").isin("created", "updated"))
    return rows.select(F.lit(entity).alias("entity"), F.col(key).alias("entity_id"), "version", kind.alias("change_type"), was("state").alias("previous_state"), "state", F.lit(request_id).alias("request_id"))


def _links(rows: DataFrame, entity: str, key: str, known: DataFrame) -> DataFrame:
    each = rows.select(F.col(key).alias("entity_id"), F.lit(entity).alias("entity"), F.explode("evidence_ids").alias("evidence_id")).distinct()
    return each.join(known.select(F.col("evidence_id").cast("string").alias("evidence_id")).distinct(), "evidence_id", "left_semi")


def _count(now: DataFrame) -> tuple[int, int]:
    told = now.agg(F.count_if(F.col("change").isin("created", "updated")), F.count_if(F.col("change") == "unchanged")).first()
    return told[0], told[1]


def _apply(store: Store, state: State, source_id: str, request_id: str, body: str, nodes: DataFrame, edges: DataFrame, known: DataFrame) -> Taken:
    node_rows, node_buckets = _merged(store, state, "nodes", nodes, graph.NODE_STATE)
    # an edge needs both its ends among the active nodes as they are after the batch
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    others = [b for b in store.touched("nodes", ends, state) if b not in node_buckets]
    there = node_rows.select("node_id", "active").unionByName(store.read("nodes", state, others).select("node_id", "active"))
    accepted, rejected = graph.split_edges(edges, there)
    accepted = stored(accepted)
    edge_rows, edge_buckets = _merged(store, state, "edges", accepted, EDGE_STATE)
    links = stored(_links(nodes, "node", "node_id", known).unionByName(_links(accepted, "edge", "edge_id", known)))
    link_buckets = store.touched("evidence", links, state)
    all_links = store.read("evidence", state, link_buckets).unionByName(links.select("entity_id", "entity", "evidence_id")).distinct()
    (n_nodes, same_nodes), (n_edges, same_edges), n_rejected = _count(node_rows), _count(edge_rows), rejected.count()
    taken = Taken(request_id, "applied", "partial" if n_rejected else "succeeded", n_nodes, n_edges, same_nodes + same_edges, n_rejected)
    spark = store.spark
    entry = spark.createDataFrame([(source_id, request_id, body, taken.status, n_nodes, n_edges, taken.n_unchanged, n_rejected)], store.schemas["ledger"])
    ledger_buckets = store.touched("ledger", entry, state)
    counts = F.to_json(F.struct(F.lit(source_id).alias("sourceId"), "n_nodes", "n_edges", "n_unchanged", "n_rejected"))
    message = entry.select(F.lit("graph.batch.ingested").alias("event_type"), F.lit(request_id).alias("aggregate_id"), counts.alias("payload"))
    store.commit(
        state,
        keyed={
            "nodes": (node_rows, node_buckets),
            "edges": (edge_rows, edge_buckets),
            "evidence": (all_links, link_buckets),
            "ledger": (store.read("ledger", state, ledger_buckets).unionByName(entry), ledger_buckets),
        },
        logs={"changes": _changes(node_rows, "node", "node_id", request_id).unionByName(_changes(edge_rows, "edge", "edge_id", request_id)), "outbox": message},
    )
    return taken


def ingest(store: Store, source_id: str, request_id: str, nodes: DataFrame, edges: DataFrame, known: DataFrame, most_nodes: int | None = None, most_edges: int | None = None, tries: int = 5) -> Taken:
    """Take a batch into the graph, all or nothing.

    Nodes are inserted or, if what makes their state differs, rewritten; then edges whose
    ends are active nodes, the others are rejected and make the batch ``partial``; then links
    to evidence that is ``known`` and not linked yet.  A request of a source that came
    before is replayed if its rows are the same and conflicts if they are not; neither
    changes anything.  A batch has one row a key; empty ones are taken in with counts of
    zero.  Nulls in states are values like others, null ``evidence_ids`` are none.  If
    another writer commits meanwhile, the batch is merged again on what it left.
    """
    body = payload_hash(nodes, edges)
    for what, rows, most in (("nodes", nodes, most_nodes), ("edges", edges, most_edges)):
        if most is not None and rows.limit(most + 1).count() > most:
            raise ValueError(f"a batch has at most {most} {what}")
    asked = store.spark.createDataFrame([(source_id, request_id)], "source_id string, request_id string")
    for left in range(tries - 1, -1, -1):
        state = store.state()
        before = store.lookup("ledger", asked, state).head(1)
        if before:
            (row,) = before
            if row.payload_hash != body:
                return Taken(request_id, "conflict")
            return Taken(request_id, "replayed", row.status, row.n_nodes, row.n_edges, row.n_unchanged, row.n_rejected)
        try:
            return _apply(store, state, source_id, request_id, body, nodes, edges, known)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")

