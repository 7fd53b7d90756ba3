"""Tables that change together: all or nothing, one writer at a time, lookups that open little."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from mobilis.operators import ingest
from mobilis.sources.folders import new_folder
from mobilis.sources.store import Conflict, Store

TABLES = {"items": ("id long, name string", ["id"]), "log": ("id long, what string", [])}


def store(spark, **more):
    return Store(spark, new_folder(spark, "stores"), TABLES, 4, **more)


def put(s, rows, base=None):
    """Upsert items and log them."""
    base = base or s.state()
    new = s.spark.createDataFrame(rows, "id long, name string")
    buckets = s.touched("items", new, base)
    kept = s.read("items", base, buckets).join(new, "id", "left_anti")
    return s.commit(base, {"items": (kept.unionByName(new), buckets)}, {"log": new.select("id", F.lit("put").alias("what"))})


def content(s, state=None):
    return sorted(map(tuple, s.read("items", state).collect())), s.read("log", state).count()


def test_a_commit_rewrites_the_touched_buckets_only(spark):
    s = store(spark)
    assert content(s) == ([], 0)
    first = put(s, [(k, f"a{k}") for k in range(40)])
    second = put(s, [(3, "b3"), (100, "b100")])
    assert content(s) == (sorted([(k, "b3" if k == 3 else f"a{k}") for k in range(40)] + [(100, "b100")]), 42)
    assert content(s, first) == ([(k, f"a{k}") for k in range(40)], 40)  # a reader that holds it still sees it
    moved = {b for b, c in second.keyed["items"].items() if first.keyed["items"].get(b) != c}
    assert 1 <= len(moved) <= 2
    for k in range(3):
        put(s, [(3, f"c{k}")])
    gone = set(first.keyed["items"].values()) - set(s.state().keyed["items"].values())
    names = s._names("data")
    assert content(s)[1] == 45 and all(not s._names("data", c, "items") for c in gone if c in names)
    s.compact("log")
    assert len(s.state().logs["log"]) == 1 and content(s)[1] == 45


def test_two_writers_on_one_state(spark):
    s = store(spark)
    base = s.state()
    put(s, [(1, "first")], base)
    with pytest.raises(Conflict):
        put(s, [(2, "second")], base)
    assert content(s) == ([(1, "first")], 1)
    assert len(s._names("data")) == 1  # what the second wrote is gone


NODE = "node_id string, node_type string, label string, state string, geometry string, quality_flags array<string>, active boolean, valid_from timestamp_ntz, valid_until timestamp_ntz, evidence_ids array<string>"
EDGE = "edge_id string, edge_type string, src string, dst string, state string, geometry string, quality_flags array<string>, active boolean, valid_from timestamp_ntz, valid_until timestamp_ntz, evidence_ids array<string>"


def batch(spark, nodes, edges):
    n = [(k, "t", f"label {k}", state, None, [], active, None, None, ev) for k, state, active, ev in nodes]
    e = [(f"{a}>{b}", "t", a, b, state, None, None, True, None, None, None) for a, b, state in edges]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def tables(s):
    return {t: sorted(map(repr, s.read(t).collect())) for t in ingest.TABLES}


def test_a_batch_that_dies_between_two_tables_leaves_nothing(spark, monkeypatch):
    s = ingest.graph_store(spark, new_folder(spark, "graphs"), 4)
    known = spark.createDataFrame([("e1",), ("e2",)], "evidence_id string")
    one = batch(spark, [("a", "x", True, ["e1", "e9"]), ("b", None, True, None)], [("a", "b", "s"), ("a", "c", "s")])
    taken = ingest.ingest(s, "src", "r1", *one, known)
    assert (taken.outcome, taken.status, taken.n_nodes, taken.n_edges, taken.n_unchanged, taken.n_rejected) == ("applied", "partial", 2, 1, 0, 1)
    before = tables(s)
    assert [r.evidence_id for r in s.read("evidence").collect()] == ["e1"]
    two = batch(spark, [("a", "y", True, ["e1", "e2"]), ("b", None, False, None), ("c", "z", True, None)], [("a", "c", "s"), ("a", "b", "s")])
    plain, done = Store._written, []

    def dies(self, commit, name, rows, state):
        if len(done) == 2:
            raise OSError("the machine is gone")
        done.append(name)
        return plain(self, commit, name, rows, state)

    monkeypatch.setattr(Store, "_written", dies)
    with pytest.raises(OSError):
        ingest.ingest(s, "src", "r2", *two, known)
    assert tables(s) == before  # two tables were written, and none is seen
    monkeypatch.setattr(Store, "_written", plain)
    taken = ingest.ingest(s, "src", "r2", *two, known)
    assert (taken.status, taken.n_nodes, taken.n_edges, taken.n_unchanged, taken.n_rejected) == ("partial", 3, 1, 0, 1)
    after = tables(s)
    assert ingest.ingest(s, "src", "r2", *two, known) == ingest.Taken("r2", "replayed", "partial", 3, 1, 0, 1)
    assert ingest.ingest(s, "src", "r2", *one, known).outcome == "conflict"
    assert ingest.ingest(s, "src", "r1", *one, known).outcome == "replayed"
    assert tables(s) == after
    kinds = {(r.entity_id, r.change_type, r.version) for r in s.read("changes").where("request_id = 'r2'").collect()}
    assert kinds == {("a", "state_updated", 2), ("b", "deactivated", 2), ("c", "created", 1), ("a>c", "created", 1)}
    assert s.read("outbox").count() == 2 and s.read("ledger").count() == 2
    empty = ingest.ingest(s, "src", "r3", *batch(spark, [], []), known)
    assert (empty.status, empty.n_nodes, empty.n_edges) == ("succeeded", 0, 0)
    with pytest.raises(ValueError):
        ingest.ingest(s, "src", "r4", *two, known, most_nodes=2)


def test_batches_of_two_writers_are_both_taken(spark):
    s = ingest.graph_store(spark, new_folder(spark, "graphs"), 4)
    known = spark.createDataFrame([], "evidence_id string")
    parts = [batch(spark, [(f"n{w}-{k}", "x", True, None) for k in range(5)], []) for w in range(2)]
    with ThreadPoolExecutor(2) as pool:
        taken = list(pool.map(lambda w: ingest.ingest(s, "src", f"r{w}", *parts[w], known), range(2)))
    assert [t.outcome for t in taken] == ["applied"] * 2 and [t.n_nodes for t in taken] == [5, 5]
    assert s.read("nodes").count() == 10 and s.read("ledger").count() == 2 and s.state().version == 2
