"""Operators on embeddings and pages against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mobilis.llm import stages, urls, vectors

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("a.example.com", "/", "block")]


def verdict(u):
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["example.com", "A.Example.com", "b.a.example.com", "net", "x.net", "example.net", "com", "xcom", "", "org.", "o.org", "example.com:80"]
    paths = ["", "/", "/en/", "/en/7", "/en/70/x", "/de/8", "/de/", "/es/1?q=/en/", "?x", "#/en/", "/EN/"]
    made = [(k, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "class") for k in range(400)]
    made += [(900, None, "x"), (901, "nothing", "x"), (None, "http://com/en/", "x"), (1, made[1][1], "x")] + [(2000 + k, "http://example.com/en/1", "x") for k in range(300)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge_urls(spark.createDataFrame(made, "page_id long, url string, rule string"), rules).collect()
    want = sorted(((k, *verdict(u)) for k, u, _ in made), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_a_host_with_half_of_the_rows_is_split(spark):
    n = 20_000
    made = spark.range(n).selectExpr("id AS page_id", "concat('http://', if(id % 2 = 0, 'hot.example.com', concat('h', id, '.net')), '/en/', id % 9) AS url")
    rules = spark.createDataFrame([*RULES, *RULES[:2]], "host string, path string, verdict string")
    judged = urls.judge_urls(made, rules)
    sizes = [r["count"] for r in judged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == n and len(sizes) == 4
    assert max(sizes) <= 2 * n / len(sizes)
    assert judged.where("host = 'hot.example.com' AND rule = 'example.com/en/7'").count() == n // 2 // 9


def test_very_long_urls_and_equal_rules(spark):
    long = "http://x.com/en/" + "a" * 300_000
    rules = spark.createDataFrame([("com", "/en/", "block"), ("COM", "/en/", "allow"), (None, "/", "block"), ("x.com", "/en/" + "a" * 200_000, "block")], "host string, path string, verdict string")
    got = urls.judge_urls(spark.createDataFrame([(1, long), (2, "http://com/en/"), (2, "http://com/en/")], "page_id long, url string"), rules).collect()
    assert [(r.page_id, len(r.rule), r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == [(1, 5 + 4 + 200_000, "block"), (2, 7, "allow"), (2, 7, "allow")]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_VECTORS", 60)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    for k in range(120):
        x[200 + k] = x[k % 4] + rng.normal(size=16) * 0.06
    made = [(k, [float(v) for v in row], 1) for k, row in enumerate(x.tolist())]
    made += [(1000 + k, made[7][1], 1) for k in range(5)]
    made += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [None] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [1.0, 2.0], 1), (2005, [], 1)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>, rep int")
    result = vectors.near_vectors(table)
    got = {r.vec_id: r for r in result.collect()}
    y = np.array([r[1] for r in made[:405]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    true = {made[k][0]: int(n) for k, n in enumerate(link.sum(axis=1))}
    assert sum(got[k].n_links for k in true) >= 0.9 * sum(true.values())
    assert all(got[k].n_links <= n for k, n in true.items())
    assert all(got[k].n_links == 0 and got[k].kept and got[k].component_id == k for k in range(2000, 2006))
    assert {got[1000 + k].component_id for k in range(5)} == {7}
    assert vectors.audit(table, result) >= 0.9
    assert vectors.near_vectors(table.limit(0)).count() == 0


def linked_groups(rng, n_groups, size, cosine=0.96, dims=64):
    """Tight groups of near copies whose centres have the given cosine to each other."""
    axes = np.linalg.qr(rng.normal(size=(dims, n_groups + 1)))[0].T
    centres = cosine**0.5 * axes[0] + (1 - cosine) ** 0.5 * axes[1:]
    return np.repeat(centres, size, axis=0) + rng.normal(size=(n_groups * size, dims)) * 0.001


def test_vectors_of_dense_groups(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([linked_groups(rng, 4, 60), linked_groups(rng, 2, 60), linked_groups(rng, 1, 150), linked_groups(rng, 1, 40) + rng.normal(size=(40, 64)) * 0.02])
    made = [(k, row) for k, row in enumerate(x.tolist())]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>")).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    assert [got[k].n_links for k in range(len(x))] == link.sum(axis=1).tolist()
    assert {got[k].component_id for k in range(240)} == {0}
    assert {got[k].component_id for k in range(240, 360)} == {240}


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 8))
    near = base + rng.normal(size=(5, 8)) * 0.01
    made = [(None, base[0]), (3, near[0]), (None, base[1]), (None, near[1]), (7, base[2]), (7, base[2]), (7, near[2]), (9, base[3]), (9, base[4]), (11, near[4]), (None, base[3] * 5)]
    rows = [(k, [float(c) for c in v], "clash") for k, v in made]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string").withColumn("key", F.lit(b"x"))
    got = vectors.near_vectors(table).collect()
    assert len(got) == len(made)
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)
    # the rows of id 9 are two vectors, which join what each is linked with
    want = [(None, 1, 3, False), (3, 1, 3, True), (None, 1, None, True), (None, 1, None, True), *[(7, 2, 7, True)] * 3, (9, 1, 9, True), (9, 1, 9, True), (11, 1, 9, False), (None, 1, 9, False)]
    assert found == sorted(want, key=str)


def test_search_follows_edges_only():
    rng = np.random.default_rng(6)
    x = vectors.unit(np.concatenate([rng.normal(size=(60, 16)), linked_groups(rng, 1, 40, dims=16), linked_groups(rng, 1, 40, dims=16)]))
    edges = vectors.both_ways(vectors.robust_pruned(x))
    q, v = vectors.range_search(x, *edges, 0, 0.95)
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    assert true[q, v].all() and len(q) >= 0.99 * true.sum()
    # without edges nothing but the medoid is compared
    none = np.full((len(x), 1), -1)
    q, v = vectors.range_search(x, *vectors.both_ways(none), 0, 0.95)
    assert set(v.tolist()) <= {0}


def test_a_block_of_near_vectors_is_searched_in_bounded_memory():
    rng = np.random.default_rng(8)
    size = 2000
    x = vectors.unit(rng.normal(size=(1, 64)) + rng.normal(size=(size, 64)) * 0.05)
    edges = vectors.robust_pruned(x)
    lists = [edges[row][edges[row] >= 0].tolist() for row in range(size)]
    columns = {"shard": [0] * size, "i": [0] * size, "j": [0] * size, "own": [0] * size, "rep": range(size), "n": [1] * size, "raw": [row.tobytes() for row in x], "shards": [[0]] * size, "edges": lists}
    table = pa.table({c: pa.array(list(v)) for c, v in columns.items()})
    tracemalloc.start()
    try:
        (out,) = vectors._searched(0.95)(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    told = out.to_pydict()
    near = x @ x.T >= 0.95
    assert {r: n for r, n, to in zip(told["rep"], told["n"], told["to"], strict=True) if to is None} == {r: int(n) - 1 for r, n in enumerate(near.sum(axis=1)) if n > 1}
    assert peak < 150e6


@pytest.mark.parametrize("scale, rows", [("0.01", 500), ("0.1", 2000)])
def test_links_of_given_tables(spark, scale, rows):
    """Ids divisible by 50 against all rows, at two sizes: nearly all links are found, and none that is not there."""
    table = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    made = {r.vec_id: r.embedding for r in table.collect()}
    assert len(made) == rows
    x = np.array([made[k] for k in sorted(made)], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {k: int((x @ x[at] >= 0.95).sum()) - 1 for at, k in enumerate(sorted(made)) if k % 50 == 0}
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(table).collect()}
    assert sum(got[k] for k in true) >= 0.9 * sum(true.values())
    assert all(got[k] <= n for k, n in true.items())


def test_stages_hand_few_rows_to_a_worker_at_once(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        stages.quality_rules(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
        sizes = spark.range(5000).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 5000 and max(r.n for r in sizes) <= stages.BATCH_ROWS
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
