"""Exact search against brute force."""

import math

import numpy as np
import pytest

from mobilis.llm import search

NONE, MOST = -(1 << 63), (1 << 63) - 1


def brute(made, is_query, k):
    """(query_id, rank, vec_id, score) over Python's integers; rows in order stand for their inner numbers."""
    part = [(v, [math.floor(256 * x) for x in e]) for v, e, *_ in made if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (name, x) in enumerate(part):
        if is_query(name):
            found = sorted((-max(min(sum(p * q for p, q in zip(x, y)), MOST), NONE + 1), other, b) for b, (other, y) in enumerate(part) if b != a)
            out += [(name, r + 1, other, -s) for r, (s, other, _) in enumerate(found[:k])]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 8), ("PART_BLOCKS", 3), ("QUERY_GROUP", 4), ("SUMMARY_BLOCKS", 5), ("CENTROIDS", 6)):
        monkeypatch.setattr(search, name, value)


def table():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    x = np.vstack([centres[k % 5] + 0.2 * rng.normal(size=12) for k in range(300)])
    made = [(int(k * 3), [float(v) for v in row], "x", 1) for k, row in enumerate(x.astype(np.float32))]
    made += [(10_000 + k, made[4][1], "copy", 1) for k in range(150)]  # a third of the rows is one vector
    made += [(150, made[9][1], "a repeated id", 2), (-50, [0.0] * 12, "zero", 2), (20_000, [-1.0] * 12, "least", 2), (20_050, [], "empty", 2), (20_100, [5.0], "short", 2), (20_150, [0.1] * 40, "long", 2)]
    made += [(20_200, None, "n", 1), (20_250, [None] * 12, "n", 1), (20_300, [math.nan] * 12, "n", 1), (20_350, [math.inf] + [0.0] * 11, "n", 1), (None, made[0][1], "n", 1)]
    return made


SCHEMA = "vec_id long, embedding array<double>, row string, part long"


def test_search_in_small_blocks(spark, small):
    made = table()
    got = search.top_k(spark.createDataFrame(made, SCHEMA).repartition(5), "vec_id % 50 = 0").collect()
    assert sorted(map(tuple, got)) == brute(made, lambda v: v % 50 == 0, 5)


def test_search_at_its_own_sizes(spark):
    made = table()
    got = search.top_k(spark.createDataFrame(made, SCHEMA), "vec_id % 7 = 0", k=3).collect()
    assert sorted(map(tuple, got)) == brute(made, lambda v: v % 7 == 0, 3)


def test_few_rows_and_large_components(spark):
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-3.0, 1e9])]
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    run = lambda rows: sorted(map(tuple, search.top_k(of(rows), "vec_id % 50 = 0").collect()))
    assert run(few) == brute(few, lambda v: v % 50 == 0, 5)
    large = [(0, [1e15, 1e14]), (50, [1e15, -1e14]), (3, [1.0, 3.0]), (4, [-1e15, 0.0])]
    assert run(large) == brute(large, lambda v: v % 50 == 0, 5)
    assert run([(0, [1.0])]) == [] and run([(1, [1.0]), (2, [2.0])]) == [] and run([]) == []


def test_blocks_are_pruned_by_their_bounds():
    rng = np.random.default_rng(1)
    centres = 50 * rng.normal(size=(40, 16))
    blocks = []
    for k, c in enumerate(centres):
        forward = np.floor(c + 4 * rng.normal(size=(64, 16))).astype(np.int64)
        blocks.append((np.arange(64) + 64 * k, np.arange(64) + 64 * k, forward, forward.max(axis=0)[None, :], forward.min(axis=0)[None, :]))
    every = np.vstack([b[2] for b in blocks])
    queries, own = every[::50], np.arange(len(every))[::50]
    best, scored = search.searched(queries, own, np.full(len(own), NONE), blocks, 5)
    assert scored < 0.3 * len(queries) * len(blocks)
    for k, row in enumerate(own):
        score = every @ every[row]
        want = sorted((-int(s), i) for i, s in enumerate(score) if i != row)[:5]
        assert list(zip((-best.score[k]).tolist(), best.name[k].tolist())) == want
    for block in blocks:
        assert (search.products(queries, block[2]).max(axis=1) <= search.bounds(queries, block[3], block[4])[:, 0]).all()
