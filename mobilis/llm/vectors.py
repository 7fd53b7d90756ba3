"""Near-duplicate embeddings over a robust-pruned flat graph.

1. Equal vectors form a class with a count; one representative goes on.
2. Centroids fitted on a bounded sample (``SAMPLE`` vectors by hash; all vectors are
   indexed whatever the sample) cut space into overlapping shards of about a thousand:
   a vector joins its ``OVERLAP`` nearest.  A shard over ``BLOCK`` is dealt out as pairs
   of blocks.
3. In each block a graph is built by robust pruning, from each node's nearest candidates
   and, in slots of their own, from a random pool: long edges lead out of tight groups.
   The adjacency lists of all shards are united by node.
4. Each block is searched over the united lists, taken both ways: a greedy walk from the
   medoid towards every member, then, from where it ends and from the member itself, the
   range is expanded along edges as long as new nodes lie within it.  Distances are
   computed for nodes that an edge leads to, each once a query, and for no others.
5. Distances are in double precision.  A pair counts in one shard only, the least that
   both are in, so links need no list of pairs; per block a spanning forest of the
   links leads to components.

:func:`audit` measures recall against brute force on a bounded sample of queries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.minhash import Forest, dealt_in_blocks
from mobilis.llm.shared import components, group_cuts, joined_to_unique, map_groups, stored

SAMPLE = 10_000
#: Vectors a centroid; a shard has ``OVERLAP`` times as many.
SHARD_VECTORS = 250
#: Beyond some 500,000 vectors shards grow instead of their number, and are dealt in more pairs of blocks.
MOST_SHARDS = 2048
OVERLAP = 4
BLOCK = 2048
DEGREE = 16
LONG_DEGREE = 8
CANDIDATES = 48
RANDOM_POOL = 64
ALPHA = 1.2
#: Components of vectors compared at once, and queries of a block that search at once: what a dense cluster may hold in memory, not what it may find.
FRONTIER = 1 << 21
QUERIES = 256
_SHARD_STEP = 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centroids are spread evenly over the sample."""
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (sample @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1)
        found = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], found)
    return found


def _pruned(x: np.ndarray, rows: np.ndarray, picks: np.ndarray, cosines: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (sorted, nearest first; cosine -inf: none), -1 where fewer.

    For all rows at once: take the nearest candidate left, then drop those that are
    ``alpha`` times nearer to it than to the row.
    """
    out = np.full((len(rows), degree), -1, dtype=np.int64)
    far = np.sqrt(np.maximum(2 - 2 * cosines, 0))
    open_ = np.isfinite(cosines)
    at = np.arange(len(rows))
    for d in range(degree):
        first = open_.argmax(axis=1)
        live = open_[at, first]
        if not live.any():
            break
        chosen = picks[at, first]
        out[live, d] = chosen[live]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ikj->ik", x[chosen], x[picks]), 0))
        open_ &= ~((alpha * between <= far) & live[:, None])
        open_[at, first] = False
    return out


def robust_pruned(x: np.ndarray, step: int = 256, seed: int = 5) -> np.ndarray:
    """Adjacency (n, DEGREE + LONG_DEGREE) of unit vectors, -1 where a list is shorter."""
    n = len(x)
    out = np.full((n, DEGREE + LONG_DEGREE), -1, dtype=np.int64)
    if n < 2:
        return out
    x = x.astype(np.float32)
    near = min(CANDIDATES, n - 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    for a in range(0, n, step):
        rows = np.arange(a, min(a + step, n))
        cosines = x[rows] @ x.T
        cosines[np.arange(len(rows)), rows] = -np.inf

        def ranked(picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            value = np.take_along_axis(cosines, picks, 1)  # noqa: B023 - used before the next step
            order = np.argsort(-value, axis=1, kind="stable")
            return np.take_along_axis(picks, order, 1), np.take_along_axis(value, order, 1)

        picks, value = ranked(np.argpartition(-cosines, near - 1, axis=1)[:, :near])
        out[rows, :DEGREE] = _pruned(x, rows, picks, value, DEGREE, ALPHA)
        pool, score = ranked(rng.integers(0, n, (len(rows), min(RANDOM_POOL, n))))
        score[score > value[:, -1:]] = -np.inf  # nearer ones had their chance
        out[rows, DEGREE:] = _pruned(x, rows, pool, score, LONG_DEGREE, ALPHA)
    return out


def adjacent(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (n + 1) and targets of edges among n nodes, each taken both ways, once."""
    key = np.unique(np.r_[src * n + dst, dst * n + src])
    return np.searchsorted(key, np.arange(n + 1) * n), key % n


def both_ways(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`adjacent` of the edges of a padded list."""
    src, k = np.nonzero(edges >= 0)
    return adjacent(src, edges[src, k], len(edges))


def range_search(x: np.ndarray, starts: np.ndarray, targets: np.ndarray, medoid: int, least: float, hops: int = 64, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of different nodes within the range, for the nodes ``asked`` (all, if None) as queries.

    ``starts`` and ``targets`` are the edges of each node.  Only nodes that an edge
    leads to are compared with a query.  Memory goes with the queries asked times the
    nodes and with ``FRONTIER``, whatever the degrees and however much lies in range.
    """
    n = len(x)
    asked = np.arange(n) if asked is None else asked
    own = np.arange(len(asked))  # queries by their place
    seen = np.zeros((len(asked), n), dtype=bool)  # compared already
    seen[own, asked] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    most = max(1, FRONTIER // x.shape[1])

    def parts(node: np.ndarray) -> Iterator[slice]:
        """Stretches of nodes with up to ``most`` edges, or one node with more."""
        ends = np.cumsum(starts[node + 1] - starts[node])
        at = 0
        while at < len(node):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield slice(at, end)
            at = end

    def met(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        degree = starts[node + 1] - starts[node]
        q = np.repeat(query, degree)
        place = np.arange(len(q)) - np.repeat(np.cumsum(degree) - degree, degree)
        key = q * n + targets[np.repeat(starts[node], degree) + place]
        key = np.unique(key[~seen.ravel()[key]])
        q, v = key // n, key % n
        seen[q, v] = True
        return q, v, np.einsum("ij,ij->i", x[asked[q]], x[v])

    def ahead(query: np.ndarray, node: np.ndarray, close: bool = False) -> tuple[np.ndarray, ...]:
        """Query, neighbour and cosine of the neighbours of the nodes not compared before; with ``close``, of those in range."""
        out = []
        for part in parts(node):
            q, v, score = met(query[part], node[part])
            keep = score >= least if close else slice(None)
            out.append((q[keep], v[keep], score[keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    # what the walks pass by is remembered where it lies within the range
    here, best = np.full(len(asked), medoid), x[asked] @ x[medoid]
    seen[:, medoid] = True
    close = np.flatnonzero((best >= least) & (asked != medoid))
    frontier = [(close, np.full(len(close), medoid)), (own, asked)]
    walking = np.flatnonzero(asked != medoid)
    for _ in range(hops):
        q, v, score = ahead(walking, here[walking])
        near = score >= least
        frontier.append((q[near], v[near]))
        order = np.lexsort((score, q))
        last = np.flatnonzero(np.r_[q[order][1:] != q[order][:-1], True]) if len(q) else np.zeros(0, np.int64)
        top = order[last]
        better = score[top] > best[q[top]]
        walking = q[top[better]]
        if not len(walking):
            break
        here[walking], best[walking] = v[top[better]], score[top[better]]
    query, node = (np.concatenate(c) for c in zip(*frontier, strict=True))
    while len(query):
        inside = asked[query] != node
        found.append((query[inside], node[inside]))
        query, node, _ = ahead(query, node, close=True)
    query, node = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return asked[query], node


def links_of(x: np.ndarray, starts: np.ndarray, targets: np.ndarray, medoid: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of :func:`range_search` over all nodes, found from either end as one, smaller node first, each once.

    ``QUERIES`` nodes ask at once.  What they find is held as a bit a pair of nodes, not
    as a list, so a block in which all are near takes no more memory than another.
    """
    n = len(x)
    linked = np.zeros((n, n), dtype=bool)
    for at in range(0, n, QUERIES):
        q, v = range_search(x, starts, targets, medoid, least, asked=np.arange(at, min(at + QUERIES, n)))
        linked[np.minimum(q, v), np.maximum(q, v)] = True
    for at in range(0, n, QUERIES):
        q, v = np.nonzero(linked[at : at + QUERIES])
        if len(q):
            yield q + at, v


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = [], []
            for v in batch.column("v").to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    keys.append(None)
                    raw.append(None)
                else:
                    x = x / np.abs(x).max()  # no norm overflows or vanishes
                    x = x / np.linalg.norm(x)
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, key binary, raw binary")


def _assigned(classes: DataFrame, by_length: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            lists: list[list[int]] = [[] for _ in raw]
            sizes = np.array([len(r) for r in raw], dtype=np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                base = int(size) // 8 * _SHARD_STEP
                centres = by_length.get(int(size))
                if centres is None:
                    for k in at:
                        lists[k] = [base]
                    continue
                x = np.frombuffer(b"".join(raw[k] for k in at)).reshape(len(at), -1)
                top = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :OVERLAP]
                for k, own in zip(at, top, strict=True):
                    lists[k] = sorted(base + int(c) for c in own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "shards"])

    return classes.mapInArrow(run, "rep long, n long, raw binary, shards array<long>")


def _unpacked(table: pa.Table, a: int, b: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("raw").slice(a, b - a).to_pylist())).reshape(b - a, -1)


def _groups(table: pa.Table) -> Iterator[tuple[int, int]]:
    keys = (table.column(c).to_numpy() for c in ("shard", "i", "j"))
    cuts = group_cuts(*keys)
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _graphs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    reps = table.column("rep").to_numpy()
    src, dst = [], []
    for a, b in _groups(table):
        x = _unpacked(table, a, b)
        edges = robust_pruned(x)
        at, k = np.nonzero(edges >= 0)
        src.append(reps[a + at])
        dst.append(reps[a + edges[at, k]])
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (src, dst)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in joined], ["rep", "to"])


def _local(table: pa.Table, a: int, b: int, reps: np.ndarray) -> np.ndarray:
    """Edges (from, to) of a group by place, of the lists of its rows; those that lead out of it are left out."""
    lists = table.column("edges").slice(a, b - a).combine_chunks()
    to = lists.flatten().to_numpy()
    src = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    order = np.argsort(reps[a:b], kind="stable")
    ranked = reps[a:b][order]
    at = np.minimum(np.searchsorted(ranked, to), b - a - 1)
    inside = ranked[at] == to
    return np.stack([src[inside], order[at[inside]]])


def _searched(least: float):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        reps, counts, own = (table.column(c).to_numpy() for c in ("rep", "n", "own"))
        shard, i, j = (table.column(c).to_numpy() for c in ("shard", "i", "j"))
        shards = table.column("shards").to_pylist()
        out_rep, out_n, out_to = [], [], []
        for a, b in _groups(table):
            size = b - a
            x = _unpacked(table, a, b)
            medoid = int((x @ x.mean(axis=0)).argmax())
            mine = np.zeros((size, OVERLAP), dtype=np.int64)
            for k, row in enumerate(shards[a:b]):
                mine[k] = (row + [-1 - k] * OVERLAP)[:OVERLAP]
            total = np.zeros(size, dtype=np.int64)
            forest = Forest(size)
            for q, v in links_of(x, *adjacent(*_local(table, a, b, reps), size), medoid, least):
                if i[a] != j[a]:
                    cross = own[a + q] != own[a + v]
                    q, v = q[cross], v[cross]
                for at in range(0, len(q), FRONTIER // 32):
                    y, z = q[at : at + FRONTIER // 32], v[at : at + FRONTIER // 32]
                    # the least common shard counts the pair
                    common = (mine[y][:, :, None] == mine[z][:, None, :]).any(axis=2)
                    first = np.where(common, mine[y], np.iinfo(np.int64).max).min(axis=1)
                    counted = first == shard[a]
                    np.add.at(total, y[counted], counts[a + z[counted]])
                    np.add.at(total, z[counted], counts[a + y[counted]])
                    root = np.array([forest.find(k) for k in range(size)])
                    apart = root[y] != root[z]
                    for one, other in zip(y[apart].tolist(), z[apart].tolist(), strict=True):
                        if forest.join(one, other):
                            out_rep.append(int(reps[a + one]))
                            out_n.append(0)
                            out_to.append(int(reps[a + other]))
            some = np.flatnonzero(total)
            out_rep += reps[a + some].tolist()
            out_n += total[some].tolist()
            out_to += [None] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_rep, out_n, out_to)], ["rep", "n", "to"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``.

    Two rows are linked if their cosine is ``least`` or more, in double precision.
    A vector that is null, empty, zero, or holds null or non-finite components links
    with nothing and is kept; vectors of different lengths never link.  Every row
    counts, also with a repeated id; a null id links and counts, its row has a null
    component_id unless one with an id is linked, and it is kept only then not.
    Other columns are not read.
    """
    base = stored(_classes(vectors, id_col, vector_col))
    full = base.where("key IS NOT NULL")
    by_key = full.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"))
    # classes go by a number of their own: ids may be missing or repeat
    classes = stored(by_key.withColumn("rep", F.monotonically_increasing_id()))
    n_classes = classes.count()
    share = max(1, n_classes // SAMPLE)
    sample = [r["raw"] for r in classes.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("raw").collect()]
    by_length: dict[int, np.ndarray] = {}
    for size in sorted({len(r) for r in sample}):
        own = np.frombuffer(b"".join(r for r in sample if len(r) == size)).reshape(-1, size // 8)
        k = min(MOST_SHARDS, len(own), max(1, math.ceil(n_classes * len(own) / len(sample) / SHARD_VECTORS)))
        by_length[size] = centroids(own, k)
    members = stored(_assigned(classes.select("rep", "n", "raw"), by_length))
    spread = members.select("rep", "n", "raw", "shards", F.explode("shards").alias("shard"))
    sizes = spread.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    dealt = dealt_in_blocks(spread.join(sizes.hint("merge"), "shard"), "shard", "rep", "size", BLOCK)
    keys = ["shard", "i", "j"]
    edges = map_groups(dealt.select(*keys, "rep", "raw"), keys, _graphs, "rep long, to long")
    united = edges.groupBy("rep").agg(F.collect_set("to").alias("edges"))
    known = dealt.join(united.hint("merge"), "rep", "left").select(*keys, "own", "rep", "n", "raw", "shards", "edges")
    found = stored(map_groups(known, keys, _searched(least), "rep long, n long, to long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("more"))
    linked = components(found.where("to IS NOT NULL"), "rep", "to").select(F.col("node").alias("rep"), "component")
    told = classes.select("key", "rep", "n", "first_id").join(links, "rep", "left").join(linked, "rep", "left")
    labels = stored(told.select("key", "n", "first_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("part")))
    roots = labels.groupBy("part").agg(F.min("first_id").alias("root"), F.count(F.lit(1)).alias("n_classes"))
    rooted = stored(joined_to_unique(labels.drop("first_id"), roots, "part", "n_classes", n_classes).select("key", "n", "n_links", "root"))
    met = joined_to_unique(full.select("vec_id", "key"), rooted, "key", "n", full.count()).select("vec_id", "n_links", F.col("root").alias("component_id"))
    alone = base.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def audit(vectors: DataFrame, result: DataFrame, least: float = 0.95, queries: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of true links of up to ``queries`` rows (by hash of the id) that ``result`` counts."""
    base = _classes(vectors, id_col, vector_col).where("key IS NOT NULL AND vec_id IS NOT NULL")
    asked = base.orderBy(F.xxhash64("vec_id")).limit(queries).collect()
    ids = [r["vec_id"] for r in asked]
    size = max((len(r["raw"]) for r in asked), default=0)
    x = np.frombuffer(b"".join(r["raw"] if len(r["raw"]) == size else bytes(size) for r in asked)).reshape(-1, max(size // 8, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            raw = [r for r in batch.column("raw").to_pylist() if len(r) == size]
            if raw:
                total += (x @ np.frombuffer(b"".join(raw)).reshape(len(raw), -1).T >= least).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["vec_id", "n"])

    true = {r["vec_id"]: r["n"] - 1 for r in base.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    got = {r["vec_id"]: r["n_links"] for r in result.where(F.col("vec_id").isin(ids)).collect()}
    return sum(min(got.get(k, 0), n) for k, n in true.items()) / max(1, sum(true.values()))
