"""Exact search for the vectors with the largest inner products, block by block.

1. Components become integers, the *terms* of a vector.  Rows are ordered by their
   nearest centroids (fitted on a bounded sample; every row is indexed whatever the
   sample) and cut into ranges of ``BLOCK`` rows.  A block has a forward index, the
   terms of its rows, and the largest and least value of each term.
2. The sum of a query's weights times these extremes bounds the score of every row of
   a block.  Groups of queries meet groups of block extremes, and each query goes to
   the part (``PART_BLOCKS`` blocks) that holds its best bound.
3. There the query takes its blocks in the order of their bounds and scores them
   through their forward index until a bound falls below its k-th score.
4. With that score as a floor it goes on to the other parts that hold a bound at or
   above it, and the same search runs in them.

A bound equal to the k-th score is still followed, as a smaller id may tie, so the
result is exact.  Equal vectors spread over blocks and query groups of bounded size,
so no task grows with the copies of one vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.llm.shared import map_groups, stored, tidy
from mobilis.llm.vectors import centroids, unit

#: Vectors that the order of rows is fitted on; the index holds all.
SAMPLE = 10_000
CENTROIDS = 256
BLOCK = 128
PART_BLOCKS = 64
QUERY_GROUP = 4096
#: Blocks whose extremes meet a group of queries at once.
SUMMARY_BLOCKS = 8192
_STEP = 512
_PART_STEP = 1 << 20
_NONE = -(1 << 63)
_MOST = (1 << 63) - 1


def _packed(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of terms as a matrix; what a row lacks weighs nothing."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _blob(x: np.ndarray) -> bytes:
    """Integers in little-endian order, as 16-bit numbers where they fit (the length tells)."""
    small = not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    return x.astype("<i2" if small else "<i8").tobytes()


def _unblob(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n else "<i8", n).astype(np.int64)


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """A matrix widened to the columns of another by zeros, or cut: zeros meet what is cut."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exact; beyond 64 bits held at the ends."""
    if _most(a) * _most(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _NONE + 1, _MOST).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score that each query can have with a row between the extremes."""
    width = queries.shape[1]
    high, low = _wide(high, width), _wide(low, width)
    both = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    return products(both, np.hstack([high, low]))


class Best:
    """The ``k`` best rows of each of some queries: score, then least id, then least row."""

    def __init__(self, k: int, own: np.ndarray, floor: np.ndarray):
        self.k, self.own, self.floor = k, own, floor.copy()
        n = len(own)
        self.score = np.full((n, k), _NONE, dtype=np.int64)
        self.name, self.row = (np.full((n, k), _MOST, dtype=np.int64) for _ in range(2))

    def meet(self, who: np.ndarray, score: np.ndarray, name: np.ndarray, row: np.ndarray) -> None:
        """Scores of queries ``who`` with the rows of a block."""
        score = np.where((row[None, :] == self.own[who][:, None]) | (score < self.floor[who][:, None]), _NONE, score)
        use = (score > _NONE).any(axis=1)
        who, score = who[use], score[use]
        if not len(who):
            return
        if score.shape[1] > self.k:  # ties with the k-th stay in
            kth = np.partition(score, -self.k, axis=1)[:, -self.k]
            some = (score >= kth[:, None]).any(axis=0)
            score, name, row = score[:, some], name[some], row[some]
        full = lambda x: np.broadcast_to(x, score.shape)
        scores = np.hstack([self.score[who], score])
        names = np.hstack([self.name[who], full(name)])
        rows = np.hstack([self.row[who], full(row)])
        names, rows = np.where(scores == _NONE, _MOST, names), np.where(scores == _NONE, _MOST, rows)
        order = np.lexsort((rows, names, -np.maximum(scores, _NONE + 1), scores == _NONE), axis=-1)[:, : self.k]
        self.score[who], self.name[who], self.row[who] = (np.take_along_axis(x, order, 1) for x in (scores, names, rows))
        self.floor[who] = np.maximum(self.floor[who], self.score[who, -1])


def searched(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple], k: int) -> tuple[Best, int]:
    """The best rows of ``blocks`` (names, rows, forward, high, low) and how many blocks were scored.

    Each query takes its blocks by falling bound and stops at the first below its k-th
    score; queries that are at the same block score it together.
    """
    width = queries.shape[1]
    bound = np.hstack([bounds(queries, b[3], b[4]) for b in blocks])
    order = np.argsort(-np.maximum(bound, _NONE + 1), axis=1, kind="stable")
    best, scored = Best(k, own, floor), 0
    live = np.arange(len(queries))
    for step in range(len(blocks)):
        at = order[live, step]
        go = bound[live, at] >= best.floor[live]
        live, at = live[go], at[go]
        if not len(live):
            break
        scored += len(live)
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            names, rows, forward = blocks[at[by[a]]][:3]
            who = live[by[a:b]]
            best.meet(who, products(queries[who], _wide(forward, width)), names, rows)
    return best, scored


def _terms(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and terms of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("terms"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _in_cells(rows: DataFrame, sample_size: int) -> DataFrame:
    """vec_id, row, cell, dim and terms as bytes: ``cell`` brings near rows together."""
    drawn = rows.orderBy(F.xxhash64("vec_id", "terms")).limit(sample_size).select("terms").toArrow().column(0)
    taken = [x for chunk in drawn.chunks for x in _lists(chunk)]
    sample = _packed(taken, max((len(x) for x in taken), default=0)).astype(np.float64)
    sample = unit(sample[np.abs(sample).sum(axis=1) > 0])
    found = centroids(sample, min(CENTROIDS, len(sample))) if len(sample) else np.zeros((1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _lists(batch.column("terms"))
            near = _wide(_packed(own, max((len(x) for x in own), default=0)).astype(np.float64), found.shape[1]) @ found.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :3]
            cell = np.zeros(len(own), dtype=np.int64)
            for place in order.T:
                cell = cell * CENTROIDS + place
            arrays = [batch.column("vec_id"), batch.column("row"), pa.array(cell), pa.array([len(x) for x in own], pa.int64()), pa.array([_blob(x) for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "row", "cell", "dim", "terms"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(tidy(run), "vec_id long, row long, cell long, dim long, terms binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of a range, in order: names, rows, forward index and extremes."""
    base, n = TaskContext.get().partitionId() * _PART_STEP, 0
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        width = max(x[2] for x in held)
        forward = _packed([_unblob(x[3], x[2]) for x in held], width)
        names, rows = (np.array([x[k] for x in held], dtype="<i8").tobytes() for k in (0, 1))
        values = [base + n // PART_BLOCKS, (base + n // PART_BLOCKS) * PART_BLOCKS + n % PART_BLOCKS, len(held), width, names, rows, _blob(forward), _blob(forward.max(axis=0)), _blob(forward.min(axis=0))]
        return pa.RecordBatch.from_pylist([dict(zip(_INDEX_NAMES, values, strict=True))], schema=_INDEX_SCHEMA)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "dim", "terms")), strict=True):
            held.append(row)
            if len(held) == BLOCK:
                yield block()
                held, n = [], n + 1
    if held:
        yield block()


_INDEX_NAMES = ["part", "block", "size", "width", "names", "rows", "forward", "high", "low"]
_INDEX = "part long, block long, size long, width long, names binary, rows binary, forward binary, high binary, low binary"
_INDEX_SCHEMA = pa.schema([(n, pa.int64() if n in ("part", "block", "size", "width") else pa.binary()) for n in _INDEX_NAMES])
#: Queries and blocks meet in one stream of rows; a query has no ``block``.
_MEETING = ["g", "part", "block", "size", "width", "names", "rows", "forward", "high", "low", "query_id", "query_row", "floor", "home"]


def _both(queries: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of queries (dim and terms as width and forward) and of blocks under the same keys."""
    asked = queries.withColumnsRenamed({"dim": "width", "terms": "forward"})
    names = [*keys, *[c for c in _MEETING if c not in keys]]
    filled = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("binary" if c in ("names", "rows", "forward", "high", "low") else "long").alias(c) for c in names]) for df in (asked, index)]
    return filled[0].unionByName(filled[1])


def _queries_of(table: pa.Table) -> tuple[dict, np.ndarray]:
    """The rows of queries by column, and their terms as a matrix."""
    own = {c: table.column(c).to_pylist() for c in ("query_id", "query_row", "g", "width", "forward", "floor", "home")}
    return own, _packed([_unblob(x, w) for x, w in zip(own["forward"], own["width"], strict=True)], max(own["width"], default=0))


def _floors(own: dict) -> np.ndarray:
    return np.array([_NONE if x is None else x for x in own["floor"]], dtype=np.int64)


def _grouped(table: pa.Table, keys: list[str]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Queries and blocks of each group of a table that is sorted by its keys."""
    values = [table.column(k).to_numpy() for k in keys]
    change = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in values], axis=0), True])
    for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
        own = table.slice(a, b - a)
        asked = own.column("block").is_null()
        queries, found = own.filter(asked), own.filter(pc.invert(asked))
        if queries.num_rows and found.num_rows:
            yield queries, found


def _visits(again: bool) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """The parts that queries go to: that of the best bound, or later all others with a bound at the floor or above."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for asked, found in _grouped(table, ["s", "g"]):
            found = found.sort_by([("part", "ascending"), ("block", "ascending")])
            sizes, part = found.column("width").to_pylist(), found.column("part").to_numpy()
            width = max(sizes)
            high, low = (_packed([_unblob(x, w) for x, w in zip(found.column(c).to_pylist(), sizes, strict=True)], width) for c in ("high", "low"))
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a in range(0, asked.num_rows, _STEP):
                some = asked.slice(a, _STEP)
                own, queries = _queries_of(some)
                best = np.maximum.reduceat(bounds(queries, high, low), starts, axis=1)
                if again:
                    home = np.array([_NONE if x is None else x for x in own["home"]], dtype=np.int64)
                    who, at = np.nonzero((best >= _floors(own)[:, None]) & (part[starts][None, :] != home[:, None]))
                else:
                    who, at = np.arange(len(queries)), best.argmax(axis=1)
                out = some.select(["g", "query_id", "query_row", "width", "forward", "floor"]).take(pa.array(who))
                out = out.append_column("part", pa.array(part[starts][at])).append_column("bound", pa.array(best[who, at]))
                yield from out.combine_chunks().to_batches()

    return run


_VISIT = "g long, query_id long, query_row long, width long, forward binary, floor long, part long, bound long"


def _scores(k: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for asked, found in _grouped(table, ["part", "g"]):
            parts = []
            for b in found.to_pylist():
                n, w = b["size"], b["width"]
                extremes = (_unblob(b[c], w)[None, :] for c in ("high", "low"))
                parts.append((np.frombuffer(b["names"], "<i8"), np.frombuffer(b["rows"], "<i8"), _unblob(b["forward"], n * w).reshape(n, w), *extremes))
            own, queries = _queries_of(asked)
            best, _ = searched(queries, np.array(own["query_row"], dtype=np.int64), _floors(own), parts, k)
            who, at = np.nonzero(best.score > _NONE)
            names = [np.array(own[c], dtype=np.int64)[who] for c in ("query_id", "query_row")]
            arrays = [pa.array(x) for x in (*names, best.name[who, at], best.row[who, at], best.score[who, at])]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "query_row", "vec_id", "row", "score"])

    return run


def _search(visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The best rows of the parts that queries go to."""
    pairs = visits.select("part", "g").distinct()
    met = _both(visits, index.join(pairs, "part"), ["part", "g"])
    return map_groups(met, ["part", "g"], _scores(k), "query_id long, query_row long, vec_id long, row long, score long")


def top_k(
    vectors: DataFrame,
    is_query: Column | str,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_size: int = SAMPLE,
) -> DataFrame:
    """The ``k`` rows with the largest integer inner products: query_id, rank, vec_id, score.

    A component x is floor(scale * x) in double precision.  ``is_query`` is a condition on
    ``vec_id``; a query meets every row but itself, ties go to the smaller id.  A query with
    fewer than ``k`` other rows gets them all.  Rows without an id or a vector, and those
    with a null or non-finite component, take no part.  Repeated rows and ids are rows of
    their own, told apart by an inner number.  Components that a shorter vector lacks
    count as zero, an empty one scores zero with all.  Products beyond 64 bits are held at
    their ends.  Other columns are not read; an empty table gives no rows.
    """
    table = stored(_in_cells(_terms(vectors, id_col, vector_col, scale), sample_size))
    ranged = table.repartitionByRange("cell", "row").sortWithinPartitions("cell", "row")
    index = stored(ranged.mapInArrow(tidy(_blocks), _INDEX))
    asked = table.where(F.expr(is_query) if isinstance(is_query, str) else is_query)
    groups = max(1, math.ceil(asked.count() / QUERY_GROUP))
    shares = max(1, math.ceil(index.count() / SUMMARY_BLOCKS))
    number = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("long")
    queries = stored(asked.select(number("row", groups).alias("g"), F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "dim", "terms"))

    def visits(of: DataFrame, again: bool) -> DataFrame:
        summaries = index.select("part", "block", "width", "high", "low", number("part", shares).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
        every = of.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        return map_groups(_both(every, summaries, ["s", "g"]), ["s", "g"], _visits(again), _VISIT)

    best = F.max(F.struct("bound", "part")).alias("best")
    home = visits(queries, False).groupBy("query_row").agg(best).select("query_row", F.col("best.part").alias("home"))
    placed = stored(queries.join(home, "query_row"))
    first = stored(_search(placed.withColumn("part", F.col("home")), index, k))
    floor = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = stored(visits(placed.join(floor, "query_row", "left"), True))
    found = first.unionByName(_search(rest, index, k))
    place = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
