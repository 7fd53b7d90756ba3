"""Intermediate tables, grouped Arrow streams and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where the driver and all tasks share one disk.
LOCAL_FOLDER = "file:///tmp/checkpoints/mobilis"


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_FOLDER
    return f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``keys`` so that no group spans two tables."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != c[0]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        last = int(cuts[-1])
        done = [*held, batch.slice(0, last)]
        held = [batch.slice(last)]
        done = [b for b in done if b.num_rows]
        if done:
            yield pa.Table.from_batches(done).combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_cuts(*columns) -> list[int]:
    """Positions where any of the sorted key columns changes, with both ends."""
    import numpy as np

    n = len(columns[0])
    change = np.zeros(n + 1, dtype=bool)
    change[0] = change[n] = True
    for c in columns:
        change[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(change).tolist()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the end of a task its worker gives freed memory back.

    Workers live on between tasks, beside the heap of their executor.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to tables of whole groups: one shuffle by key and one sort.

    One Python call sees many small groups, which per-group functions of Spark do
    not offer.  Callers bound the size of a group before they come here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from fn(table)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


#: A key with this part of all rows, or more, is joined by a broadcast.
HEAVY = 1000


def joined_to_unique(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, in which ``key`` is unique and ``count`` tells its rows.

    Keys with ``total`` / ``HEAVY`` rows or more are broadcast: of ``total`` rows there
    are at most ``HEAVY`` such keys.  The rest meets in a shuffle in which no key is
    large.  ``rows`` is read twice.
    """
    facts = [c for c in table.columns if c not in (key, count)]
    heavy = table.where(F.col(count) * HEAVY >= total).select(key, F.struct(*facts).alias("_found"))
    light = table.where(F.col(count) * HEAVY < total).select(key, F.struct(*facts).alias("_found"))
    met = rows.join(F.broadcast(heavy), key, "left")
    rest = met.where("_found IS NULL").drop("_found").join(light.hint("merge"), key)
    return met.where("_found IS NOT NULL").unionByName(rest).select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in facts])


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One half of the alternating-star contraction; edges are (a, b) with a > b.

    ``n`` is the number of edges of the round, for what counts as a hub.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = joined_to_unique(both, least, "a", "n", n)
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components as (node, component), component the smallest node.

    Alternating large-star and small-star contraction: every round is a grouped
    minimum with map-side combine and a join in which hubs meet their minimum by a
    broadcast (a star has at most twice the edges of its round, so at most
    2 * ``HEAVY`` hubs), so a hub with most of the edges does not land in one task.
    Nodes without an edge are not returned.  The driver sees two numbers a round.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    sign = [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")]
    seen = now.agg(*sign).first()
    while seen["n"]:
        now = stored(_star(_star(now, True, seen["n"]), False, seen["n"]))
        new = now.agg(*sign).first()
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
