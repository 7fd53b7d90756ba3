"""Relations of roads: member ways chained by their shared ends into lines and rings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from mobilis.sources.folders import stored

#: A relation of so many members or fewer is chained by one task, beside others.
MOST_TOGETHER = 65_536


def _followed(step: DataFrame, longest: int) -> DataFrame:
    """(d, last, hops, least, open) for every d of ``step`` (d, next; next null where a way ends).

    Pointers that still lead on reach twice as far each round, by a join on keys that are
    unique on both sides: no two pointers of one reach lead to one way.  What has come to
    an end is not joined again.  ``least`` is the least of what was passed, the start
    included; a pointer that is open after ``longest`` hops goes round in a ring.
    """
    ends = step.where("next IS NULL").select(F.col("d").alias("next"), F.lit(True).alias("ends"))
    first = step.join(ends, "next", "left")
    done = F.col("next").isNull() | F.coalesce("ends", F.lit(False))
    least = F.least("d", F.coalesce("next", "d"))
    now = stored(first.select("d", F.coalesce("next", "d").alias("last"), F.col("next").isNotNull().cast("long").alias("hops"), least.alias("least"), done.alias("done")))
    for _ in range(max(1, math.ceil(math.log2(max(longest, 1)))) + 1):
        going = now.where("NOT done")
        if not going.head(1):
            break
        far = now.select(F.col("d").alias("last"), F.col("last").alias("far"), F.col("hops").alias("more"), F.col("least").alias("far_least"), F.col("done").alias("far_done"))
        gone = going.join(far, "last").select("d", F.col("far").alias("last"), (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "far_least").alias("least"), F.col("far_done").alias("done"))
        now = stored(now.where("done").unionByName(gone))
    return now.select("d", "last", "hops", "least", (~F.col("done")).alias("open"))


def _way(back: Column) -> Column:
    return F.struct("relation", "member", back.alias("back"))


def _other(d: str) -> Column:
    return F.struct(F.col(f"{d}.relation").alias("relation"), F.col(f"{d}.member").alias("member"), (~F.col(f"{d}.back")).alias("back"))


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(step: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, hops, least) for every way of ``step`` (the next way; -1 where a way ends), in rounds that reach twice as far."""
    d = np.arange(len(step))
    last, hops = np.where(step < 0, d, step), (step >= 0).astype(np.int64)
    least = np.minimum(d, last)
    for _ in range(math.ceil(math.log2(max(longest, 2)))):
        hops, least, last = hops + hops[last], np.minimum(least, least[last]), last[last]
    return last, hops, least


def _placed(rows: pa.Table) -> pa.Table:
    """``chained`` of whole relations, sorted by relation and member.

    Way 2 k is row k passed from a to b, 2 k + 1 is row k passed backwards, so ways are in
    the order of member and direction, and the other direction of d is d ^ 1.
    """
    n = len(rows)
    relation = _codes(rows["relation"].combine_chunks())
    ends = _codes(pa.concat_arrays([*rows["a"].chunks, *rows["b"].chunks])).reshape(2, n).T
    tail = np.where(ends < 0, -1, relation[:, None] * (ends.max() + 1) + ends).ravel()
    _, at, met = np.unique(tail, return_inverse=True, return_counts=True)
    d = np.arange(2 * n)
    both = np.zeros(len(met), np.int64)
    np.add.at(both, at, d)
    # a head is the tail of the other direction; at a joint the way goes on as the one of two that is not that
    other = d ^ 1
    step = np.where((tail[other] >= 0) & (met[at[other]] == 2), both[at[other]] - other, -1)
    longest = 2 * int(np.bincount(relation).max())
    last, _, least = _ends(step, longest)
    # a ring is cut before its least way, so that it has an end too; one of its two directions is told
    ring = step[last] >= 0
    last, hops, cut_least = _ends(np.where(ring & (step == least), -1, step), longest)
    begin = np.where(ring, least, last[other] ^ 1)
    member = rows["member"].to_numpy()
    first, final = member[begin >> 1], member[last >> 1]
    told = np.where(ring, least % 2 == 0, (first < final) | ((first == final) & (begin % 2 == 0)))
    d = d[told]
    k, begin = d >> 1, begin[d]
    loop = (ends[:, 0] == ends[:, 1]) & (ends[:, 0] >= 0)
    return pa.table({
        "relation": rows["relation"].take(pa.array(k)), "member": member[k], "chain": member[cut_least[begin] >> 1],
        "place": hops[begin] - hops[d], "reversed": d % 2 == 1, "closed": ring[d] | loop[k],
    })


def _placed_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by relation and member, chained as their relations end; the last relation of a batch waits for the next."""
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows])
        relation = _codes(rows["relation"].combine_chunks())
        ended = int(np.argmax(relation == relation[-1]))
        waiting = rows.slice(ended)
        if ended:
            yield from _placed(rows.slice(0, ended)).to_batches()
    if waiting is not None:
        yield from _placed(waiting).to_batches()


def chained(members: DataFrame, together: int = MOST_TOGETHER) -> DataFrame:
    """Where each member way lies: relation, member, chain, place, reversed, closed.

    Members have relation, member (a whole number, distinct within it) and a and b, the
    ends of the way.  Two ways are chained where exactly two ends of the relation's ways
    meet; an end that is alone is a gap, and where three or more meet all chains end.  A
    chain is named by its least member; a line begins at the lesser of its outer ways, a
    ring at its least, which is not reversed.  ``closed`` tells that the ends of a chain
    meet.  Null ends meet nothing; a null relation or member is none; an empty table gives
    no rows.

    Relations of at most ``together`` members move once and are chained where they meet;
    the members of larger ones stay dealt out and follow pointers.
    """
    rows = stored(members.select("relation", "member", "a", "b").where("relation IS NOT NULL AND member IS NOT NULL"))
    large = stored(rows.groupBy("relation").count().where(F.col("count") > together))
    most = large.agg(F.max("count")).first()[0]
    small = rows if most is None else rows.join(large, "relation", "left_anti")
    whole = StructType([rows.schema["relation"], StructField("member", LongType()), StructField("chain", LongType()), StructField("place", LongType()), StructField("reversed", BooleanType()), StructField("closed", BooleanType())])
    sorted_ = small.withColumn("member", F.col("member").cast("long")).repartition("relation").sortWithinPartitions("relation", "member")
    out = sorted_.mapInArrow(_placed_in_turn, whole)
    return out if most is None else out.unionByName(_pointed(rows.join(large, "relation", "left_semi"), most))


def _pointed(members: DataFrame, most: int) -> DataFrame:
    """``chained`` by pointers that meet in joins, for relations of any size (``most`` members or fewer)."""
    rows = stored(members)
    # each way can be passed from a to b or backwards
    ways = stored(
        rows.select(_way(F.lit(False)).alias("d"), F.col("a").alias("tail"), F.col("b").alias("head"), "relation").unionByName(
            rows.select(_way(F.lit(True)).alias("d"), F.col("b").alias("tail"), F.col("a").alias("head"), "relation")
        )
    )
    leaving = ways.where("tail IS NOT NULL").groupBy("relation", F.col("tail").alias("head"))
    joints = leaving.agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("one"), F.max("d").alias("two")).where("n = 2")
    # at a joint the way goes on as the one of two that is not itself, backwards
    onward = F.when(F.col("one") == _other("d"), F.col("two")).otherwise(F.col("one"))
    step = stored(ways.join(joints, ["relation", "head"], "left").select("d", F.when(F.col("n").isNotNull(), onward).alias("next")))
    longest = 2 * most
    found = _followed(step, longest)
    # a ring is cut before its least way, so that it has an end too; one of its two directions is told
    rings = stored(found.where("open AND NOT least.back").select("d", F.col("least").alias("begin")))
    cut = step.join(rings, "d").select("d", F.when(F.col("next") != F.col("begin"), F.col("next")).alias("next"))
    around = _followed(stored(cut), longest).select("d", "hops").join(rings, "d").withColumn("closed", F.lit(True))
    # the end of a way passed backwards is where its line begins
    lines = found.where("NOT open").select("d", "last", "hops")
    begins = lines.select(_other("d").alias("d"), _other("last").alias("begin"))
    line = lines.join(begins, "d")
    told = (F.col("begin.member") < F.col("last.member")) | ((F.col("begin.member") == F.col("last.member")) & ~F.col("begin.back"))
    every = around.select("d", "begin", "hops", "closed").unionByName(line.where(told).select("d", "begin", "hops", F.lit(False).alias("closed")))
    length = every.groupBy("begin").agg(F.max("hops").alias("most"), F.min("d.member").alias("chain"))
    out = every.join(length, "begin").select("d.relation", "d.member", "chain", (F.col("most") - F.col("hops")).alias("place"), F.col("d.back").alias("reversed"), "closed")
    loops = rows.select("relation", "member", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("loop"))
    met = out.join(loops, ["relation", "member"])
    return met.select("relation", "member", "chain", "place", "reversed", (F.col("closed") | F.col("loop")).alias("closed"))
