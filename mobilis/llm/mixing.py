"""Mixing sources to target weights by Pfair scheduling, in SQL expressions only.

Each source is a stream of equal blocks of text.  With ``n`` of ``period`` slots as
its share, its block ``i`` (from 0) is released at ``floor(i * period / n)`` and due
at ``ceil((i + 1) * period / n)``; in every slot the released block with the earliest
deadline runs.  Shares add up to the period, so every slot is used and every
deadline met, and at any time a source is less than one block from its share.

Release times and deadlines repeat with the period, so one period is scheduled (a
fold over its slots) and every document computes its slot from its block number: no
task sees a whole source.  The period has at least ``PERIOD`` slots, and
``SOURCE_SLOTS`` for each source, so that rounding moves no more than
1 / ``SOURCE_SLOTS`` of the text from one source to others, however many there are.
A fold has about ``GROUP_SOURCES`` members.  More sources are dealt to groups by a hash,
groups to groups of groups, and so on up to one; the members of each are scheduled among
each other by their weights, so every fold stays bounded however many sources there are,
and with ``l`` levels a source is less than ``l`` blocks from its share.  Where a source
ends its slots stay empty, and the others go on in proportion to their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.llm.shared import stored

BLOCK_UNITS = 65_536
PERIOD = 1000
SOURCE_SLOTS = 50
GROUP_SOURCES = 500


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """team, source, n: the slots of each source in a period of its team, at least one each."""
    total = weights.groupBy("team").agg(F.sum("weight").alias("total"), F.greatest(F.lit(period), F.count(F.lit(1)) * SOURCE_SLOTS).alias("slots"))
    n = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("total") * F.col("slots"))).cast("long")
    return weights.join(total, "team").select("team", "source", n.alias("n"))


def schedule(shared: DataFrame) -> DataFrame:
    """team, source, n, period, k, slot: where block ``k`` of a period of each source runs, team by team."""
    listed = shared.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"), F.sum("n").cast("int").alias("period"))
    listed = listed.withColumn("step", F.ceil(F.sqrt("period")).cast("int"))  # slots are appended in stretches, which copies less
    turn = """transform(array(array_min(transform(sequence(0, size(s) - 1), j -> if(
                 now.done[j] < s[j].n and floor(now.done[j] * period / s[j].n) <= t,
                 named_struct('due', ceil((now.done[j] + 1) * period / s[j].n), 'j', j), null))).j),
               p -> named_struct(
                 'done', transform(now.done, (d, j) -> if(j = p, d + 1L, d)),
                 'out', concat(now.out, array(p))))[0]"""
    stretch = f"aggregate(sequence(c * step, least((c + 1) * step, period) - 1), named_struct('done', acc.done, 'out', cast(array() as array<int>)), (now, t) -> {turn})"
    out = F.expr(
        f"""flatten(aggregate(sequence(0, int((period - 1) / step)), named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<array<int>>)),
              (acc, c) -> transform(array({stretch}), x -> named_struct('done', x.done, 'out', concat(acc.out, array(x.out))))[0]).out)"""
    )
    slots = listed.where("period > 0").select("team", "s", "period", F.posexplode(out).alias("slot", "j")).select("team", F.expr("s[j].source").alias("source"), F.expr("s[j].n").alias("n"), "period", "slot")
    k = F.row_number().over(Window.partitionBy("team", "source").orderBy("slot")) - 1
    return slots.withColumn("k", k)


def _levels(wanted: DataFrame, n_sources: int, period: int) -> tuple[DataFrame, int]:
    """source and, for each level from its group up, ``n<l>``, ``period<l>`` and ``at<l>``: the slots of its unit in order.

    The unit of the first level is the source itself, that of the next its group.
    """
    units, teams, names, level = wanted, n_sources, wanted.select("source"), 0
    while level == 0 or teams > 1:
        teams = math.ceil(teams / GROUP_SOURCES) or 1
        level += 1
        dealt = stored(units.withColumn("team", F.pmod(F.xxhash64(F.lit("team"), "source"), F.lit(teams))))
        runs = schedule(shares(dealt, period)).groupBy("team", "source").agg(F.first("n").alias(f"n{level}"), F.first("period").alias(f"period{level}"), F.array_sort(F.collect_list("slot")).alias(f"at{level}"))
        key = "source" if level == 1 else f"team{level - 1}"
        table = runs.select(F.col("source").alias("_unit"), F.col("team").alias(f"team{level}"), f"n{level}", f"period{level}", f"at{level}")
        names = stored(names.join(table, F.col(key).eqNullSafe(F.col("_unit"))).drop("_unit"))
        units = dealt.groupBy(F.col("team").alias("source")).agg(F.sum("weight").alias("weight"))
    return names, level


def _slots(block: Column, levels: int) -> Column:
    """The slot of a block: its place in its group, the place of that in the next group, and so on."""
    turn = block
    for k in range(1, levels + 1):
        n, at = F.col(f"n{k}"), F.col(f"at{k}")
        turn = F.floor(turn / n) * F.col(f"period{k}") + F.get(at, F.pmod(turn, n).cast("int"))
    return turn


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    power: float = 1.0,
    block_units: int = BLOCK_UNITS,
    period: int = PERIOD,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, unit_start, block, release, deadline, slot for each row.

    A document stands in its source at ``unit_start``, the characters of all
    documents of the source that come before it in the order of ``md5(doc_id)`` and
    then doc_id; its block is the one its first character lies in.  Ordered by
    (slot, unit_start) the rows are the mixed corpus; none is dropped or repeated.
    Documents stay whole, so where a cut of that order lies a source may be ahead or
    behind by a block for each level of groups and the length of its longest document;
    release and deadline count the slots of the source's group, of all sources where
    there is one group.
    ``weights`` has source and weight; a source it does not name has the least
    weight named.  Without it a weight is the source's characters to ``power``.  A
    null source is a source, a null or empty text has no characters, rows that
    repeat follow each other, and a null id comes first.  Other columns are not
    read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("units"))
    # the salt spreads rows that repeat an id; it never decides between different ids
    rows = rows.withColumn("place", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))).withColumn("salt", F.monotonically_increasing_id())
    order = ["place", "doc_id", "units", "salt"]
    ranged = stored(rows.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("source", "part").agg(F.sum("units").alias("units"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "part", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum("units").over(inside), F.lit(0)))
    sized = totals.groupBy("source").agg(F.sum("units").alias("units"))
    if weights is None:
        wanted = sized.select("source", F.pow(F.greatest("units", F.lit(1)).cast("double"), F.lit(power)).alias("weight"))
    else:
        given = weights.groupBy(F.col("source").alias("named")).agg(F.max(F.col("weight").cast("double")).alias("weight")).where("weight > 0")
        least = given.agg(F.coalesce(F.min("weight"), F.lit(1.0)).alias("least"))
        wanted = sized.join(given, F.col("source").eqNullSafe(F.col("named")), "left").join(F.broadcast(least)).select("source", F.coalesce("weight", "least").alias("weight"))
    quotas, levels = _levels(wanted, sized.count(), period)
    # a partition of the range shuffle ends inside at most one source: a row a source and one a partition, so
    # that documents meet the slots of their source part by part, and no source meets them in one task
    facts = stored(bases.join(quotas.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("part").alias("in"), "base", *[c for c in quotas.columns if c != "source"]))
    placed = local.join(facts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    started = placed.withColumn("unit_start", F.col("base") + F.col("local")).withColumn("block", F.floor(F.col("unit_start") / block_units))
    return started.select(
        "doc_id",
        "source",
        "unit_start",
        "block",
        F.floor(F.col("block") * F.col("period1") / F.col("n1")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("period1") / F.col("n1")).alias("deadline"),
        _slots(F.col("block"), levels).alias("slot"),
    )


#: The same rows by DuckDB, for documents weighted by their characters to the power 0.7 (one group of sources).
ORACLE_SQL = """
WITH RECURSIVE placed AS (
  SELECT doc_id, source, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(coalesce(text, '')) AS BIGINT) AS unit_start
  FROM documents),
sized AS (SELECT source, sum(length(coalesce(text, ''))) AS units FROM documents GROUP BY source),
weighed AS (SELECT source, pow(CAST(greatest(units, 1) AS DOUBLE), 0.7) AS weight FROM sized),
shared AS (SELECT source, CAST(greatest(1, round(weight / (SELECT sum(weight) FROM weighed) * (SELECT greatest(1000, 50 * count(*)) FROM weighed))) AS BIGINT) AS n FROM weighed),
whole AS (SELECT CAST(sum(n) AS BIGINT) AS period, list(struct_pack(source := source, n := n) ORDER BY source) AS s FROM shared),
steps AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS j, [CAST(0 AS BIGINT) FOR x IN s] AS done FROM whole
  UNION ALL
  SELECT slot + 1, p, [CASE WHEN i = p THEN d + 1 ELSE d END FOR d, i IN done]
  FROM (SELECT slot, done, list_min([CASE WHEN d < s[i].n AND d * period // s[i].n <= slot + 1
                                     THEN ((d + 1) * period + s[i].n - 1) // s[i].n * 1000000 + i END FOR d, i IN done]) % 1000000 AS p
        FROM steps, whole WHERE slot + 1 < period)),
slots AS (SELECT s[j].source AS source, s[j].n AS n, period, slot, row_number() OVER (PARTITION BY j ORDER BY slot) - 1 AS k FROM steps, whole WHERE j IS NOT NULL),
blocked AS (SELECT doc_id, source, unit_start, unit_start // 65536 AS block FROM placed)
SELECT b.doc_id, b.source, b.unit_start, b.block, b.block * t.period // t.n AS release,
       ((b.block + 1) * t.period + t.n - 1) // t.n AS deadline, b.block // t.n * t.period + t.slot AS slot
FROM blocked b JOIN slots t ON t.source = b.source AND t.k = b.block % t.n
"""
