"""Row numbers over keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilis.sources.folders import stored


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "number") -> DataFrame:
    """``rows`` with their gapless number (from 0) within their keys, in order.

    A window would send all rows of a key to one task.  Here ranges of (keys, order) are
    sorted side by side, so a large key lies in many of them; what a range adds to a key
    is the sum of the counts before it, of which there is one a range and key.  Null keys
    are a key of their own; ``order`` should not tie, or equal rows are numbered by chance.
    """
    by = [*keys, *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    of = {k: f"_key_{i}" for i, k in enumerate(keys)}
    counts = placed.groupBy(F.col("_part").alias("_range"), *[F.col(k).alias(n) for k, n in of.items()]).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*of.values()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # stored, their size is known: a few are broadcast, and the rows stay where they are
    bases = stored(counts.select("_range", *of.values(), (F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")) - F.col("_first")).alias("_base")))
    met = placed.join(bases, [F.col("_part") == F.col("_range"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in of.items()]])
    return met.select(*rows.columns, (F.col("_at") + F.col("_base")).alias(name))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key.

    Tasks keep their own first rows of a key before any meet, which Spark does for a
    limit on a row number, so a large key sends ``most`` rows a task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
