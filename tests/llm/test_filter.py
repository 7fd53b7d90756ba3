"""The bitmap that keeps texts of no family out of the shuffle."""

from pyspark.sql import functions as F

from mobilis.llm.minhash import maybe_in


def test_wanted_rows_always_pass_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id").alias("rep"), F.lit("t").alias("text"))
    wanted = spark.range(0, 20_000, 7).select(F.col("id").alias("rep"))
    passed = {r["rep"] for r in maybe_in(rows, wanted, "rep").collect()}
    assert set(range(0, 20_000, 7)) <= passed
    assert len(passed) < 3_000


def test_a_full_bitmap_lets_all_wanted_pass(spark):
    rows = spark.range(5_000).select(F.col("id").alias("rep"))
    wanted = spark.range(0, 5_000, 2).select(F.col("id").alias("rep"))
    passed = {r["rep"] for r in maybe_in(rows, wanted, "rep", bits=1 << 15).collect()}
    assert set(range(0, 5_000, 2)) <= passed


def test_no_wanted_rows(spark):
    rows = spark.range(10).select(F.col("id").alias("rep"))
    assert maybe_in(rows, rows.limit(0), "rep").count() == 0
