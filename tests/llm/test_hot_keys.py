"""A key with a third of all rows does not land in one task, with broadcasts by size switched off."""

import statistics
from contextlib import contextmanager

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mobilis.llm import minhash, search, spelling, store
from mobilis.llm.shared import shared_folder

PARTS = 16


@contextmanager
def many_tasks(spark):
    told = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(PARTS)}
    before = {k: spark.conf.get(k, None) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def docs(spark):
    """6,000 documents, a third of them one text, some blank."""
    words = "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', hash(id, i) % 5000)))"
    return spark.range(6000).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN 'one text that very many documents hold word for word' WHEN id % 50 = 1 THEN '' ELSE {words} END AS text")


def spread(df):
    sizes = sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    return max(sizes), statistics.median(sizes), sum(sizes)


def test_a_class_of_copies(spark, docs):
    with many_tasks(spark):
        most, middle, every = spread(minhash.near_duplicates(docs.repartition(PARTS)))
    # rows that meet by a broadcast stay where they were; the others are dealt evenly
    assert every == 6000 and most <= 3 * middle + 50


def test_a_chunk_of_very_many_documents(spark, docs):
    path = shared_folder(spark)
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    with many_tasks(spark):
        uses = store._numbered(spark, path).select("row", F.posexplode("chunks").alias("pos", "key"))
        chunks = spark.read.parquet(f"{path}/chunks").select("key", F.col("n_ids").alias("n"))
        met = store._met(uses.repartition(PARTS), chunks)
        most, middle, every = spread(met)
        assert every == uses.count() and most <= 3 * middle + 50
        assert met.where("n IS NULL").count() == 0
        back = store.read_summary(spark, path)
        assert back.count() == 6000 and back.where("doc_id % 3 = 0").select("ids_crc32").distinct().count() == 1


def test_a_vector_of_very_many_rows(spark):
    made = spark.range(6000).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> if(id % 3 = 0, 0.25D, cast(hash(id, i) % 1000 AS double) / 1000)) AS embedding")
    with many_tasks(spark):
        got = search.top_k(made, "vec_id % 50 = 0")
        rows = got.collect()
    assert len(rows) == 600 and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}


def test_a_word_of_very_many_occurrences(spark):
    made = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', repeat('common ', 20), concat('letters', char(97 + id % 26)), 'commom') AS text")
    with many_tasks(spark):
        rows = {r.word: r for r in spelling.variants(made.repartition(PARTS)).collect()}
    assert rows["commom"].form == "common" and rows["common"].n > 79_000 and rows["common"].n_near >= 1
