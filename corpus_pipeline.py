"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mobilis.llm import stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("minhash_dedup", stages.minhash_dedup),
    ("pii", stages.mask_personal_data),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: The stages hash, compress, decode and tokenise, which SQL does not express; the
#: tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
