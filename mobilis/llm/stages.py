"""The stages of ``corpus_pipeline``: each applies one operator to ``documents``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.llm import minhash, mixing, packing, pii, quality
from mobilis.llm.shared import stored

#: Sources count by their characters to this power: large ones weigh less than they are.
SOURCE_POWER = 0.7

#: Rows and bytes that go to a Python worker at once.  Batches lie outside the heap of an
#: executor and again in its workers, so with Spark's 10,000 rows texts take hundreds of MB there.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    _in_small_batches(spark)
    return quality.keep_good(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, ``_row``: stored, as it must not change between uses."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()))


def _names_rows(ids: DataFrame) -> bool:
    """Whether ``doc_id`` is there in every row and never twice."""
    return not ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").head(1)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id.

    Where ids are missing or repeat, rows are compared by number: only their texts
    make them one, and rows without an id stay behind those with one.
    """
    _in_small_batches(spark)
    if _names_rows(docs.select("doc_id")):
        rows, key = docs, "doc_id"
        dropped = stored(minhash.near_duplicates(rows, percent=80).where("NOT kept").select(key))
    else:
        rows, key = _numbered(docs), "_row"
        found = minhash.near_duplicates(rows, id_col=key, percent=80).select(F.col("doc_id").alias(key), "component_id")
        named = stored(found.join(rows.select(key, "doc_id").hint("merge"), key))
        best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("best"))
        dropped = stored(named.select(key).join(best.select(F.col(f"best.{key}").alias(key)).hint("merge"), key, "left_anti"))
    # only texts that may have to go are shuffled; most stay where they are
    told = minhash.marked(rows, dropped, key)
    doubted = told.where("_maybe").join(dropped, key, "left_anti")
    return told.where("NOT _maybe").select(*docs.columns).unionByName(doubted.select(*docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    _in_small_batches(spark)
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes their sources; the files hold it in order.

    Where ids are missing or repeat, rows are placed by number.
    """
    rows, key = docs, "doc_id"
    placed = stored(mixing.mix(docs, power=SOURCE_POWER).select("doc_id", "slot", "unit_start"))
    if not _names_rows(placed):
        rows, key = _numbered(docs), "_row"
        placed = stored(mixing.mix(rows, power=SOURCE_POWER, id_col=key).select("doc_id", "slot", "unit_start"))
    last = placed.agg(F.max("slot")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one plan at every size: places grow with the rows
    met = rows.join(placed.withColumnRenamed("doc_id", "_id").hint("merge"), F.col(key) == F.col("_id"), "left")
    slot = F.coalesce("slot", F.lit(last))
    part = F.floor(slot * parts / (last + 1)).cast("int")
    return met.repartitionById(parts, part).sortWithinPartitions(F.col("slot").asc_nulls_last(), "unit_start").select(*docs.columns)


def _stretch(file: Column, at: Column) -> Column:
    return file * 4096 + F.floor(at / packing.GROUP_DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; each group of sequences is a stretch of the mixed order."""
    _in_small_batches(spark)
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    try:
        named = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:  # not read from files: there is no order to keep
        return packing.pack(docs, tokenizer)
    file = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long")
    row = F.monotonically_increasing_id()  # where rows come from no file: task and row in it
    group = F.coalesce(_stretch(file, F.col("at")), _stretch(F.shiftrightunsigned(row, 33), row.bitwiseAND((1 << 33) - 1)))
    return packing.pack(named, tokenizer, group=group)
