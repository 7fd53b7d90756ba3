"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), percent=85)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.quality import judge

    return judge(_documents(spark, sf_dir))


#: The rules that the contract of the query names.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.urls import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.mixing import mix

    return mix(_documents(spark, sf_dir), power=0.7)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.pii import find

    return find(_documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in a folder of its language in one of its source."""
    from mobilis.llm.licenses import scan

    docs = _documents(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return scan(docs, "path")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated lines and paragraphs, also the shortest."""
    from mobilis.llm.lines import repeated_lines

    return repeated_lines(_documents(spark, sf_dir), least_words=1)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.packing import pack

    return pack(_documents(spark, sf_dir), _tokenizer())


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.shared import shared_folder
    from mobilis.llm.store import read_summary, write_store

    path = shared_folder(spark)
    write_store(_documents(spark, sf_dir), path, _tokenizer())
    return read_summary(spark, path)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.middle import rearranged, restored

    told = rearranged(_documents(spark, sf_dir)).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restored(told, names).select(*names, F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.search import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilis.llm.spelling import variants

    return variants(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_quality": op2_quality,
        "op3_urls": op3_urls,
        "op4_mixing": op4_mixing,
        "op7_pii": op7_pii,
        "op8_licenses": op8_licenses,
        "op9_lines": op9_lines,
        "op5_packing": op5_packing,
        "op6_vectors": op6_vectors,
        "op10_store": op10_store,
        "op11_middle": op11_middle,
        "op12_search": op12_search,
        "op13_spelling": op13_spelling,
    }


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS place
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE place = 1
"""


#: The units are joined again in SQL; what is rebuilt must be the text.
_MIDDLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, n, form, x, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM parts
"""


#: Integers below 2^53 are exact in double precision.
_SEARCH_SQL = """
WITH terms AS (
  SELECT vec_id, row_number() OVER () AS place, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.place, v.vec_id, CAST(list_inner_product(q.t, v.t) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.place ORDER BY list_inner_product(q.t, v.t) DESC, v.vec_id, v.place) AS rank
  FROM terms q JOIN terms v ON q.place <> v.place AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM scored WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    from mobilis.llm import mixing

    return {"op3_urls": _url_sql(), "op4_mixing": mixing.ORACLE_SQL, "op11_middle": _MIDDLE_SQL, "op12_search": _SEARCH_SQL}
