"""All queries of the engine and the SQL that an independent engine answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mobilis.plans import board_queries, desk_queries, evidence_queries, feed_queries, graph_queries, model_queries, place_queries, sink_queries, stream_queries, view_queries, work_queries

_MODULES = (evidence_queries, feed_queries, work_queries, desk_queries, sink_queries, graph_queries, model_queries, place_queries, view_queries, stream_queries, board_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all evidence, collapsed into matches with their evidence hashes."""
    return evidence_queries.match_collapse(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _MODULES for name, fn in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
