"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import stages

#: (name, function) in order; each function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = stages.STAGES

#: No stage can be written in SQL as a whole; the tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    return stages.run(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
