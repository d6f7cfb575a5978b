"""Stages of the corpus pipeline and the loop that runs them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontam, neardup, quality, secrets
from lodestar.llm.common import fresh
from lodestar.llm.queries import vocabulary_path
from lodestar.session import ensure_checkpoint_dir, table


def beside(docs: DataFrame, names: list[str], function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that function keeps, with the columns of docs as they were, whatever names function uses itself."""
    held = {c: fresh(f"own_{c}", [*docs.columns, *names]) for c in docs.columns if c in names}
    out = function(docs.withColumnsRenamed(held))
    return out.select(*(F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts and texts without words go with them. Repeated rows, null ids and ties get the same verdict as any
    other row with the text; extra columns keep their values under any name; an empty table stays empty.
    """
    return beside(docs, ["score", "kept"], lambda d: quality.classify(d).where("kept"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, the one with the smallest doc_id.

    Of repeated rows with one doc_id and one text one stays (the first by a hash of all columns); different texts
    under one doc_id stay or go together. Null texts stay, as do rows without a doc_id; extra columns pass under any
    name; an empty table stays empty.
    """
    kept = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    row = fresh("row", docs.columns)
    place = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))
    one = docs.join(kept, "doc_id", "left_semi").withColumn(row, F.row_number().over(place))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.where(F.col(row) == 1).select(*columns).unionByName(docs.where("doc_id IS NULL"))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts stay, as do null ids; repeated rows stay or go together; extra columns keep their values
    under any name; with an empty benchmark everything stays.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return beside(docs, [*decontam.FOUND, "contaminated"], lambda d: decontam.decontaminate(d, benchmark).where("NOT contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are cut out of the texts; all documents stay.

    Null and empty texts, null ids and repeated rows stay; extra columns pass under any name.
    """
    return secrets.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every document that is left; the last stage.

    ids are the token ids. A null text is empty and has no tokens; repeated rows and null ids stay.
    """
    return bpe.encode_decode(docs, vocabulary_path(), keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontam_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, docs: DataFrame, sf_dir: str, stages) -> DataFrame:
    """Apply the stages; what one keeps is written to the shared checkpoint folder and read by the next."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs.write.parquet(path := f"{top}/{k}")
            docs = spark.read.parquet(path)
    return docs
