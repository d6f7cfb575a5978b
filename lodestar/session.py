"""Session helpers: table loading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place() -> Column:
    """The place of a row in the files that a table is read from; the table's row order."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a single local process (tests) makes its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and cut its lineage there.

    The files are replicated by the folder's file system, so later reads survive lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
