"""Sinks: zstd Parquet, sorted shards, key-range shards, TSV, JSON lines, and an append-only ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort: list[str] | None = None, rows_per_file: int = 5_000_000) -> None:
    """Overwrite a Parquet table; Spark's committer publishes all files or none."""
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_ranges(df: DataFrame, path: str, key: str, n: int) -> None:
    """Contiguous key ranges, one or more files each, in byte order of the key."""
    df.repartitionByRange(n, F.col(key)).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_collections(df: DataFrame, path: str, collection: str) -> None:
    """JSON lines in one folder per collection."""
    df.write.mode("overwrite").partitionBy(collection).json(path)


def unseen(files: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """What the ledger does not hold yet."""
    return files.join(ledger.select(*key).distinct(), key, "left_anti")


def write_matrix_market(entries: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Entries (row, col, value) as one MatrixMarket folder: a head and parts in order, to be read together or joined.

    The parts are written by ranges of (col, row), so their order is that of the file; the size line is in the head.
    """
    n = entries.count()
    spark = entries.sparkSession
    head = [("%%MatrixMarket matrix coordinate real general",), (f"{n_rows} {n_cols} {n}",)]
    spark.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    body = entries.repartitionByRange("col", "row").sortWithinPartitions("col", "row")
    body.select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/entries")


def write_fragments(fragments: DataFrame, cells: DataFrame, chroms: DataFrame, path: str) -> None:
    """Fragments of the given cells (cell) on known chromosomes (chr, ord), a folder a chromosome, sorted by place."""
    some = fragments.join(cells.select("cell").distinct(), "cell", "left_semi").join(F.broadcast(chroms.select("chr")), "chr", "left_semi")
    some.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start", "end", "cell").write.mode("overwrite").partitionBy("chr").option("sep", "\t").csv(path)


def write_versioned(df: DataFrame, path: str, version: str) -> None:
    """Replace one version of a registry, and leave the others."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a row of nodes (id, label, kind) and edges (source, target, label) in the shape that viewers read."""
    n = nodes.select(F.to_json(F.struct(F.struct("id", "label", "kind").alias("data"), F.lit("nodes").alias("group"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.struct("source", "target", "label").alias("data"), F.lit("edges").alias("group"))).alias("element"))
    return n.unionByName(e)
