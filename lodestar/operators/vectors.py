"""Exact nearest vectors for a stated query set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass holds; more queries take several passes.
QUERY_BLOCK = 4096


def top_k(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(qid, id, rn): the k base vectors of the largest cosine for each query, by blocks of queries against all rows.

    Every partition keeps its own k best for a query, so what is shuffled does not grow with a partition's rows.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = [search(queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b), base, id_col, vector_col, k) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), id_col)
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("qid", id_col, F.col("rn").cast("long").alias("rn"))


def search(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    rows = queries.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).collect()
    ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    q = q / np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
    model = base.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = model.value
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            mine = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), -1)
            s = q @ (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)).T
            s[ids[:, None] == mine[None, :]] = -2
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            qid, at = np.repeat(ids, best.shape[1]), best.ravel()
            score = np.take_along_axis(s, best, 1).ravel()
            ok = score > -2
            yield pa.RecordBatch.from_arrays([pa.array(qid[ok]), pa.array(mine[at[ok]]), pa.array(score[ok])], names=["qid", id_col, "score"])

    return base.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, f"qid long, {id_col} long, score double")
