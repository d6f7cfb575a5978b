"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact at a cosine threshold.

Unit vectors are turned into the basis of their principal components, the largest variance first. Two unit vectors
with cosine c have distance sqrt(2 - 2c), so only vectors whose leading two components fall into the same or
neighbouring cells of that width can be linked; a cell is dealt in blocks, and every pair of blocks is one tile.
In a tile products are accumulated over the leading dimensions first. What the rest can add is at most the product
of the suffix norms, and a pair is given up as soon as its cosine cannot reach the threshold any more. What is left
is decided in double precision on the vectors as they came. A tile returns the number of links of each vector and
a spanning forest of its links, never all pairs. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow
from lodestar.operators.graph import connected_components
from lodestar.session import cut

THRESHOLD = 0.98
#: Vectors in a block of a cell: a row is copied once for each block of its cell, and a tile takes BLOCK * BLOCK products.
BLOCK = 1024
#: Cells up to which their sizes are broadcast to the rows, so that the rows of a large cell do not meet before they are dealt.
SMALL_CELLS = 200_000
#: Vectors, about, that the basis is computed from; any orthonormal basis gives the same result.
BASIS_SAMPLE = 4096
#: Dimensions accumulated before each bound.
STEPS = (8, 8, 16, 32)
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def basis_of(x: np.ndarray) -> np.ndarray:
    """Orthonormal basis by falling variance, as columns."""
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, ::-1])


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) of rotated unit vectors whose cosine may reach the threshold."""
    rest_left, rest_right = np.ones(len(left)), np.ones(len(right))
    total, dim, at = np.zeros((len(left), len(right))), left.shape[1], 0
    steps = iter(STEPS)
    while at < dim:
        to = min(dim, at + next(steps, 64))
        a, b = left[:, at:to], right[:, at:to]
        total += a @ b.T
        rest_left, rest_right = rest_left - (a * a).sum(axis=1), rest_right - (b * b).sum(axis=1)
        bound = np.sqrt(np.maximum(rest_left, 0))[:, None] * np.sqrt(np.maximum(rest_right, 0))
        at = to
        alive = total + bound >= threshold - SLACK
        if at < dim and np.count_nonzero(alive) * 16 < alive.size:  # few are left: go on pair by pair
            i, j = np.nonzero(alive)
            sums = total[i, j]
            while at < dim and len(i):
                to = min(dim, at + next(steps, 64))
                a, b = left[i, at:to], right[j, at:to]
                sums = sums + (a * b).sum(axis=1)
                rest_left, rest_right = rest_left - (left[:, at:to] ** 2).sum(axis=1), rest_right - (right[:, at:to] ** 2).sum(axis=1)
                keep = sums + np.sqrt(np.maximum(rest_left[i], 0) * np.maximum(rest_right[j], 0)) >= threshold - SLACK
                i, j, sums, at = i[keep], j[keep], sums[keep], to
            return i, j
    return np.nonzero(total >= threshold - SLACK)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (i, j) among n nodes."""
    parent = list(range(n))
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            out.append((a, b))
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector, linked within equal labels at cosine >= threshold.

    n_links is the number of other vectors linked directly (different ids of equal vectors count each),
    component_id the smallest vec_id reachable, kept whether that is the vector itself. Vectors of different
    length are not compared. A vector that is null, empty, zero or holds null or non-finite components, or has no
    label or no id, links with nothing: n_links 0 and component_id its own id. Repeated rows stay and count once.
    Other columns are not looked at.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{label_col}`").alias("label"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    classes = cut(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies")))
    spark = vectors.sparkSession
    total = classes.count()
    point = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = [np.array(r.v, np.float64) for r in classes.where(point < BASIS_SAMPLE / max(1, total)).select("v").collect()]
    bases = {n: basis_of(unit(np.stack([x for x in sample if len(x) == n]))) for n in {len(x) for x in sample}}
    model = spark.sparkContext.broadcast(bases)
    width = math.sqrt(2 - 2 * threshold) + 1e-6

    def rotated(x: np.ndarray) -> np.ndarray:
        x = unit(x)
        basis = model.value.get(x.shape[1])
        return x if basis is None else x @ basis

    def cells(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            lead = np.zeros((len(lists), 2))
            for n in np.unique(sizes):
                rows_n = np.flatnonzero(sizes == n)
                lead[rows_n, : min(2, n)] = rotated(matrix(lists.take(pa.array(rows_n))))[:, :2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead[:, 0]), pa.array(lead[:, 1])], names=["id", "label", "v", "copies", "x", "y"])

    kinds = dict(classes.dtypes)
    placed = map_arrow(classes.select("id", "label", "v", "copies"), cells, f"id long, label {kinds['label']}, v {kinds['v']}, copies long, x double, y double")
    w = F.lit(width)
    placed = placed.select("id", "label", "v", "copies", F.size("v").alias("dim"), "x", "y", F.floor(F.col("x") / w).alias("cx"), F.floor(F.col("y") / w).alias("cy"))
    # a vector is at home in its cell and visits the four neighbours that come before it, if it is near enough
    homes = [F.struct(F.col("cx").alias("cx"), F.col("cy").alias("cy"), F.lit(True).alias("home"))]
    for dx, dy in ((-1, -1), (-1, 0), (-1, 1), (0, -1)):
        gap_x = F.col("x") - F.col("cx") * w if dx else F.lit(0.0)
        gap_y = {-1: F.col("y") - F.col("cy") * w, 0: F.lit(0.0), 1: (F.col("cy") + 1) * w - F.col("y")}[dy]
        near = gap_x * gap_x + gap_y * gap_y <= w * w
        homes.append(F.when(near, F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.lit(False).alias("home"))))
    stays = cut(placed.select("id", "label", "v", "copies", "dim", F.explode(F.array_compact(F.array(*homes))).alias("c")).select("id", "label", "v", "copies", "dim", "c.cx", "c.cy", "c.home"))
    cell = ["label", "dim", "cx", "cy"]
    sizes = stays.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("n_home")).where("n > 1 AND n_home > 0")
    sizes = cut(sizes)
    if sizes.count() <= SMALL_CELLS:
        sizes = F.broadcast(sizes)
    dealt = stays.join(sizes, cell).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*cell, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "v", "copies", "home")

    def compare(table: pa.Table) -> pa.Table:
        block, p, q = (table.column(c).to_numpy() for c in ("block", "p", "q"))
        ids, copies, home = (table.column(c).to_numpy() for c in ("id", "copies", "home"))
        plain = matrix(table.column("v"))
        plain = plain / np.abs(plain).max(axis=1, keepdims=True)
        x = rotated(plain)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if not len(left) or not len(right):
            i = j = np.zeros(0, np.int64)
        else:
            i, j = tile_links(x[left], x[right], threshold)
            i, j = left[i], right[j]
        keep = (home[i] | home[j]) & (i < j if p[0] == q[0] else i != j)
        i, j = i[keep], j[keep]
        norm = np.sqrt((plain * plain).sum(axis=1))
        exact = np.concatenate([np.zeros(0), *((plain[i[k : k + 65536]] * plain[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536))])
        keep = exact / (norm[i] * norm[j]) >= threshold
        i, j = i[keep], j[keep]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(links)
        edges = forest(len(ids), i, j)
        a = np.concatenate([ids[some], ids[[e[0] for e in edges]] if edges else np.zeros(0, np.int64)])
        b = pa.array([None] * len(some) + [int(ids[e[1]]) for e in edges], pa.int64())
        n = pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(edges), np.int64)]), pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": n})

    found = cut(dealt.groupBy(*cell, "p", "q").applyInArrow(compare, "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b IS NOT NULL")).withColumnRenamed("node", "id")
    of = classes.join(counts, "id", "left").join(parts, "id", "left")
    of = of.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    none = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("ok").join(of, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
