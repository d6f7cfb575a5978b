"""Graph operators over edge tables: components, degrees, k-hop and breadth-first expansion."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut

#: Targets a block of bits holds, links at a time, targets from which a middle is a row of bits, links of a part.
BLOCK, STRIDE, DENSE, PART_LINKS = 8192, 2048, 32, 3_000_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every endpoint of links; component is the smallest node id that is reachable.

    Each round contracts every node into the neighbour of least hashed id (itself included) and keeps the
    edges that are left between contracted nodes. Hashing the ids (xxhash64 is one-to-one on one long) makes
    the order random, so that chains of ascending ids also shrink by a constant factor a round. Only minima
    are aggregated, which combine before the shuffle; no neighbour list is ever gathered.
    Null endpoints and self-loops form no link; an endpoint seen only in a self-loop is its own component.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = links.select(u.alias("a"), v.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = cut(names.select("node", F.xxhash64("node").alias("at")))
    edges = pairs.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")).where("u <> v")
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        to = cut(ends.groupBy(F.col("e.u").alias("u")).agg(F.min("e.v").alias("m")).select("u", F.least("u", "m").alias("p")))
        left, right = to.select("u", F.col("p").alias("pu")), to.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(left, "u").join(right, "v").where("pu <> pv")
        edges = cut(edges.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        at = cut(at.join(to, F.col("at") == F.col("u"), "left").select("node", F.coalesce("p", "at").alias("at")))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = at.groupBy("at").agg(F.min("node").alias("component"))
    return at.join(least, "at").select("node", "component")


def breadth_first(edges: DataFrame, start: DataFrame, depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, depth) of what is reachable from start over undirected edges within depth hops; lineage is cut each hop."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(both, front["node"] == both["u"]).select(F.col("v").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen

def _pairs_reached(x: np.ndarray, mx: np.ndarray, my: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, number of different y other than it) over links (x, mx) and (my, y) with mx = my.

    Targets go by blocks of BLOCK bits. A middle with many targets in a block is a row of bits, and the rows of a node's
    middles are joined by or; the targets of the others are set one by one. Work space is bounded however many paths
    there are.
    """
    middles = np.intersect1d(mx, my)
    keep, keep_y = np.isin(mx, middles), np.isin(my, middles)
    x, mx, my, y = x[keep], np.searchsorted(middles, mx[keep]), np.searchsorted(middles, my[keep_y]), y[keep_y]
    order = np.argsort(x, kind="stable")
    nodes, edge_node = np.unique(x[order], return_inverse=True)
    mx = mx[order]
    targets, y = np.unique(y, return_inverse=True)
    order = np.lexsort((my, y // BLOCK))
    my, y = my[order], y[order]
    total = np.zeros(len(nodes), np.int64)
    own = np.searchsorted(targets, nodes)
    own = np.where((own < len(targets)) & (targets[np.minimum(own, max(len(targets) - 1, 0))] == nodes), own, -1) if len(targets) else np.full(len(nodes), -1)
    for first in range(0, len(targets), BLOCK):
        a, b = np.searchsorted(y // BLOCK, [first // BLOCK, first // BLOCK + 1])
        m, bit = my[a:b], y[a:b] - first
        n = np.bincount(m, minlength=len(middles))
        lead = np.cumsum(n) - n
        dense = np.flatnonzero(n >= DENSE)
        row = np.full(len(middles), -1)
        row[dense] = np.arange(len(dense))
        rows = np.zeros((len(dense), BLOCK // 64), np.uint64)
        for k in range(0, len(dense), 1024):
            flags = np.zeros((min(1024, len(dense) - k), BLOCK), bool)
            inside = (row[m] >= k) & (row[m] < k + 1024)
            flags[row[m[inside]] - k, bit[inside]] = True
            rows[k : k + 1024] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        edges = np.flatnonzero(n[mx] > 0)
        node_of = edge_node[edges]
        at = 0
        while at < len(edges):
            # whole nodes, STRIDE edges or one node
            end = min(at + STRIDE, len(edges))
            if end < len(edges):
                back = np.searchsorted(node_of, node_of[end], "left")
                end = int(back if back > at else np.searchsorted(node_of, node_of[end], "right"))
            part = edges[at:end]
            who, place = np.unique(node_of[at:end], return_inverse=True)
            at = end
            out = np.zeros((len(who), BLOCK // 64), np.uint64)
            is_dense = row[mx[part]] >= 0
            for s in range(0, int(is_dense.sum()), STRIDE):  # one node may have more
                p, r = place[is_dense][s : s + STRIDE], row[mx[part[is_dense][s : s + STRIDE]]]
                starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                out[p[starts]] |= np.bitwise_or.reduceat(rows[r], starts, axis=0)
            light, light_place = part[~is_dense], place[~is_dense]
            for s in range(0, len(light), STRIDE):
                e, p = mx[light[s : s + STRIDE]], light_place[s : s + STRIDE]
                low, high = p.min(), p.max() + 1
                flags = np.zeros((high - low, BLOCK), bool)
                size = n[e]
                before = np.cumsum(size) - size
                flags[np.repeat(p - low, size), bit[np.repeat(lead[e] - before, size) + np.arange(size.sum())]] = True
                out[low:high] |= np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
            found = np.bitwise_count(out).sum(axis=1, dtype=np.int64)
            self_bit = own[who] - first
            mine = np.flatnonzero((own[who] >= 0) & (self_bit >= 0) & (self_bit < BLOCK))
            found[mine] -= (out[mine, self_bit[mine] // 64] >> (self_bit[mine] % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            total[who] += found
    return nodes, total


def two_hop_counts(edges: DataFrame) -> DataFrame:
    """(node, two_hop): how many other nodes two undirected links (a, b) lead to; nodes that reach none are left out.

    Paths are counted, not written: links are dealt by the hash of one end and packed, and every pair of parts is one
    task. A hub of n nodes has n squared paths, but n bits.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long"))
    u = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    n = e.count() * 2
    parts = min(max(1, -(-n // 200_000)), max(6, -(-n // PART_LINKS)))

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def packed():
            t = pa.Table.from_batches(held)
            part, a, b = (t.column(k).to_numpy() for k in range(3))
            order = np.lexsort((b, a, part))
            part, a, b = part[order], a[order], b[order]
            leads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(leads[1:], len(part))
            blobs = [zlib.compress(np.concatenate([np.diff(a[i:j], prepend=0), b[i:j]]).tobytes(), 1) for i, j in zip(leads, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[leads], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "links"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(h.num_rows for h in held) >= 500_000:
                yield packed()
                held.clear()
        if held:
            yield packed()

    def tile(t: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            blobs = [np.frombuffer(zlib.decompress(v), np.int64) for s, v in zip(t.column("side").to_pylist(), t.column("links").to_pylist(), strict=True) if s == side]
            sides.append([np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.cumsum(v[: len(v) // 2]) for v in blobs], [v[len(v) // 2 :] for v in blobs])])
        node, found = _pairs_reached(sides[0][0], sides[0][1], sides[1][1], sides[1][0])
        return pa.table({"node": pa.array(node, pa.int64()), "two_hop": pa.array(found, pa.int64())})

    dealt = cut(u.select(F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int").alias("part"), "a", "b").mapInArrow(pack, "part int, links binary"))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    one = dealt.select(F.col("part").alias("i"), other.alias("j"), F.lit(0).alias("side"), "links")
    two = dealt.select(F.col("part").alias("j"), other.alias("i"), F.lit(1).alias("side"), "links").select("i", "j", "side", "links")
    counted = one.unionByName(two).groupBy("i", "j").applyInArrow(tile, "node long, two_hop long")
    return counted.groupBy("node").agg(F.sum("two_hop").alias("two_hop")).where("two_hop > 0")
