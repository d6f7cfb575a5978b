"""Interval algebra as bin-partitioned joins and window functions; intervals are (key, start, end), half-open unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ordered import down, running
from lodestar.session import cut

BIN = 65536


def normalised(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of at least one base: end becomes max(end, start + 1)."""
    return df.withColumn(end, F.greatest(F.col(end), F.col(start) + 1))


def _bins(df: DataFrame, start: str, last: Column, size: int) -> DataFrame:
    return df.withColumn("_first", F.floor(F.col(start) / size)).withColumn("_bin", F.explode(F.sequence(F.col("_first"), F.floor(last / size))))


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], bin_size: int = BIN, closed: bool = False, how: str = "inner") -> DataFrame:
    """Join rows whose intervals overlap within equal keys.

    Left intervals are a.(start, end), right ones b.(start_b, end_b); keys have one name on both sides. Both sides
    are dealt over the bins that they touch and joined by equality on (key, bin); a pair is kept only in its first
    common bin, so it comes out once and repeated input rows stay apart. how: inner, left, semi or anti.
    """
    if closed:
        last_a, last_b = F.col("end"), F.col("end_b")
    else:
        a, b = normalised(a), normalised(b, "start_b", "end_b")
        last_a, last_b = F.col("end") - 1, F.col("end_b") - 1
    if how in ("left", "semi", "anti"):
        a = cut(a.withColumn("_row", F.monotonically_increasing_id()))  # the same numbers in both branches below
    left = _bins(a, "start", last_a, bin_size).withColumnRenamed("_first", "_first_a")
    right = _bins(b, "start_b", last_b, bin_size).withColumnRenamed("_first", "_first_b")
    meets = (F.col("start") <= F.col("end_b")) & (F.col("end") >= F.col("start_b")) if closed else (F.col("start") < F.col("end_b")) & (F.col("end") > F.col("start_b"))
    if how in ("semi", "anti"):
        own = right.select(*key, "_bin", "start_b", "end_b")
        named = own.toDF(*[f"_k_{k}" for k in key], "_bin_b", "start_b", "end_b")
        on = (F.col("_bin") == F.col("_bin_b")) & meets
        for k in key:
            on = on & (F.col(k) == F.col(f"_k_{k}"))
        hits = left.join(named, on, "left_semi").select("_row").distinct()
        return a.join(hits, "_row", "left_semi" if how == "semi" else "left_anti").drop("_row")
    pairs = left.join(right, [*key, "_bin"]).where(meets & (F.col("_bin") == F.greatest("_first_a", "_first_b"))).drop("_bin", "_first_a", "_first_b")
    if how == "inner":
        return pairs
    missing = a.join(pairs.select("_row").distinct(), "_row", "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True).drop("_row")


def count_overlaps(q: DataFrame, t: DataFrame, key: list[str]) -> DataFrame:
    """q with n_overlaps: #(t.start < q.end) - #(t.end <= q.start), by running sums over all end points; no join."""
    points = [
        t.select(*key, F.col("start").alias("pos"), F.lit(1).alias("ord"), F.lit(1).alias("opened"), F.lit(0).alias("closed"), F.lit(None).cast("struct<id:bigint,side:int>").alias("ask")),
        t.select(*key, F.col("end").alias("pos"), F.lit(0).alias("ord"), F.lit(0).alias("opened"), F.lit(1).alias("closed"), F.lit(None).cast("struct<id:bigint,side:int>").alias("ask")),
    ]
    q = cut(q.withColumn("_id", F.monotonically_increasing_id()))  # the same numbers in both branches below
    # at equal positions: closed ends count for a query start, starts do not count for a query end
    points.append(q.select(*key, F.col("end").alias("pos"), F.lit(0).alias("ord"), F.lit(0).alias("opened"), F.lit(0).alias("closed"), F.struct(F.col("_id").alias("id"), F.lit(1).alias("side")).alias("ask")))
    points.append(q.select(*key, F.col("start").alias("pos"), F.lit(2).alias("ord"), F.lit(0).alias("opened"), F.lit(0).alias("closed"), F.struct(F.col("_id").alias("id"), F.lit(0).alias("side")).alias("ask")))
    every = points[0].unionByName(points[1]).unionByName(points[2]).unionByName(points[3])
    run = running(every, key, [F.col("pos"), F.col("ord")], {"n_open": ("sum", F.col("opened")), "n_closed": ("sum", F.col("closed"))}).where("ask IS NOT NULL")
    sums = run.groupBy(F.col("ask.id").alias("_id")).agg(F.sum(F.when(F.col("ask.side") == 1, F.col("n_open")).otherwise(-F.col("n_closed"))).alias("n_overlaps"))
    return q.join(sums, "_id").drop("_id")


def islands(df: DataFrame, key: list[str], gap: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """df with island: a new one begins where start > gap + the largest end before, within the key (book-ended rows merge).

    Rows are dealt by ranges of the key and their place, so that a key's rows need not fit one task.
    """
    order = [F.col(start), F.col(end)]
    reach = running(df, key, order, {"_before": ("max", F.col(end))}, before=True)
    opened = reach.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(start) - F.col("_before") > gap), 1).otherwise(0)).drop("_before")
    return running(opened, key, order, {"island": ("sum", F.col("_new"))}).drop("_new")


def merge_intervals(df: DataFrame, key: list[str], gap: int = 0, aggs: dict[str, Column] | None = None) -> DataFrame:
    """One row per island: start, end, and the given aggregates."""
    extra = [c.alias(n) for n, c in (aggs or {}).items()]
    return islands(df, key, gap).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("island")


def covered_bases(df: DataFrame, key: list[str]) -> DataFrame:
    """Bases covered by the union of intervals, per key."""
    return merge_intervals(df, key).groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def nearest(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """For each point a.(id, pos) the distance to the nearest interval of b.(start, end) before, at or after it.

    Distance 0 inside an interval, else the gap between the point's base and the interval (0 if they touch on the left),
    null where the key has none. Two running extremes over the union of both sides.
    """
    pts = a.select(*key, F.col("pos").alias("at"), F.lit(1).alias("ord"), F.col("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    ivs = b.select(*key, F.col("start").cast("long").alias("at"), F.lit(0).alias("ord"), F.lit(None).cast("long").alias("id"), F.col("start").cast("long"), F.col("end").cast("long"))
    every = running(pts.unionByName(ivs), key, [F.col("at"), F.col("ord")], {"reach": ("max", F.col("end"))})
    found = running(every, key, [down("at"), down("ord")], {"following": ("min", F.col("start"))}).where("id IS NOT NULL")
    back = F.when(F.col("reach") > F.col("at"), 0).otherwise(F.col("at") - F.col("reach"))
    ahead = F.when(F.col("following").isNotNull(), F.greatest(F.col("following") - F.col("at") - 1, F.lit(0)))
    return found.select(*key, "id", F.col("at").alias("pos"), F.least(back, ahead).cast("long").alias("distance"))


def distance_pairs(a: DataFrame, b: DataFrame, key: list[str], window: int) -> DataFrame:
    """Pairs with |a.pos - b.pos_b| < window within equal keys: bins of the window's width and their neighbours."""
    left = a.withColumn("_bin", F.explode(F.array(*(F.floor(F.col("pos") / window) + d for d in (-1, 0, 1)))))
    right = b.withColumn("_bin", F.floor(F.col("pos_b") / window))
    return left.join(right, [*key, "_bin"]).drop("_bin").where(F.abs(F.col("pos") - F.col("pos_b")) < window)


def distance_group(distance: Column, edges: list[int]) -> Column:
    """Right-closed bins (lo, hi] named by hi; 0 for distance 0 or beyond the last edge."""
    out = F.lit(0)
    for lo, hi in reversed(list(zip([0, *edges], edges, strict=False))):
        out = F.when((distance > lo) & (distance <= hi), F.lit(hi)).otherwise(out)
    return out
