"""Running sums, ranks and their kin over one order, without one task that holds it.

Rows are dealt by ranges of (keys, order), so every task has a stretch of the order. What a stretch adds to a key is
aggregated, and what lies before a stretch is handed to it. Only the key that a stretch begins in the middle of needs
that, so there are at most as many hand-overs as stretches, whatever the data; they are broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut


class Down(NamedTuple):
    """A column in descending order."""

    column: Column


_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], order: list[Column | Down], aggs: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """df with one column per name: the running sum, max or min of a value per key, in the order.

    aggs maps a name to ("sum" | "max" | "min", value). before leaves the row itself out (null, for sums 0, on the
    first row of a key). Rows with equal order values are taken in any, but one, order. Null keys are a key.
    """
    names = list(aggs)
    ways = [F.col(f"_o{k}").desc() if isinstance(o, Down) else F.col(f"_o{k}").asc() for k, o in enumerate(order)]
    wide = df.select("*", *((o.column if isinstance(o, Down) else o).alias(f"_o{k}") for k, o in enumerate(order)), *(v.alias(f"_v_{n}") for n, (_, v) in aggs.items()))
    wide = wide.withColumn("_row", F.monotonically_increasing_id())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(wide.repartitionByRange(n, *(F.col(f"`{k}`") for k in keys), *ways).withColumn("_part", F.spark_partition_id()))
    own = dealt.groupBy("_part", *keys).agg(*(_AGG[how](f"_v_{name}").alias(f"_b_{name}") for name, (how, _) in aggs.items()))
    # a row a stretch and key: without keys they meet in one task, as many rows as there are partitions
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = own.select("_part", *keys, F.count(F.lit(1)).over(earlier).alias("_n"), *(_AGG[how](f"_b_{name}").over(earlier).alias(f"_b_{name}") for name, (how, _) in aggs.items())).where("_n > 0").drop("_n")
    handed = handed.toDF("_hpart", *(f"_h{k}" for k in range(len(keys))), *(f"_b_{name}" for name in names))
    on = F.col("_part") == F.col("_hpart")
    for k, key in enumerate(keys):
        on = on & F.col(f"`{key}`").eqNullSafe(F.col(f"_h{k}"))
    w = Window.partitionBy("_part", *keys).orderBy(*ways, "_row").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = dealt.select("*", *(_AGG[how](f"_v_{name}").over(w).alias(f"_w_{name}") for name, (how, _) in aggs.items()))
    out = out.join(F.broadcast(handed), on, "left")  # no more rows than partitions
    done = []
    for name, (how, _) in aggs.items():
        inside, left = F.col(f"_w_{name}"), F.col(f"_b_{name}")
        if how == "sum":
            done.append((F.coalesce(inside, F.lit(0)) + F.coalesce(left, F.lit(0))).alias(name))
        else:
            done.append(_JOIN[how](inside, left).alias(name))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), *done)


def down(column: Column | str) -> Down:
    """Descending order for running()."""
    return Down(F.col(column) if isinstance(column, str) else column)


def row_numbers(df: DataFrame, order: list[Column | Down], name: str = "rn") -> DataFrame:
    """Number of each row in one order over the whole table, from 1."""
    return running(df, [], order, {name: ("sum", F.lit(1).cast("long"))})


def value_ranks(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "avg_rank") -> DataFrame:
    """Average rank of every different value: (keys, value, n, name). Ranks are over values, so ties are one row."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, keys, [F.col(value)], {"_to": ("sum", F.col("n"))})
    return ranked.withColumn(name, F.col("_to") - (F.col("n") - 1) / 2.0).drop("_to")


def percentiles(df: DataFrame, value: str, shares: list[float], name: str = "edges") -> DataFrame:
    """One row (name): the exact percentiles of a column's values that are not null, interpolated; null without any.

    Different values are counted and the counts summed over ranges of values, so that no task holds the column.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(by, [], [F.col("_x")], {"_to": ("sum", F.col("_n"))})
    total = df.agg(F.count(value).alias("_total"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    at = [F.lit(s) * (F.col("_total") - 1) for s in shares]
    value_at = lambda k: F.max(F.when((F.col("_to") - F.col("_n") <= k) & (k < F.col("_to")), F.col("_x")))
    ends = [c for k, p in enumerate(at) for c in (value_at(F.floor(p)).alias(f"_low{k}"), value_at(F.ceil(p)).alias(f"_high{k}"), F.max(p - F.floor(p)).alias(f"_d{k}"))]
    between = [F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), F.col(f"_low{k}")).otherwise(F.col(f"_low{k}") * (1 - F.col(f"_d{k}")) + F.col(f"_high{k}") * F.col(f"_d{k}")) for k in range(len(shares))]
    return placed.agg(*ends).select(F.array(*between).alias(name))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n_pos, n_neg, auroc): the share of pairs in which the positive scores higher, ties half."""
    by = df.groupBy(score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    lower = running(by, [], [F.col(score)], {"below": ("sum", F.col("neg"))}, before=True)
    u = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return lower.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), (u / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tp, fp, precision, recall) at every different score, from the highest on."""
    by = df.groupBy(score).agg(F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_n"))
    run = running(by, [], [down(score)], {"tp": ("sum", F.col("_p")), "fp": ("sum", F.col("_n"))})
    total = by.agg(F.sum("_p").alias("_total"))
    out = run.crossJoin(F.broadcast(total))  # one row
    return out.select(score, "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("_total")).alias("recall"))


def empirical_p(test: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """test with p = (r + 1) / (B + 1), r the null values strictly greater; both sides meet by different value only."""
    counts = null.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).unionByName(test.select(value).distinct().withColumn("_n", F.lit(0).cast("long")))
    by = counts.groupBy(value).agg(F.sum("_n").alias("_n"))
    above = running(by, [], [down(value)], {"_r": ("sum", F.col("_n"))}, before=True)
    total = null.agg(F.count(F.lit(1)).alias("_b"))
    p = above.crossJoin(F.broadcast(total)).select(value, ((F.col("_r") + 1) / (F.col("_b") + 1)).alias("p"))
    return test.join(p, value)


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row (n, gini) of a non-negative value, from ranks of different values."""
    ranks = value_ranks(df.where(F.col(value).isNotNull()), value)
    s = ranks.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col(value)).alias("total"), F.sum(F.col("n") * F.col(value) * F.col("avg_rank")).alias("weighted"))
    return s.select("n", (2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def inflection(df: DataFrame, score: str) -> DataFrame:
    """One row (n, rank, score): the last place that maximises y - x on the falling curve of scores.

    x runs from 0 to 1 over the places, y is the score over the largest one (over 1 if that is 0).
    """
    numbered = row_numbers(df.select(score), [down(score)], "rank")
    top = df.agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("_max"))
    placed = numbered.crossJoin(F.broadcast(top))
    x = (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    y = F.col(score) / F.when(F.col("_max") == 0, 1.0).otherwise(F.col("_max"))
    best = placed.select("n", F.struct((y - x).alias("d"), "rank", F.col(score).alias("score")).alias("s")).groupBy("n").agg(F.max("s").alias("s"))
    return best.select("n", "s.rank", "s.score")


def knee(df: DataFrame, count: str, least: int = 200, first: float = 0.001, last: float = 0.98) -> DataFrame:
    """One row (n, threshold): the positive count farthest from the chord of the log-log rank curve, else 0.

    0 stands for fewer than least rows, a flat curve, or a knee in the first or last part of the curve. Of equally
    far places the first counts.
    """
    some = df.where(F.col(count) > 0)
    ranked = row_numbers(some.select(count), [down(count)], "rank")
    ends = some.agg(F.count(F.lit(1)).alias("n"), F.max(count).alias("_max"), F.min(count).alias("_min"))
    p = ranked.crossJoin(F.broadcast(ends))
    x, y = F.log10("rank"), F.log10(count)
    dx, dy = F.log10("n"), F.log10("_min") - F.log10("_max")
    distance = F.abs(dy * x - dx * y + dx * F.log10("_max")) / F.sqrt(dx * dx + dy * dy)
    best = p.select("n", "_max", "_min", F.struct(distance.alias("d"), (-F.col("rank")).alias("r"), F.col(count).alias("c")).alias("s")).groupBy("n", "_max", "_min").agg(F.max("s").alias("s"))
    place = -F.col("s.r") - 1
    good = (F.col("n") >= least) & (F.col("_max") > F.col("_min")) & (place >= F.col("n") * first) & (place <= F.col("n") * last)
    return best.select("n", F.when(good, F.col("s.c")).otherwise(0).cast("long").alias("threshold"))


def farthest_from_chord(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (x, y): the point farthest from the line through the first and the last by x; the first of equals."""
    ends = df.agg(F.min(F.struct(x, y)).alias("a"), F.max(F.struct(x, y)).alias("b"))
    p = df.crossJoin(F.broadcast(ends))
    slope = (F.col(f"b.{y}") - F.col(f"a.{y}")) / (F.col(f"b.{x}") - F.col(f"a.{x}"))
    distance = F.abs(slope * F.col(x) - F.col(y) + F.col(f"a.{y}") - slope * F.col(f"a.{x}")) / F.sqrt(slope * slope + 1)
    best = p.where(f"b.{x} <> a.{x}").agg(F.max(F.struct(distance.alias("d"), (-F.col(x)).alias("o"), F.col(y).alias("y"))).alias("s"))
    return best.where("s IS NOT NULL").select((-F.col("s.o")).alias(x), F.col("s.y").alias(y))
