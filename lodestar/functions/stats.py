"""Statistics as column expressions and window functions that Catalyst plans, without Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ordered import down, running


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "avg_rank", descending: bool = False) -> DataFrame:
    """Average rank of ties within the keys: the different values are counted and ranked, then met again by value.

    A null is a value, the first in rising and the last in falling order.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, by, [down(value) if descending else F.col(value)], {"_to": ("sum", F.col("_n"))})
    keys = [*by, value]
    side = ranked.select(*(F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keys)), (F.col("_to") - (F.col("_n") - 1) / 2.0).alias(name))
    on = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)))
    return df.join(side, on).drop(*(f"_k{k}" for k in range(len(keys))))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: list[str], name: str = "q") -> DataFrame:
    """Adjusted p: running minimum from the largest p of p * n / rank, at most 1. Null p stays null and is not counted.

    Two running passes over ranges of (keys, p), so that no key, and not the whole table, is one task's.
    """
    some, none = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull())
    ranked = running(some, by, [F.col(p), *(F.col(t) for t in tie)], {"_rank": ("sum", F.lit(1).cast("long"))})
    sizes = some.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        sizes = sizes.select(*(F.col(f"`{c}`").alias(f"_b{k}") for k, c in enumerate(by)), "_n")
        on = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)))
        ranked = ranked.join(sizes, on).drop(*(f"_b{k}" for k in range(len(by))))
    else:
        ranked = ranked.crossJoin(F.broadcast(sizes))  # one row
    back = running(ranked, by, [down(p), *(down(t) for t in tie)], {"_q": ("min", F.col(p) * F.col("_n") / F.col("_rank"))})
    out = back.withColumn(name, F.least(F.lit(1.0), F.col("_q"))).drop("_rank", "_n", "_q")
    return out.unionByName(none.withColumn(name, F.lit(None).cast("double")))


def bonferroni(p: Column, n: Column) -> Column:
    """p times n, at most 1; null stays null."""
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p * n))


def enrichment(x1: Column, n1: Column, x2: Column, n2: Column, z: float = 1.959963984540054, compat: bool = False) -> dict[str, Column]:
    """Risk ratio, its standard error and its confidence interval on the log scale; null where they have no value.

    No hit in the sample gives the ratio 0 and an interval from 0 to null, none in the background alone an infinite
    ratio and an interval from null to infinity. compat adds the background's term outside of the root.
    """
    inf = F.lit(float("inf"))
    a, b = F.try_divide(n1 - x1, x1 * n1), F.try_divide(n2 - x2, x2 * n2)
    rows, none = (n1 > 0) & (n2 > 0), (x1 == 0) & (x2 == 0)
    e = F.when(rows & ~none, F.when(x2 == 0, inf).otherwise(F.try_divide(F.try_divide(x1, n1), F.try_divide(x2, n2))))
    se = F.when(rows, F.coalesce(F.sqrt(a) + b if compat else F.sqrt(a + b), inf))
    low, high = F.exp(F.log(e) - z * se), F.exp(F.log(e) + z * se)
    some = (x1 > 0) & (x2 > 0)
    return {
        "enrichment": e,
        "se": se,
        "ci_low": F.when(rows & some, low).when(rows & (x1 == 0) & (x2 > 0), 0.0),
        "ci_high": F.when(rows & some, high).when(rows & (x2 == 0) & (x1 > 0), inf),
    }


def proportion(x: Column, n: Column, z: float = 1.959963984540054) -> dict[str, Column]:
    """Raw share, adjusted standard error and its interval about the raw share; of no rows, only the error has a value."""
    adj = (x + 2) / (n + 4)
    se, share = F.sqrt(adj * (1 - adj) / (n + 4)), F.try_divide(x, n)
    return {"share": share, "se": se, "ci_low": share - z * se, "ci_high": share + z * se}


def welch_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    return (mean_b - mean_a) / F.sqrt(var_a / n_a + var_b / n_b)


#: Exponent and scale of the power law of contacts.
GAMMA, SCALE = 1.024238616787792, 5.9594510043736655


def powerlaw_contact(distance: Column, gamma: float = GAMMA, scale: float = SCALE, least: int = 5000) -> Column:
    return F.exp(F.lit(scale) - F.lit(gamma) * F.log(F.greatest(distance, F.lit(least)) + 1))


def na_poison(value: str, how: str) -> Column:
    """Aggregate that is null as soon as one value of the group is null or NaN."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    agg = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "median": F.median}[how]
    return F.when(F.count(F.lit(1)) == F.count(x), agg(x))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (groups, n, f, p) of the variance between groups over that within them, from each group's own variance.

    Without variance within groups f is infinite and p 0 if the means differ, else both are null, as for one group.
    """
    from lodestar.functions.numeric import f_tail

    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    grand = x.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_g"))
    d = F.col("m") - F.col("_g")
    s = x.crossJoin(F.broadcast(grand)).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * d * d).alias("_b"), F.sum((F.col("n") - 1) * F.col("v")).alias("_w"))
    ok = (F.col("groups") > 1) & (F.col("n") > F.col("groups"))
    f = F.when(ok & (F.col("_w") > 0), (F.col("_b") / (F.col("groups") - 1)) / (F.col("_w") / (F.col("n") - F.col("groups")))).when(ok & (F.col("_b") > 0), float("inf"))
    s = s.withColumn("f", f)
    p = F.when(F.col("f").isNotNull(), f_tail(F.coalesce("f", F.lit(0.0)), F.greatest(F.col("groups") - 1, F.lit(1)).cast("double"), F.greatest(F.col("n") - F.col("groups"), F.lit(1)).cast("double")))
    return s.select("groups", "n", "f", p.alias("p"))


def mean_in_order(df: DataFrame, by: list[str], values: dict[str, str], place: str) -> DataFrame:
    """(by, names) with the mean of a column per name, its values added one by one in the order of place.

    Which of two floating sums of equal values is larger depends on the order alone; here neither partitions nor tasks
    decide it. Sorting spills; a group need not fit in memory.
    """
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    run = df.select(*by, place, *(x for c in values.values() for x in (F.sum(c).over(w).alias(f"_s_{c}"), F.count(c).over(w).alias(f"_n_{c}"))))
    return run.groupBy(*by).agg(*(F.max_by(F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0)), place).alias(name) for name, c in values.items()))


def deviation_in_order(value: str, place: str) -> Column:
    """Aggregate: the sample deviation of a column's values by one updating pass in the order of place; null below two values.

    Like mean_in_order it depends on no partition. The values of a group are one array.
    """
    x = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(place).alias("at"), F.col(value).cast("double").alias("x")))))

    def step(state: Column, v: Column) -> Column:
        n, off = state["n"] + 1, v["x"] - state["mean"]
        mean = state["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (state["square"] + (v["x"] - mean) * off).alias("square"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))
    return F.aggregate(x, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["square"] / (s["n"] - 1))))
