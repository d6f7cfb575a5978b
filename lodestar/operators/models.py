"""Grouped model fitting: one bounded sufficient-statistics table per group, fitted by vectorised Python or by MLlib."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.numeric import hypergeometric_tail, student_p  # noqa: F401


def kendall_tau_b(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Tau-b of a numeric x with a binary y per group, from rank sums: no pairs are made.

    With y binary, concordant minus discordant pairs are 2U - n1 n0 for the Mann-Whitney U of x.
    """
    from lodestar.functions.stats import average_rank

    counted = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).alias("x"), F.col(y).cast("int").alias("y"))
    ranked = average_rank(counted, key, "x", "r")
    ties = counted.groupBy(*key, "x").agg(F.count(F.lit(1)).alias("t")).groupBy(*key).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("tied"))
    s = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"), F.sum(F.when(F.col("y") == 1, F.col("r")).otherwise(0.0)).alias("r1"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return s.join(ties, key).select(*key, "n", ((2 * u - n1 * n0) / F.sqrt(n1 * n0 * (pairs - F.col("tied")))).alias("tau"))


def mixture_thresholds(histogram: DataFrame, key: str, value: str, count: str, rounds: int = 50) -> DataFrame:
    """Two-component Poisson mixture per group by EM over a histogram; a group's histogram is bounded by its distinct values."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf[value].to_numpy(float), pdf[count].to_numpy(float)
        low, high, share = max(0.05, (x * n).sum() / n.sum() * 0.5), max(1.0, x.max() * 0.5), 0.2
        for _ in range(rounds):
            a = np.log1p(-share) + x * math.log(low) - low
            b = math.log(share) + x * math.log(high) - high
            p = 1 / (1 + np.exp(np.clip(a - b, -500, 500)))
            w = (n * p).sum()
            share = float(np.clip(w / n.sum(), 1e-4, 1 - 1e-4))
            high = max(1e-3, (n * p * x).sum() / max(w, 1e-12))
            low = max(1e-3, (n * (1 - p) * x).sum() / max((n * (1 - p)).sum(), 1e-12))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "low": [low], "high": [high], "share": [share]})

    return histogram.groupBy(key).applyInPandas(fit, f"{key} {dict(histogram.dtypes)[key]}, low double, high double, share double")


def poisson_glm(df: DataFrame, key: str, y: str, x: str, rounds: int = 25) -> DataFrame:
    """log E[y] = a + b x per group, by Newton's method over the counts of distinct (x, y)."""
    table = df.groupBy(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (pdf[c].to_numpy(float) for c in ("x", "y", "n"))
        beta = np.array([math.log(max((y * n).sum() / n.sum(), 1e-9)), 0.0])
        design = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(rounds):
            mu = np.exp(np.clip(design @ beta, -30, 30))
            grad = design.T @ (n * (y - mu))
            info = (design * (n * mu)[:, None]).T @ design + 1e-9 * np.eye(2)
            step = np.linalg.solve(info, grad)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-10:
                break
        return pd.DataFrame({key: [pdf[key].iloc[0]], "intercept": [beta[0]], "slope": [beta[1]], "se": [math.sqrt(np.linalg.inv(info)[1, 1])]})

    return table.groupBy(key).applyInPandas(fit, f"{key} {dict(table.dtypes)[key]}, intercept double, slope double, se double")


def leave_one_out_logistic(df: DataFrame, fold: str, label: str, features: list[str]) -> DataFrame:
    """Predictions of a logistic regression trained on all other folds, for each of a few folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="_features").transform(df.withColumn("_label", F.col(label).cast("double")))
    out = None
    for (value,) in sorted(data.select(fold).distinct().collect()):
        model = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=30, regParam=1e-3, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred").fit(data.where(F.col(fold) != value))
        scored = model.transform(data.where(F.col(fold) == value)).withColumn("score", vector_to_array("_p")[1]).select(*df.columns, "score")
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else df.withColumn("score", F.lit(None).cast("double"))


def moderated_t(df: DataFrame, key: list[str], value: str, sd_floor: Column | float, sd_counting: str | None = None) -> DataFrame:
    """(key, n_values, mean, sd, sd_used, t, df, p) per group: sd raised to a floor and to the group's counting bound.

    sd_counting names a column with the bound of each group (its largest value counts). A group of one value, or without
    any spread after that, has t 0 and p 1; nulls do not count.
    """
    counting = [F.max(sd_counting).alias("_counting")] if sd_counting else [F.lit(0.0).alias("_counting")]
    g = df.groupBy(*key).agg(F.count(value).alias("n_values"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *counting)
    floor = F.lit(sd_floor) if isinstance(sd_floor, (int, float)) else sd_floor
    g = g.withColumn("sd_used", F.when(F.col("n_values") > 1, F.greatest(F.col("sd"), floor, F.coalesce("_counting", F.lit(0.0))))).drop("_counting")
    se = F.col("sd_used") / F.sqrt("n_values")
    t = F.when(se > 0, F.col("mean") / se).otherwise(0.0)
    out = g.withColumn("t", t).withColumn("df", F.greatest(F.col("n_values") - 1, F.lit(0)))
    return out.withColumn("p", F.when(se > 0, student_p("t", F.col("df").cast("double"))).otherwise(1.0))
