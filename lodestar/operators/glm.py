"""Count models per group: negative binomial regression with covariates, tests, mixtures, selection and resampling.

Rows of a group that are equal in all columns of the model are counted first, so that a group's table is as large as its
different rows; one group is fitted by one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.numeric import chi2_tail, digamma, log_gamma, normal_tail, trigamma


def nb_loglik(y: np.ndarray, mu: np.ndarray, theta: float, n: np.ndarray | float = 1.0) -> float:
    """Log-likelihood of counts under a negative binomial of mean mu and size theta; Poisson for an infinite size."""
    mu = np.maximum(mu, 1e-12)
    if not np.isfinite(theta):
        return float((n * (y * np.log(mu) - mu - log_gamma(y + 1))).sum())
    return float((n * (log_gamma(y + theta) - log_gamma(np.full_like(y, theta)) - log_gamma(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu)))).sum())


def nb_fit(y: np.ndarray, x: np.ndarray, n: np.ndarray, offset: np.ndarray, theta: float = np.inf, beta: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, mu, covariance) of a log-linear count regression by iteratively reweighted least squares."""
    if beta is None:
        beta = np.zeros(x.shape[1])
        beta[0] = np.log(max((y * n).sum(), 0.5) / max((np.exp(offset) * n).sum(), 1e-12))
    last = np.inf
    for _ in range(rounds):
        eta = np.clip(x @ beta + offset, -30, 30)
        mu = np.exp(eta)
        w = n * mu / (1 + mu / theta)
        z = eta - offset + (y - mu) / mu
        info = (x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1])
        beta = np.linalg.solve(info, (x * w[:, None]).T @ z)
        mu = np.exp(np.clip(x @ beta + offset, -30, 30))
        now = nb_loglik(y, mu, theta, n)
        if abs(now - last) < 1e-9 * (abs(now) + 1e-6):
            break
        last = now
    w = n * mu / (1 + mu / theta)
    return beta, mu, np.linalg.pinv((x * w[:, None]).T @ x)


def theta_ml(y: np.ndarray, mu: np.ndarray, n: np.ndarray, rounds: int = 50) -> float:
    """Size of the negative binomial by maximum likelihood (Newton on its logarithm), between 1e-3 and 1e6."""
    spread = (n * ((y - mu) ** 2 / np.maximum(mu, 1e-12) - 1) / np.maximum(mu, 1e-12)).sum() / n.sum()
    theta = float(np.clip(1 / max(spread, 1e-6), 1e-2, 1e4))
    for _ in range(rounds):
        score = (n * (digamma(y + theta) - digamma(np.full_like(y, theta)) + np.log(theta) + 1 - np.log(theta + mu) - (y + theta) / (theta + mu))).sum()
        info = (n * (trigamma(np.full_like(y, theta)) - trigamma(y + theta) - 1 / theta + 2 / (theta + mu) - (y + theta) / (theta + mu) ** 2)).sum()
        slope = theta * score
        curve = -(theta * theta * info) + slope
        step = -slope / curve if curve < 0 else np.sign(slope) * 0.5
        new = float(np.clip(theta * np.exp(np.clip(step, -1, 1)), 1e-3, 1e6))
        if abs(new - theta) < 1e-8 * theta:
            return new
        theta = new
    return theta


def counted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Different rows of the keys and columns, with how often they occur."""
    return df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"))


def _matrix(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *(pdf[c].to_numpy(float) for c in columns)])


def nb_glm(df: DataFrame, keys: list[str], y: str, covariates: list[str], offset: str | None = None) -> DataFrame:
    """(keys, n, theta, term, beta, se) per group: a Poisson fit, its size by maximum likelihood, and the fit with it.

    Terms are intercept and the covariates. Rows with a null in a column do not count; a group without any count has no
    rows.
    """
    columns = [y, *covariates, *([offset] if offset else [])]
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, counts, x = pdf["_n"].to_numpy(float), pdf[y].to_numpy(float), _matrix(pdf, covariates)
        off = pdf[offset].to_numpy(float) if offset else np.zeros(len(pdf))
        names = ["intercept", *covariates]
        if counts.sum() == 0:
            return pd.DataFrame({**{k: [] for k in keys}, "n": [], "theta": [], "term": [], "beta": [], "se": []})
        start, mu, _ = nb_fit(counts, x, n, off)
        theta = theta_ml(counts, mu, n)
        beta, _, cov = nb_fit(counts, x, n, off, theta, start)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(names) for k in keys}, "n": int(n.sum()), "theta": theta, "term": names, "beta": beta, "se": np.sqrt(np.maximum(np.diag(cov), 0))})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, theta double, term string, beta double, se double"])
    return counted(df.dropna(subset=columns), keys, columns).groupBy(*keys).applyInPandas(fit, schema)


def likelihood_ratio(df: DataFrame, keys: list[str], y: str, tested: str, covariates: list[str], offset: str | None = None, min_tested: int = 1) -> DataFrame:
    """(keys, n, n_tested, beta, fold, statistic, p) of one 0/1 covariate against the model without it, per group.

    The size is that of the smaller model. Groups with fewer than min_tested rows of it, or without counts, are left out.
    """
    columns = [y, tested, *covariates, *([offset] if offset else [])]
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, counts, x0 = pdf["_n"].to_numpy(float), pdf[y].to_numpy(float), _matrix(pdf, covariates)
        x = pdf[tested].to_numpy(float)
        off = pdf[offset].to_numpy(float) if offset else np.zeros(len(pdf))
        if (n * x).sum() < min_tested or counts.sum() == 0:
            return pd.DataFrame({**{k: [] for k in keys}, "n": [], "n_tested": [], "beta": [], "fold": [], "statistic": [], "p": []})
        b0, mu, _ = nb_fit(counts, x0, n, off)
        theta = theta_ml(counts, mu, n)
        b0, mu, _ = nb_fit(counts, x0, n, off, theta, b0)
        b1, mu1, _ = nb_fit(counts, np.column_stack([x0, x]), n, off, theta, np.append(b0, 0.0))
        stat = max(2 * (nb_loglik(counts, mu1, theta, n) - nb_loglik(counts, mu, theta, n)), 0.0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [int(n.sum())], "n_tested": [int((n * x).sum())], "beta": [b1[-1]], "fold": [float(np.exp(b1[-1]))], "statistic": [stat], "p": [float(chi2_tail(np.array([stat]))[0])]})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, n_tested long, beta double, fold double, statistic double, p double"])
    return counted(df.dropna(subset=columns), keys, columns).groupBy(*keys).applyInPandas(fit, schema)


def pseudobulk_de(counts: DataFrame, gene: str, group: str, a: str, b: str, value: str, size: str, least: int = 10) -> DataFrame:
    """(gene, mean_a, mean_b, log2fc, p) of b over a between samples: counts (gene, sample, group, value, size factor).

    Counts are divided by their size factor; the dispersion is by moments over both groups, and the change of the log
    means is tested by its standard error under the negative binomial. Genes with fewer counts than least are left out.
    """
    x = F.col(value) / F.when(F.col(size) > 0, F.col(size)).otherwise(1.0)
    side = lambda f, g: f(F.when(F.col(group) == g, x))
    t = counts.groupBy(gene).agg(F.sum(value).alias("_t"), side(F.avg, a).alias("mean_a"), side(F.avg, b).alias("mean_b"), side(F.var_samp, a).alias("_va"), side(F.var_samp, b).alias("_vb"), F.count_if(F.col(group) == a).alias("_na"), F.count_if(F.col(group) == b).alias("_nb"))
    t = t.where(F.col("_t") >= least)
    phi = lambda m, v: F.greatest(F.lit(0.0), (v - m) / F.greatest(m * m, F.lit(1e-12)))
    d = (phi(F.col("mean_a"), F.col("_va")) * F.col("_na") + phi(F.col("mean_b"), F.col("_vb")) * F.col("_nb")) / (F.col("_na") + F.col("_nb"))
    ma, mb = F.col("mean_a") + 0.5, F.col("mean_b") + 0.5
    se = F.sqrt((1 / ma + d) / F.col("_na") + (1 / mb + d) / F.col("_nb"))
    t = t.withColumn("_z", F.log(mb / ma) / se)

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return pd.Series(2 * normal_tail(np.abs(z.to_numpy(float))))

    return t.select(gene, "mean_a", "mean_b", F.log2(mb / ma).alias("log2fc"), two_sided("_z").alias("p"))


def poisson_mixture(df: DataFrame, key: str, cell: str, y: str, covariates: list[str], threshold: float = 0.8, least_cells: int = 10, backup: float = 5.0, rounds: int = 100) -> DataFrame:
    """(key, cell, probability, method) of the cells of each guide that hold it: a Poisson mixture about the background.

    The background of a cell is a Poisson regression on the covariates; cells with the guide have a larger mean, by one
    factor. Shares and factor come by EM, and cells with any count are assigned from the threshold on. A guide seen in
    fewer than least_cells cells takes those with backup counts or more. One group is all cells of a guide.
    """
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf[y].to_numpy(float)
        if (counts > 0).sum() < least_cells:
            hit, prob, method = counts >= backup, np.full(len(counts), np.nan), "backup"
        else:
            x, one = _matrix(pdf, covariates), np.ones(len(counts))
            _, mu, _ = nb_fit(counts, x, one, np.zeros(len(counts)))
            share, fold = 0.1, max(2.0, float(np.quantile(counts[counts > 0], 0.75) / max(mu.mean(), 1e-9)))
            for _ in range(rounds):
                with np.errstate(over="ignore"):
                    odds = np.log(share / (1 - share)) + counts * np.log(fold) - mu * (fold - 1)
                    prob = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                share = float(np.clip(prob.mean(), 1e-6, 0.5))
                new = max(1.0 + 1e-6, float((prob * counts).sum() / max((prob * mu).sum(), 1e-12)))
                if abs(new - fold) < 1e-8 * fold:
                    break
                fold = new
            hit, method = (prob >= threshold) & (counts > 0), "mixture"
        return pd.DataFrame({key: pdf[key][hit], cell: pdf[cell][hit], "probability": prob[hit], "method": method})

    return df.groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, {cell} {kinds[cell]}, probability double, method string")


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Sum of precision times the gain in recall over places by falling score; equal scores keep their order."""
    order = np.argsort(-score, kind="stable")
    hit = y[order].astype(float)
    if not hit.sum():
        return 0.0
    precision = np.cumsum(hit) / np.arange(1, len(hit) + 1)
    return float((precision * hit).sum() / hit.sum())


def forward_selection(evaluate: Callable[[list[str]], float], features: list[str]) -> list[tuple[str, float]]:
    """Features in the order in which they improve an evaluation most, with what is reached; ties go to the later one."""
    rest, chosen, out = list(features), [], []
    while rest:
        scores = [evaluate([*chosen, f]) for f in rest]
        k = max(range(len(rest)), key=lambda i: (scores[i], i))
        out.append((rest[k], scores[k]))
        chosen.append(rest.pop(k))
    return out


def backward_selection(evaluate: Callable[[list[str]], float], features: list[str]) -> list[tuple[str, float | None]]:
    """None and the full score, then the features by how little their removal costs, with what is left; the last one stays."""
    left = list(features)
    out: list[tuple[str, float | None]] = [("None", evaluate(left))]
    while len(left) > 1:
        scores = [evaluate([g for g in left if g != f]) for f in left]
        k = max(range(len(left)), key=lambda i: (scores[i], i))
        out.append((left.pop(k), scores[k]))
    return [*out, (left[0], None)]


def leave_out_score(df: DataFrame, fold: str, label: str, features: list[str]) -> float:
    """Average precision of predictions of each fold by a logistic model of the others, from the counts of scores."""
    from lodestar.operators.models import leave_one_out_logistic
    from lodestar.operators.ordered import precision_recall

    scored = leave_one_out_logistic(df, fold, label, features)
    curve = precision_recall(scored.select("score", F.col(label).cast("boolean").alias("_y")), "score", "_y")
    return float(curve.select("tp", "precision", "recall").toPandas().sort_values("recall").pipe(lambda t: (t.precision * t.recall.diff().fillna(t.recall)).sum()))


def permutation_importance(df: DataFrame, fold: str, label: str, features: list[str], repeats: int, seed: int = 0) -> list[tuple[str, int, float]]:
    """(feature, repeat, loss of average precision) when a feature's values are dealt anew among the rows.

    The values are dealt by ranks of two hashes of the rows, so that no row order is relied on.
    """
    from lodestar.operators.ordered import row_numbers

    full = leave_out_score(df, fold, label, features)
    keyed = df.withColumn("_id", F.monotonically_increasing_id())
    out = []
    for f in features:
        for k in range(repeats):
            one = row_numbers(keyed.drop(f), [F.xxhash64("_id", F.lit(seed + 2 * k)), F.col("_id")], "_a")
            two = row_numbers(keyed.select(f, F.col("_id").alias("_i2")), [F.xxhash64("_i2", F.lit(seed + 2 * k + 1)), F.col("_i2")], "_b").select(f, "_b")
            mixed = one.join(two, F.col("_a") == F.col("_b")).select(*df.columns)
            out.append((f, k, full - leave_out_score(mixed, fold, label, features)))
    return out


def bootstrap(df: DataFrame, keys: list[str], value: str, repeats: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, n, mean, low, high): percentile interval of a mean by the Poisson bootstrap, in one pass.

    Each row has a weight in each repeat from a hash of its value and place, so weights need no shuffle; the sums of all
    repeats are aggregated as one array.
    """
    rate = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    u = lambda r: F.pmod(F.xxhash64(F.lit(seed), r, "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = lambda r: F.size(F.filter(F.array(*(F.lit(x) for x in rate)), lambda x: x <= u(r))).cast("double")
    rows = df.where(F.col(value).isNotNull()).withColumn("_id", F.monotonically_increasing_id())
    each = rows.select(*keys, F.col(value).cast("double").alias("_x"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), weight)).alias("_r", "_w"))
    means = each.groupBy(*keys, "_r").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    bounds = means.groupBy(*keys).agg(F.percentile("_m", (1 - level) / 2).alias("low"), F.percentile("_m", (1 + level) / 2).alias("high"))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return whole.join(bounds, keys) if keys else whole.crossJoin(bounds)


def principal_components(rows: DataFrame, features: str, k: int, center: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, their variances) of an array column, from one pass that sums outer products.

    What comes to the driver is one matrix of the features' number squared, whatever the rows; their number is bounded
    by what a task can hold (a few thousand).
    """
    import pyarrow as pa

    def sums(batches):
        total, square, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            square = x.T @ x if square is None else square + x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], names=["n", "total", "square"])

    total, square, n = 0.0, 0.0, 0
    for r in rows.where(F.col(features).isNotNull()).select(features).mapInArrow(sums, "n long, total binary, square binary").toLocalIterator():
        t = np.frombuffer(bytes(r.total))
        total, square, n = total + t, square + np.frombuffer(bytes(r.square)).reshape(len(t), len(t)), n + r.n
    if not n:
        return np.zeros((0, 0)), np.zeros(0)
    mean = total / n
    cov = (square - n * np.outer(mean, mean)) / max(n - 1, 1) if center else square / n
    values, vectors = np.linalg.eigh(cov)
    return np.ascontiguousarray(vectors[:, ::-1][:, :k]), values[::-1][:k]
