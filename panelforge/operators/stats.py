"""Screens and tests over columns: one aggregate pass each, long form instead of wide plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import EPSILON, num, stable_hash


def correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson over complete pairs; NULL under `least` pairs or where a side is constant (checked first: corr would raise)."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return F.when((F.count(a) >= least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, NULL unranked, within groups."""
    w = Window.partitionBy(*by, F.col(value).isNull()).orderBy(value)
    ties = Window.partitionBy(*by, value)
    rank = F.rank().over(w) + (F.count("*").over(ties) - 1) / 2
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank))


def long_form(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*keep, *(num(f).alias(f) for f in features)).unpivot(list(keep), list(features), "feature", "x")


def correlation_screen(df: DataFrame, target: str, features: Sequence[str], method: str = "pearson", least: int = 3) -> DataFrame:
    """(feature, n, r, p_value) of each feature against the target, by the t distribution."""
    rows = long_form(df.withColumn("y_", num(target)), ["y_"], features).where("x is not null and y_ is not null")
    if method == "spearman":
        rows = average_rank(average_rank(rows, ["feature"], "x", "rx_"), ["feature"], "y_", "ry_").select("feature", F.col("rx_").alias("x"), F.col("ry_").alias("y_"))
    out = rows.groupBy("feature").agg(F.count("*").alias("n"), correlation("x", "y_", least).alias("r"))
    return out.withColumn("p_value", p_of_r(F.col("r"), F.col("n")))


def p_of_r(r: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def tail(r, n):
        return r.__class__([None if x is None or x != x or m < 3 else t_two_sided(x * math.sqrt((m - 2) / max(1e-300, 1 - x * x)) if abs(x) < 1 else math.inf, m - 2) for x, m in zip(r, n, strict=True)])

    return tail(r, n.cast("double"))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return 0.0 if math.isinf(t) else incomplete_beta(df / (df + t * t), df / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Gauss-Legendre quadrature after the substitution u = sin(theta)^2."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    node, weight = np.polynomial.legendre.leggauss(200)
    top = math.asin(math.sqrt(x))
    theta = (node + 1) * top / 2
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    value = 2 * np.exp(log + (2 * a - 1) * np.log(np.sin(theta)) + (2 * b - 1) * np.log(np.cos(theta)))
    return float(min(1.0, (value * weight).sum() * top / 2))


def adjust_pvalues(df: DataFrame, p: str, method: str, name: str = "p_adjusted", by: Sequence[str] = ()) -> DataFrame:
    """bonferroni, holm or fdr_bh within groups; NULL p stays NULL and does not count."""
    rows = df if by else df.withColumn("g_", F.lit(0))
    keys = list(by) or ["g_"]
    part = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(part)
    rank = F.row_number().over(order)
    if method == "bonferroni":
        rows = rows.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * m)))
    elif method == "holm":
        rows = rows.withColumn("s_", F.col(p) * (m - rank + 1))
        run = F.max("s_").over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), run))).drop("s_")
    elif method == "fdr_bh":
        rows = rows.withColumn("s_", F.col(p) * m / rank)
        run = F.min("s_").over(order.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), run))).drop("s_")
    else:
        raise ValueError(f"unknown method: {method}")
    return rows.drop("g_")


def ks_statistic(long: DataFrame, by: Sequence[str], value: str, is_first: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per group: the largest gap of cumulative shares over distinct values."""
    rows = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(is_first).cast("long")).alias("a_"), F.sum((~F.col(is_first)).cast("long")).alias("b_"))
    part = Window.partitionBy(*by)
    run = part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("a_").over(run) / F.nullif(F.sum("a_").over(part), F.lit(0)) - F.sum("b_").over(run) / F.nullif(F.sum("b_").over(part), F.lit(0)))
    return rows.withColumn("gap_", gap).groupBy(*by).agg(F.max("gap_").alias("ks"))


def shift_screen(df: DataFrame, features: Sequence[str], is_first: str) -> DataFrame:
    """For each feature: means, missing shares, standardised mean difference (infinite without variance) and KS of two groups."""
    long = long_form(df, [is_first], features)
    a, b = F.when(F.col(is_first), F.col("x")), F.when(~F.col(is_first), F.col("x"))
    na, nb = F.sum(F.col(is_first).cast("long")), F.sum((~F.col(is_first)).cast("long"))
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    gap = F.avg(a) - F.avg(b)
    smd = F.when(pooled > 0, gap / pooled).when(gap == 0, F.lit(0.0)).when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    out = long.groupBy("feature").agg(
        F.count(a).alias("n_first"), F.count(b).alias("n_second"), F.avg(a).alias("mean_first"), F.avg(b).alias("mean_second"),
        (1 - F.count(a) / F.nullif(na, F.lit(0))).alias("missing_first"), (1 - F.count(b) / F.nullif(nb, F.lit(0))).alias("missing_second"), smd.alias("smd"),
    )
    return out.join(ks_statistic(long, ["feature"], "x", is_first), "feature", "left")


def train_prediction_diagnostics(df: DataFrame, features: Sequence[str], is_train: str) -> DataFrame:
    """shift_screen plus the training range and 1 % and 99 % quantiles, the share of the other group outside, and flags."""
    long = long_form(df, [is_train], features)
    train = F.when(F.col(is_train), F.col("x"))
    bounds = long.groupBy("feature").agg(F.min(train).alias("low"), F.max(train).alias("high"), F.percentile(train, F.lit(0.01)).alias("q01"), F.percentile(train, F.lit(0.99)).alias("q99"))
    outside = long.where(~F.col(is_train)).join(F.broadcast(bounds), "feature").groupBy("feature").agg(F.avg(((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).cast("double")).alias("out_of_range"))
    out = shift_screen(df, features, is_train).join(bounds, "feature", "left").join(outside, "feature", "left")
    flags = {"flag_smd": F.abs("smd") > 0.25, "flag_ks": F.col("ks") > 0.2, "flag_missing": F.abs(F.col("missing_first") - F.col("missing_second")) > 0.1, "flag_range": F.col("out_of_range") > 0.05, "flag_constant": F.col("low") == F.col("high")}
    return out.select("*", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing, pct) from one pass, largest share first."""
    n = F.count("*").alias("n_")
    one = df.agg(n, *(F.count(c).alias(c) for c in columns))
    cells = one.select("n_", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("k")) for c in columns))).alias("e"))
    out = cells.select("e.column", (F.col("n_") - F.col("e.k")).alias("missing"), F.when(F.col("n_") > 0, F.lit(100.0) * (F.col("n_") - F.col("e.k")) / F.col("n_")).alias("pct"))
    return out.orderBy(F.desc("pct"), "column")


def outlier_summary(df: DataFrame, columns: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartile fences of each column and how many values lie outside; exact quantiles."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), num(c).alias("x")) for c in columns))).alias("e")).select("e.*").where("x is not null")
    q = long.groupBy("column").agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    q = q.withColumn("lower", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).withColumn("upper", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    out = long.join(F.broadcast(q), "column").groupBy("column").agg(F.sum(((F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))).cast("long")).alias("outliers"))
    return q.join(out, "column").withColumn("pct", F.lit(100.0) * F.col("outliers") / F.col("n"))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median absolute deviation, population skewness and excess kurtosis (NULL under 3 rows or without spread)."""
    middle = df.groupBy(*by).agg(F.median(value).alias("m_"))
    rows = df.join(middle, list(by))
    spread = (F.count(value) > 2) & (F.stddev_pop(value) > EPSILON)
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(F.abs(F.col(value) - F.col("m_"))).alias("mad"),
        F.when(spread, F.skewness(value)).alias("skewness"), F.when(spread, F.kurtosis(value)).alias("kurtosis"),
    )


def effective_size(w: str) -> Column:
    """(sum w)^2 / sum w^2."""
    return F.when(F.sum(F.col(w) * F.col(w)) > 0, F.sum(w) * F.sum(w) / F.sum(F.col(w) * F.col(w)))


def standardized_difference(value: str, group: str, a, b) -> Column:
    """Difference of means over the pooled deviation, weighted by degrees of freedom."""
    x, y = F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))
    na, nb = F.count(x), F.count(y)
    pooled = F.sqrt(((na - 1) * F.var_samp(x) + (nb - 1) * F.var_samp(y)) / F.nullif(na + nb - 2, F.lit(0)))
    return F.when((na >= 2) & (nb >= 2) & (pooled > 0), (F.avg(x) - F.avg(y)) / pooled)


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the variance between groups."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.sum(F.col(value)).alias("s"), (F.var_pop(value) * F.count("*")).alias("within"))
    total = g.agg(F.sum("within").alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("b"))
    return total.select(F.when(F.col("w") + F.col("b") > 0, F.col("b") / (F.col("w") + F.col("b"))).alias("eta_squared"))


def binary_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC by average ranks, average precision over distinct scores, and Brier score."""
    rows = df if by else df.withColumn("g_", F.lit(0))
    keys = list(by) or ["g_"]
    rows = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    steps = rows.groupBy(*keys, score).agg(F.sum(label).alias("p_"), F.count("*").alias("n_"), F.sum(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("b_"))
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("tp_", F.sum("p_").over(down)).withColumn("all_", F.sum("n_").over(down)).withColumn("neg_", F.coalesce(F.sum(F.col("n_") - F.col("p_")).over(below), F.lit(0)))
    pos, neg = F.sum("p_"), F.sum(F.col("n_") - F.col("p_"))
    out = steps.groupBy(*keys).agg(
        F.when((pos > 0) & (neg > 0), F.sum(F.col("p_") * (F.col("neg_") + (F.col("n_") - F.col("p_")) / 2)) / (pos * neg)).alias("auc"),
        F.when(pos > 0, F.sum(F.col("p_") * F.col("tp_") / F.col("all_")) / pos).alias("average_precision"),
        (F.sum("b_") / F.sum("n_")).alias("brier"),
    )
    return out.drop("g_")


def running_total(df: DataFrame, order: str, value: str, name: str, descending: bool = False, buckets: int = 64) -> DataFrame:
    """Sum of `value` over all rows up to and with the row's place in a global order, equal places sharing it.

    No task sees the whole table: approximate quantiles cut the order into buckets, each bucket is summed within itself and
    shifted by the totals of the buckets before it, of which there are few.
    """
    fractions = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, F.array(*map(F.lit, fractions)), F.lit(10_000)).alias("b")).first()["b"] or []
    edges = F.array(*(F.lit(b) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    rows = df.withColumn("bucket_", F.size(F.filter(edges, lambda b: b <= F.col(order))))
    sums = rows.groupBy("bucket_").agg(F.sum(value).alias("part_"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket_") if descending else "bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket_", F.coalesce(F.sum("part_").over(before), F.lit(0)).alias("shift_"))
    within = Window.partitionBy("bucket_").orderBy(F.desc(order) if descending else order)
    out = rows.withColumn(name, F.sum(value).over(within)).join(F.broadcast(sums), "bucket_")
    return out.withColumn(name, F.col(name) + F.col("shift_")).drop("bucket_", "shift_")


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) of complete rows: one aggregate of k(k+1)/2 sums, a k x k matrix on the driver."""
    rows = df.select(*(num(c).alias(c) for c in columns)).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    n, k = row["n"], len(columns)
    c = np.zeros((k, k))
    for i, j in pairs:
        c[i, j] = c[j, i] = (row[f"c{i}_{j}"] or 0.0) * n
    return n, np.array([row[f"m{i}"] or 0.0 for i in range(k)]), c


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation 1 / (1 - R^2) of each column on the others; infinite where the fit is perfect."""
    _, _, c = gram(df, columns)
    d = np.sqrt(np.diag(c))
    r = c / np.outer(d, d)
    values = np.diag(np.linalg.inv(r)) if np.linalg.cond(r) < 1e12 else np.full(len(columns), math.inf)
    return df.sparkSession.createDataFrame([(c_, float(v)) for c_, v in zip(columns, values, strict=True)], "feature string, vif double")


def linear_regression(df: DataFrame, target: str, columns: Sequence[str]) -> dict:
    """Ordinary least squares from the cross products: coefficients, rmse, r2 and the Breusch-Pagan statistic."""
    n, m, c = gram(df, [*columns, target])
    k = len(columns)
    beta = np.linalg.lstsq(c[:k, :k], c[:k, k], rcond=None)[0]
    intercept = float(m[k] - beta @ m[:k])
    rows = df.select(*(num(x).alias(x) for x in [*columns, target])).dropna()
    fit = F.lit(intercept)
    for x, b in zip(columns, beta, strict=True):
        fit = fit + F.col(x) * F.lit(float(b))
    rows = rows.withColumn("e_", F.col(target) - fit).withColumn("e2_", F.col("e_") * F.col("e_"))
    row = rows.agg(F.avg("e2_").alias("mse"), F.avg(F.abs("e_")).alias("mae")).first()
    _, _, c2 = gram(rows, [*columns, "e2_"])
    gamma = np.linalg.lstsq(c2[:k, :k], c2[:k, k], rcond=None)[0]
    r2_aux = float(gamma @ c2[:k, k] / c2[k, k]) if c2[k, k] > 0 else 0.0
    return {"intercept": intercept, "coefficients": dict(zip(columns, map(float, beta), strict=True)), "rmse": math.sqrt(row["mse"]), "mae": row["mae"], "r2": float(beta @ c[:k, k] / c[k, k]), "breusch_pagan": n * r2_aux}


def bootstrap_mean(df: DataFrame, value: str, cluster: str, replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Mean with a cluster-bootstrap interval: each cluster is drawn a Poisson(1) number of times in each replicate, by hash.

    Clusters are aggregated first; only they are repeated by the number of replicates.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s_"), F.count("*").alias("n_"))
    drawn = sums.select("s_", "n_", cluster, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = (F.pmod(stable_hash(seed, cluster, "replicate"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    steps, p, c = [], math.exp(-1), 0.0
    for k in range(12):
        c += p
        steps.append(c)
        p /= k + 1
    times = F.lit(0)
    for s in steps:
        times = times + (u > s).cast("int")
    means = drawn.withColumn("t_", times).groupBy("replicate").agg((F.sum(F.col("s_") * F.col("t_")) / F.nullif(F.sum(F.col("n_") * F.col("t_")), F.lit(0))).alias("m_"))
    band = means.agg(F.percentile("m_", F.lit((1 - level) / 2)).alias("low"), F.percentile("m_", F.lit((1 + level) / 2)).alias("high"))
    return sums.agg((F.sum("s_") / F.sum("n_")).alias("mean"), F.count("*").alias("clusters")).crossJoin(band)
