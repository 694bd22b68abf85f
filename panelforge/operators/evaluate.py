"""Metrics, method selection and summaries over long prediction tables (split, method, id, observed, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import tails


def error_metrics(observed: str = "observed", predicted: str = "predicted") -> dict[str, Column]:
    """rmse, mae and r2 (NULL for constant observations)."""
    o, e = F.col(observed), F.col(predicted) - F.col(observed)
    ok = F.col(predicted).isNotNull()
    ss = F.var_pop(F.when(ok, o)) * F.count(F.when(ok, o))
    return {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "r2": F.when(ss > 0, 1 - F.sum(e * e) / ss)}


def metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in error_metrics().items()))


def method_summary(df: DataFrame, split: str = "split_id", method: str = "method") -> DataFrame:
    """By method: mean, deviation, best and worst of the splits' errors, and the pooled error."""
    per = df.groupBy(method, split).agg(F.count("*").alias("n_"), F.sum(F.pow(F.col("predicted") - F.col("observed"), F.lit(2))).alias("sse_")).withColumn("rmse_", F.sqrt(F.col("sse_") / F.col("n_")))
    return per.groupBy(method).agg(
        F.count("*").alias("splits"), F.avg("rmse_").alias("rmse_mean"), F.stddev_samp("rmse_").alias("rmse_std"), F.min("rmse_").alias("rmse_best"), F.max("rmse_").alias("rmse_worst"),
        F.sqrt(F.sum("sse_") / F.sum("n_")).alias("rmse_pooled"),
    )


def loso_selection(df: DataFrame, split: str = "split_id", method: str = "method", by: Sequence[str] = ()) -> DataFrame:
    """For each held-out split (within `by`) the method with the least mean error over the other splits; ties by name.

    The mean without a split is the sum less its own part: no split is joined with the others.
    """
    per = df.groupBy(*by, split, method).agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("observed"), F.lit(2)))).alias("rmse"))
    w = Window.partitionBy(*by, method)
    n = F.count("*").over(w) - 1
    per = per.withColumn("others", F.when(n > 0, (F.sum("rmse").over(w) - F.col("rmse")) / n))
    best = Window.partitionBy(*by, split).orderBy(F.col("others").asc_nulls_last(), method)
    return per.withColumn("r_", F.row_number().over(best)).where("r_ = 1").select(*by, split, method, F.col("others").alias("selection_rmse"), F.col("rmse").alias("held_out_rmse"))


def loso_routing(df: DataFrame, tier: str, split: str = "split_id", method: str = "method") -> DataFrame:
    """Predictions routed by tier: for each held-out split and tier the method chosen on the other splits."""
    chosen = loso_selection(df, split, method, [tier]).select(tier, split, method)
    return df.join(chosen, [tier, split, method])


def fold_tails(df: DataFrame, split: str, is_train: str, value: str, low: float = 0.15, high: float = 0.85, strict: bool = False) -> DataFrame:
    """Tail labels with thresholds from each split's training rows only, rounded to 9 places: a threshold that is a value must equal it."""
    bounds = df.where(F.col(is_train)).groupBy(split).agg(F.round(F.percentile(value, F.lit(low)), 9).alias("tail_low"), F.round(F.percentile(value, F.lit(high)), 9).alias("tail_high"))
    return df.join(F.broadcast(bounds), split).withColumn("tail", tails(value, "tail_low", "tail_high", strict))


def tail_bias(df: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.col("predicted") - F.col("observed")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((e > 0).cast("double")).alias("over_fraction"))


def tail_metrics(df: DataFrame, by: Sequence[str], tail: str = "tail") -> DataFrame:
    """Error in each regime and over all, one row a group."""
    e = F.pow(F.col("predicted") - F.col("observed"), F.lit(2))
    return df.groupBy(*by).agg(F.sqrt(F.avg(e)).alias("rmse"), *(F.sqrt(F.avg(F.when(F.col(tail) == t, e))).alias(f"rmse_{t}") for t in ("low", "center", "high")))


def sse_concentration(df: DataFrame, by: Sequence[str], key: str, top: Sequence[int] = (1, 5, 10), fractions: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Share of the squared error that the k worst entities hold, and the worst fractions (rounded up)."""
    per = df.groupBy(*by, key).agg(F.sum(F.pow(F.col("predicted") - F.col("observed"), F.lit(2))).alias("sse_"))
    w = Window.partitionBy(*by)
    per = per.withColumn("r_", F.row_number().over(w.orderBy(F.desc("sse_"), key))).withColumn("n_", F.count("*").over(w))
    whole = F.sum("sse_")
    part = lambda cond: F.when(whole > 0, F.sum(F.when(cond, F.col("sse_")).otherwise(F.lit(0.0))) / whole)
    return per.groupBy(*by).agg(F.count("*").alias("entities"), *(part(F.col("r_") <= k).alias(f"top_{k}_share") for k in top), *(part(F.col("r_") <= F.ceil(F.col("n_") * f)).alias(f"top_{int(100 * f)}pct_share") for f in fractions))


def residual_rollup(df: DataFrame, by: Sequence[str], split: str = "split_id") -> DataFrame:
    e = F.col("predicted") - F.col("observed")
    return df.groupBy(*by).agg(
        F.count_distinct(split).alias("splits"), F.avg(e).alias("mean_residual"), F.median(e).alias("median_residual"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("std_residual"),
        F.max(F.abs(e)).alias("max_abs_residual"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def residual_long(df: DataFrame, keys: Sequence[str], observed: str, methods: Sequence[str]) -> DataFrame:
    """Wide predictions to residuals by method, with the methods' mean as one more and their disagreement."""
    from panelforge.functions.expressions import total

    average = total(list(methods)) / len(methods)
    spread = F.greatest(*methods) - F.least(*methods) if len(methods) > 1 else F.lit(0.0)
    wide = df.select(*keys, observed, *methods, average.alias("mean_of_methods"), spread.alias("disagreement"))
    long = wide.unpivot([*keys, observed, "disagreement"], [*methods, "mean_of_methods"], "method", "predicted")
    return long.withColumn("residual", F.col("predicted") - F.col(observed))


def residual_correlation(df: DataFrame, keys: Sequence[str], method: str = "method") -> DataFrame:
    """Correlation of residuals of each two methods over shared rows."""
    from panelforge.operators.stats import correlation

    e = df.select(*keys, method, (F.col("predicted") - F.col("observed")).alias("e"))
    other = e.select(*keys, F.col(method).alias("other"), F.col("e").alias("f"))
    return e.join(other, list(keys)).where(F.col(method) < F.col("other")).groupBy(method, "other").agg(F.count("*").alias("n"), correlation("e", "f").alias("r"))


def top_overlap(df: DataFrame, by: str, key: str, score: str, k: int) -> DataFrame:
    """Jaccard overlap of the k keys with the largest score between each two groups."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), key)
    sets = df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).groupBy(by).agg(F.collect_set(key).alias("s_"))
    a, b = sets.select(F.col(by).alias("a"), F.col("s_").alias("sa_")), sets.select(F.col(by).alias("b"), F.col("s_").alias("sb_"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.size(F.array_intersect("sa_", "sb_")) / F.size(F.array_union("sa_", "sb_"))).alias("jaccard"))


def robustness(df: DataFrame, method: str, protocol: str, score: str, protocols: Sequence[str]) -> DataFrame:
    """Protocols as columns, their mean, worst and gap."""
    from panelforge.functions.expressions import total

    wide = df.groupBy(method).pivot(protocol, list(protocols)).agg(F.avg(score))
    cols = [F.col(f"`{p}`") for p in protocols]
    worst, best = F.greatest(*cols), F.least(*cols)
    return wide.select(method, *(c.alias(f"score_{p}") for c, p in zip(cols, protocols, strict=True)), (total(cols) / len(cols)).alias("mean"), worst.alias("worst"), (worst - best).alias("gap"))


def blends(df: DataFrame, a: str, b: str, weights: Sequence[float]) -> DataFrame:
    """Convex blends of two predictions, a row a weight."""
    w = F.explode(F.array(*map(F.lit, weights))).alias("weight")
    return df.select("*", w).withColumn("predicted", F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b))


def ensemble(df: DataFrame, keys: Sequence[str], methods: Sequence[str], name: str) -> DataFrame:
    """Equal-weight mean of methods where all of them predict."""
    part = df.where(F.col("method").isin(list(methods))).groupBy(*keys).agg(F.first("observed").alias("observed"), F.avg("predicted").alias("predicted"), F.count("predicted").alias("n_"))
    return part.where(F.col("n_") == len(methods)).drop("n_").withColumn("method", F.lit(name))


def stretch(df: DataFrame, by: Sequence[str], is_train: str, factor: float) -> DataFrame:
    """center + factor (predicted - center), the center being the mean of the group's training targets."""
    center = df.where(F.col(is_train)).groupBy(*by).agg(F.avg("observed").alias("center_"))
    return df.where(~F.col(is_train)).join(F.broadcast(center), list(by)).withColumn("predicted", F.col("center_") + factor * (F.col("predicted") - F.col("center_"))).drop("center_")


def tail_offsets(df: DataFrame, by: Sequence[str], tail: str, shrink: float, least: int = 5) -> DataFrame:
    """Shrunken mean residual of the low and high regime, NULL under `least` rows."""
    e = F.col("observed") - F.col("predicted")
    one = lambda t: F.when(F.count(F.when(F.col(tail) == t, e)) >= least, shrink * F.avg(F.when(F.col(tail) == t, e))).alias(f"offset_{t}")
    return df.groupBy(*by).agg(one("low"), one("high"))


def abstain(delta: str, low_score: str, high_score: str, cutoff: float) -> Column:
    """prediction + delta only where both tail scores stay below the cutoff."""
    return F.col("predicted") + F.when((F.col(low_score) < cutoff) & (F.col(high_score) < cutoff), F.col(delta)).otherwise(F.lit(0.0))


def control_parity(new: DataFrame, stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest difference from a stored table and the rows that only one side has."""
    a, b = new.select(*keys, F.col(value).alias("x_"), F.lit(1).alias("in_a")), stored.select(*keys, F.col(value).alias("y_"), F.lit(1).alias("in_b"))
    return a.join(b, list(keys), "full").agg(F.max(F.abs(F.col("x_") - F.col("y_"))).alias("max_abs_diff"), F.sum(F.when(F.col("in_b").isNull() | F.col("in_a").isNull(), 1).otherwise(0)).alias("unmatched"))


def fold_coverage(df: DataFrame, folds: DataFrame, keys: Sequence[str], method: str = "method") -> DataFrame:
    """(method, keys without a prediction, keys predicted more than once)."""
    methods = df.select(method).distinct()
    expected = folds.select(*keys).distinct().crossJoin(F.broadcast(methods))
    seen = df.groupBy(*keys, method).agg(F.count("*").alias("n_"))
    return expected.join(seen, [*keys, method], "left").groupBy(method).agg(F.sum(F.col("n_").isNull().cast("long")).alias("missing"), F.sum(F.coalesce((F.col("n_") > 1).cast("long"), F.lit(0))).alias("repeated"))


def best_configuration(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group by a full order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def recurrence(df: DataFrame, by: Sequence[str], fold: str, rank: str, folds: int) -> DataFrame:
    """In how many folds an item was selected, at what rate and mean rank."""
    return df.groupBy(*by).agg(F.count_distinct(fold).alias("selected_folds"), (F.count_distinct(fold) / folds).alias("selection_rate"), F.avg(rank).alias("mean_rank"))
