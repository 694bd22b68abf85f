"""Irregular observations on regular grids: coverage, nearest-in-time alignment, antecedent windows, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.panel import levels


def grid(spark, start: str, end: str, step_days: int = 14) -> DataFrame:
    """Dates from start, every step, none after the end."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"interval {step_days} days"))).alias("grid_date"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys meet."""
    named = right.withColumnsRenamed({k: f"{k}_r_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_r_")) for k in keys]
    return left.join(named, on, "left").drop(*(f"{k}_r_" for k in keys))


def coverage_gaps(df: DataFrame, keys: Sequence[str], date: str, cloud: str, months: bool = True) -> DataFrame:
    """Records, distinct dates, first, last, span, median and largest gap, cloud mean and median, records by month.

    Null keys keep their group. One shuffle by the keys serves the distinct dates, the window and both aggregates.
    """
    rows = df.select(*keys, F.to_date(date).alias("d_"), F.col(cloud).alias("c_")).where("d_ is not null")
    dated = rows.groupBy(*keys, "d_").agg(F.count("*").alias("n_"), F.count("c_").alias("nc_"), F.sum("c_").alias("sc_"))
    w = Window.partitionBy(*keys).orderBy("d_")
    gaps = dated.withColumn("gap_", F.date_diff("d_", F.lag("d_").over(w)))
    out = gaps.groupBy(*keys).agg(
        F.sum("n_").alias("n_records"),
        F.count("*").alias("n_unique_dates"),
        F.min("d_").alias("first_date"),
        F.max("d_").alias("last_date"),
        F.date_diff(F.max("d_"), F.min("d_")).alias("span_days"),
        F.median("gap_").alias("median_gap_days"),
        F.max("gap_").alias("max_gap_days"),
        F.when(F.sum("nc_") > 0, F.sum("sc_") / F.sum("nc_")).alias("cloud_mean"),
    )
    middle = rows.groupBy(*keys).agg(F.median("c_").alias("cloud_median"))
    out = join_null_safe(out, middle, keys)
    if months:
        tagged = rows.withColumn("m_", F.date_format("d_", "yyyy_MM"))
        wide = tagged.groupBy(*keys).pivot("m_", levels(tagged, "m_")).agg(F.count(F.lit(1)))
        names = [c for c in wide.columns if c not in keys]
        wide = wide.select(*keys, *(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in names))
        out = join_null_safe(out, wide, keys)
    return out


def align_nearest(
    df: DataFrame, key: str, sensor: str, date: str, variables: Sequence[str], dates: DataFrame, k: int = 3, bandwidth_days: float = 14.0, max_distance_days: int = 30, cloud: str | None = None
) -> DataFrame:
    """Each variable at each grid date from its k nearest observations in time.

    Rows of a day are averaged first. An observation within max_distance_days weighs exp(-d / bandwidth), times one minus its cloud
    share (none: 1). The value is NULL without weight. neighbor_count is the smaller of k and the observations in reach,
    whatever they hold; nearest_gap_days is the distance of the nearest. Every (key, sensor, date) has a row. Ties go to the
    earlier date. The reach is a bucket join: grid dates and observations meet in buckets as long as the reach, so no
    pair farther than two buckets is formed.
    """
    parts = [F.avg(v).alias(v) for v in variables] + ([F.avg(cloud).alias("cloud_")] if cloud else [])
    daily = df.where(F.col(date).isNotNull()).groupBy(key, sensor, F.to_date(date).alias("day_")).agg(*parts)
    reach = max(1, max_distance_days)
    bucket = F.floor(F.unix_date("day_") / reach)
    share = (1 - F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("cloud_", F.lit(0.0)))) / 100) if cloud else F.lit(1.0)
    right = daily.select(key, sensor, "day_", *variables, share.alias("clear_"), F.explode(F.array(*(bucket + i for i in (-1, 0, 1)))).alias("bucket_"))
    left = daily.select(key, sensor).distinct().crossJoin(F.broadcast(dates)).withColumn("bucket_", F.floor(F.unix_date("grid_date") / reach))
    near = left.join(right, [key, sensor, "bucket_"]).withColumn("gap_", F.abs(F.date_diff("grid_date", "day_"))).where(F.col("gap_") <= max_distance_days)
    where = [key, sensor, "grid_date"]
    counts = near.groupBy(*where).agg(F.least(F.count("*"), F.lit(k)).alias("neighbor_count"), F.min("gap_").alias("nearest_gap_days"))
    long = near.withColumn("w_", F.exp(-F.col("gap_") / bandwidth_days) * F.col("clear_")).unpivot([*where, "gap_", "day_", "w_"], list(variables), "variable", "v_").where("v_ is not null")
    ranked = long.withColumn("r_", F.row_number().over(Window.partitionBy(*where, "variable").orderBy("gap_", "day_"))).where(F.col("r_") <= k)
    weight = F.sum("w_")
    values = ranked.groupBy(*where).pivot("variable", list(variables)).agg(F.when(weight > 0, F.sum(F.col("v_") * F.col("w_")) / weight))
    out = left.drop("bucket_").join(counts, where, "left").join(values, where, "left")
    return out.withColumn("neighbor_count", F.coalesce("neighbor_count", F.lit(0)))


def antecedent_mean(targets: DataFrame, observations: DataFrame, key: str, date: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """Mean of daily observations in [t - h, t) for each target date: both streams in one range window, no inequality join."""
    daily = observations.where(F.col(date).isNotNull()).groupBy(key, F.to_date(date).alias("day_")).agg(F.avg(value).alias("v_"))
    marks = targets.select(key, F.to_date(date).alias("day_")).distinct()
    both = daily.select(key, "day_", "v_", F.lit(False).alias("mark_")).unionByName(marks.select(key, "day_", F.lit(None).cast("double").alias("v_"), F.lit(True).alias("mark_")))
    both = both.withColumn("n_", F.unix_date("day_"))
    w = Window.partitionBy(key).orderBy("n_")
    out = both.select(key, "day_", "mark_", *(F.avg("v_").over(w.rangeBetween(-h, -1)).alias(f"mean_{h}d") for h in horizons))
    return out.where("mark_").drop("mark_").withColumnRenamed("day_", "date")


def rolling_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int, name: str) -> DataFrame:
    """Sum of the last k rows, fewer at the start."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - k, 0)))


def longest_run(df: DataFrame, keys: Sequence[str], order: str, condition) -> DataFrame:
    """Longest run of rows that meet the condition; NULL does not and breaks a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, F.coalesce(condition, F.lit(False)).alias("ok_")).withColumn("i_", F.row_number().over(w))
    rows = rows.withColumn("island_", F.col("i_") - F.row_number().over(Window.partitionBy(*keys, "ok_").orderBy(order)))
    runs = rows.groupBy(*keys, "ok_", "island_").agg(F.count("*").alias("n_"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("ok_"), F.col("n_"))), F.lit(0)).alias("longest_run"))


def daily_extremes(df: DataFrame, key: str, date: str, value: str, wet: float = 1.0, heavy: float = 20.0, k: int = 5) -> DataFrame:
    """Sum, mean, largest day and k-day sum, wet, heavy and dry days and the longest dry spell of a daily series."""
    w = Window.partitionBy(key).orderBy(date)
    rows = rolling_sum(df, [key], date, value, k, "roll_")
    rows = rows.withColumn("dry_", F.coalesce(F.col(value) < wet, F.lit(False))).withColumn("i_", F.row_number().over(w))
    rows = rows.withColumn("island_", F.col("i_") - F.row_number().over(Window.partitionBy(key, "dry_").orderBy(date)))
    spells = rows.groupBy(key, "dry_", "island_").agg(
        F.count("*").alias("n_"), F.sum(value).alias("s_"), F.count(value).alias("c_"), F.max(value).alias("m_"), F.max("roll_").alias("r_"),
        F.sum((F.col(value) >= wet).cast("long")).alias("wet_"), F.sum((F.col(value) >= heavy).cast("long")).alias("heavy_"),
    )
    return spells.groupBy(key).agg(
        F.sum("s_").alias("total"),
        F.when(F.sum("c_") > 0, F.sum("s_") / F.sum("c_")).alias("mean"),
        F.max("m_").alias("max_1d"),
        F.max("r_").alias(f"max_{k}d"),
        F.coalesce(F.sum("wet_"), F.lit(0)).alias("wet_days"),
        F.coalesce(F.sum("heavy_"), F.lit(0)).alias("heavy_days"),
        F.coalesce(F.sum(F.when(F.col("dry_"), F.col("n_"))), F.lit(0)).alias("dry_days"),
        F.coalesce(F.max(F.when(F.col("dry_"), F.col("n_"))), F.lit(0)).alias("longest_dry_spell"),
    )


def calendar_gaps(df: DataFrame, date: str, start: str, end: str, step: str = "1 day") -> DataFrame:
    """Expected dates that no row has."""
    expected = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"interval {step}"))).alias("missing_date"))
    return expected.join(df.select(F.to_date(date).alias("missing_date")).distinct(), "missing_date", "left_anti")


def irregular(df: DataFrame, keys: Sequence[str], date: str, value: str, weight: str | None = None, max_gap_days: float = 35.0) -> DataFrame:
    """Descriptors of an irregular series: rows of a day merge by weighted mean, long gaps are not bridged.

    All from one shuffle by the keys: the daily rows are gathered as an ordered array of at most one entry a calendar day,
    and every descriptor is an expression over that array.
    """
    from panelforge.operators.trajectories import added, correlation, low_position, mean, median_of, pairs, quadratic_of, slope_of, std_of, top_position, ys

    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.select(*keys, F.unix_date(F.to_date(date)).alias("d_"), F.col(value).cast("double").alias("v_"), w.alias("w_")).where("d_ is not null and v_ is not null and w_ > 0")
    daily = rows.groupBy(*keys, "d_").agg(F.count("*").alias("n_"), F.sum("w_").alias("w_"), (F.sum(F.col("v_") * F.col("w_")) / F.sum("w_")).alias("v_"))
    series = daily.groupBy(*keys).agg(F.sum("n_").alias("n_observations"), F.sort_array(F.collect_list(F.struct("d_", "v_", "w_"))).alias("s_"), F.percentile("v_", F.array(*map(F.lit, (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)))).alias("q_"))
    first = F.col("s_")[0]["d_"]
    series = series.withColumn("p_", F.transform("s_", lambda e: F.struct((e["d_"] - first).cast("double").alias("x"), e["v_"].alias("y"), e["w_"].alias("w"))))
    p = F.col("p_")
    series = series.withColumn("y_", ys(p)).withColumn("step_", pairs(p, lambda a, b: F.struct((b["x"] - a["x"]).alias("gap"), (b["y"] - a["y"]).alias("dy"), ((b["y"] - a["y"]) / F.greatest(b["x"] - a["x"], F.lit(1.0))).alias("rate"), ((a["y"] + b["y"]) / 2).alias("mid"))))
    y, step, q, n = F.col("y_"), F.col("step_"), F.col("q_"), F.size("y_")
    series = series.withColumn("m_", mean(y)).withColumn("sd_", std_of(y)).withColumn("rate_", F.transform("step_", lambda s: s["rate"]))
    m, sd, rate = F.col("m_"), F.col("sd_"), F.col("rate_")
    good = F.filter(step, lambda s: s["gap"] <= max_gap_days)
    half, rhalf = F.floor(n / 2).cast("int"), F.floor(F.size(rate) / 2).cast("int")
    signs = F.transform(rate, lambda r: F.signum(r))
    neighbours = pairs(y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    features = {
        "n_days": n.cast("long"), "span_days": p[n - 1]["x"], "mean": m, "weighted_mean": added(p, lambda e: e["y"] * e["w"]) / added(p, lambda e: e["w"]), "std": sd,
        "median": q[3], "min": F.array_min(y), "max": F.array_max(y), "range": F.array_max(y) - F.array_min(y),
        "q05": q[0], "q10": q[1], "q25": q[2], "q75": q[4], "q90": q[5], "q95": q[6], "iqr": q[4] - q[2],
        "mad": median_of(F.transform(y, lambda v: F.abs(v - q[3]))), "median_gap_days": median_of(F.transform(step, lambda s: s["gap"])), "quadratic_curvature": quadratic_of(p),
        "rms": F.sqrt(mean(y, lambda v: v * v)), "cv": sd / (F.abs(m) + F.lit(1e-6)), "initial": y[0], "final": y[n - 1], "final_minus_initial": y[n - 1] - y[0],
        "day_of_peak": top_position(p), "day_of_minimum": low_position(p),
        "fraction_above_median": mean(y, lambda v: (v > q[3]).cast("double")), "fraction_below_q25": mean(y, lambda v: (v < q[2]).cast("double")),
        "skewness": F.when((n > 2) & (sd > 1e-12), mean(y, lambda v: F.pow((v - m) / sd, F.lit(3)))),
        "excess_kurtosis": F.when((n > 2) & (sd > 1e-12), mean(y, lambda v: F.pow((v - m) / sd, F.lit(4))) - 3),
        "maximum_gap_days": F.array_max(F.transform(step, lambda s: s["gap"])), "slope_day": slope_of(p),
        "mean_absolute_velocity": mean(rate, lambda r: F.abs(r)), "maximum_growth_velocity": F.array_max(rate), "maximum_decline_velocity": F.array_min(rate), "velocity_variability": std_of(rate),
        "total_variation": F.when(n >= 2, added(step, lambda s: F.abs(s["dy"]))), "positive_variation": F.when(n >= 2, added(step, lambda s: F.greatest(s["dy"], F.lit(0.0)))), "negative_variation": F.when(n >= 2, added(step, lambda s: F.greatest(-s["dy"], F.lit(0.0)))),
        "direction_changes": F.when(n >= 2, added(pairs(signs, lambda a, b: (a != b).cast("double")))), "lag1_observation_autocorrelation": F.when(n >= 4, correlation(neighbours)),
        "observed_auc": F.when(n >= 2, added(good, lambda s: s["mid"] * s["gap"])), "covered_days": F.when(n >= 2, added(good, lambda s: s["gap"])), "n_contiguous_intervals": F.when(n >= 2, F.size(good).cast("double")),
        "late_minus_early": F.when(n >= 4, mean(F.slice(y, half + 1, n)) - mean(F.slice(y, F.lit(1), half))), "acceleration_proxy": F.when(n >= 4, mean(F.slice(rate, rhalf + 1, n)) - mean(F.slice(rate, F.lit(1), rhalf))),
    }
    return series.select(*keys, "n_observations", *(c.alias(k) for k, c in features.items()))
