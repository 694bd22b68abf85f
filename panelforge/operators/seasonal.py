"""Season features from monthly columns: heat, rain timing, water productivity, soil, timelines and dekads. Projections only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import EPSILON, col, ratio, total
from panelforge.operators.trajectories import mean, std_of

#: Days of the months April to October.
DAYS = {4: 30, 5: 31, 6: 30, 7: 31, 8: 31, 9: 30, 10: 31}


def values(columns: Mapping[int, str], months: Sequence[int] | None = None) -> list[Column]:
    return [F.col(columns[m]) for m in sorted(columns) if months is None or m in months]


def there(columns: Sequence[Column]) -> Column:
    """The values that are not missing."""
    return F.filter(F.array(*columns), lambda v: v.isNotNull())


def degree_days(tmean: Mapping[int, Column], base: float) -> Column:
    """Sum of days x max(t - base, 0), complete case."""
    return total([F.greatest(t - base, F.lit(0.0)) * F.when(t.isNotNull(), F.lit(float(DAYS[m]))) for m, t in tmean.items()])


def heat_and_rain(tmin: Mapping[int, str], tmax: Mapping[int, str], rain: Mapping[int, str], bases: Sequence[float] = (0.0, 5.0, 10.0), hot: Sequence[float] = (25.0,)) -> dict[str, Column]:
    """Season means of temperature and its range, growing degree days, heat excess, rain by part of the season, its variation."""
    mid = {m: (F.col(tmin[m]) + F.col(tmax[m])) / 2 for m in sorted(tmin)}
    spread = [F.col(tmax[m]) - F.col(tmin[m]) for m in sorted(tmin)]
    parts = there(values(rain))
    season, late = total(values(rain)), total(values(rain, (8, 9, 10)))
    return {
        "tmean_season": mean(there(list(mid.values()))),
        "dtr_season": mean(there(spread)),
        "precip_season": season,
        **{f"gdd_base{b:g}": degree_days(mid, b) for b in bases},
        **{f"heat_excess_{h:g}": degree_days(mid, h) for h in hot},
        "early_sum": total(values(rain, (4, 5, 6))),
        "mid_sum": total(values(rain, (6, 7, 8))),
        "late_sum": late,
        "precip_cv": ratio(std_of(parts), F.abs(mean(parts)), 1e-9),
        "late_fraction": ratio(late, season, 1e-9),
    }


def climate_dynamics(tmin: Mapping[int, str], tmax: Mapping[int, str], rain: Mapping[int, str]) -> dict[str, Column]:
    """As above with missing months making every sum missing, and 1 added to the season's rain under the late fraction."""
    r = values(rain)
    t = [(F.col(tmin[m]) + F.col(tmax[m])) / 2 for m in sorted(tmin)]
    days = [float(DAYS[m]) for m in sorted(tmin)]
    season = total(r)
    full = total(t).isNotNull()
    wet = lambda c: F.when(season.isNotNull(), c)
    heat = lambda b: F.when(full, total([F.greatest(x - b, F.lit(0.0)) * d for x, d in zip(t, days, strict=True)]))
    return {
        "rainfall_early_sum": total(r[:3]), "rainfall_mid_sum": total(r[2:5]), "rainfall_late_sum": total(r[4:]), "rainfall_season_sum": season, "rainfall_monthly_sd": wet(std_of(F.array(*r))),
        "rainfall_wettest_month": wet(F.greatest(*r)), "rainfall_driest_month": wet(F.least(*r)), "rainfall_late_fraction": total(r[4:]) / (season + 1), "rainfall_max_2month": wet(F.greatest(*(a + b for a, b in zip(r, r[1:], strict=False)))),
        "temperature_mean_season": total(t) / len(t), "temperature_diurnal_range": total([F.col(tmax[m]) - F.col(tmin[m]) for m in sorted(tmin)]) / len(t), "temperature_max_monthly_mean": F.when(full, F.greatest(*t)),
        **{f"gdd_monthly_proxy_base{b:g}": heat(b) for b in (0, 5, 10)},
    }


def month_anomalies(current: Mapping[int, str], history: Mapping[int, Sequence[str]]) -> dict[str, Column]:
    """Current month less the mean of what there is of its history."""
    return {f"anomaly_m{m:02d}": F.col(current[m]) - mean(there([F.col(c) for c in history[m]])) for m in sorted(current)}


def water_productivity(npp: Mapping[int, str], aeti: Mapping[int, str], rain: Mapping[int, str], ndvi_mean: str, lai_mean: str, eps: float = EPSILON) -> dict[str, Column]:
    """Production per water, water per rain, balance, by month and season, and two products with vegetation."""
    out = {}
    for m in sorted(npp):
        out[f"npp_per_aeti_m{m:02d}"] = ratio(npp[m], aeti[m], eps)
        out[f"aeti_per_precip_m{m:02d}"] = ratio(aeti[m], rain[m], eps)
    n, a, p = (total(values(c)) for c in (npp, aeti, rain))
    return out | {"npp_per_aeti": ratio(n, a, eps), "aeti_per_precip": ratio(a, p, eps), "precip_minus_aeti": p - a, "npp_x_ndvi": n * F.col(ndvi_mean), "lai_x_aeti": F.col(lai_mean) * a}


def soil(top: Mapping[str, str], deep: Mapping[str, str], eps: float = EPSILON) -> dict[str, Column]:
    """Gradient and ratio of each property between layers, and interactions of the upper layer (clay, sand, silt, ph, carbon)."""
    out = {}
    for k in sorted(top):
        out[f"{k}_gradient"] = F.col(deep[k]) - F.col(top[k])
        out[f"{k}_ratio"] = ratio(deep[k], top[k], eps)
    c = {k: F.col(v) for k, v in top.items()}
    if {"clay", "sand"} <= set(c):
        out |= {"clay_over_sand": ratio(c["clay"], c["sand"], eps)}
    if {"clay", "silt"} <= set(c):
        out |= {"fine_fraction": c["clay"] + c["silt"]}
    if {"clay", "carbon"} <= set(c):
        out |= {"clay_x_carbon": c["clay"] * c["carbon"]}
    if "ph" in c:
        out |= {"ph_squared": c["ph"] * c["ph"]}
    return out


def interactions(products: Sequence[tuple[str, str]], ratios: Sequence[tuple[str, str]], eps: float = EPSILON) -> dict[str, Column]:
    """Named products and guarded ratios across domains."""
    return {f"{a}_x_{b}": col(a) * col(b) for a, b in products} | {f"{a}_per_{b}": ratio(a, b, eps) for a, b in ratios}


def bounded_products(families: Mapping[str, Sequence[str]], limit: int) -> list[tuple[str, str]]:
    """At most `limit` pairs across families, evenly spaced over all of them."""
    names = sorted(families)
    pairs = [(a, b) for i, f in enumerate(names) for g in names[i + 1 :] for a in families[f] for b in families[g]]
    if len(pairs) <= limit:
        return pairs
    return [pairs[round(i * (len(pairs) - 1) / (limit - 1))] for i in range(limit)] if limit > 1 else pairs[:limit]


def timeline(df: DataFrame, key: str, group: str, groups: Sequence[str], date: str, value: str, periods: Sequence[tuple[str, int, int]], thresholds: Sequence[float], unit=None) -> DataFrame:
    """By entity: scenes, days and groups; for all rows and each group, per period count, mean, max and min; shares over thresholds.

    One conditional aggregate. `unit` maps a date to the number that periods are ranges of (the month unless given).
    """
    at = (unit or F.month)(F.col(date))
    aggregates = [F.count("*").alias("n_scenes"), F.count_distinct(F.to_date(date)).alias("n_days"), F.count_distinct(group).alias("n_groups")]
    for label, own in [("all", F.lit(True)), *((g, F.col(group) == g) for g in groups)]:
        for name, first, last in periods:
            v = F.when(own & at.between(first, last), F.col(value))
            aggregates += [F.count(v).alias(f"{label}__{name}__n"), F.avg(v).alias(f"{label}__{name}__mean"), F.max(v).alias(f"{label}__{name}__max"), F.min(v).alias(f"{label}__{name}__min")]
    aggregates += [F.avg((F.col(value) > t).cast("double")).alias(f"above_{i}") for i, t in enumerate(thresholds)]
    return df.groupBy(key).agg(*aggregates)


def duration_totals(df: DataFrame, key: str, step: str, rate: str, days: str) -> DataFrame:
    """Season total and mean rate weighted by duration, peak rate and the first step that has it."""
    ok = F.col(rate).isNotNull()
    sums = df.groupBy(key).agg(
        F.sum(F.col(rate) * F.col(days)).alias("season_total"),
        (F.sum(F.col(rate) * F.col(days)) / F.sum(F.when(ok, F.col(days)))).alias("mean_rate"),
        F.max(rate).alias("peak_rate"),
        F.max(F.when(ok, F.struct(F.col(rate), -F.col(step)))).alias("top_"),
    )
    return sums.select(key, "season_total", "mean_rate", "peak_rate", (-F.col("top_")["col2"]).alias("peak_step"))
