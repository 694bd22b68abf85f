"""Descriptors of short trajectories held as one column a position: array expressions in one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import EPSILON, clean, col, ratio, symmetric_change

Points = Column  # array<struct<x: double, y: double>> without missing y, by x


def points(columns: Mapping[int | float, Column | str]) -> Points:
    """The positions that have a value, in order."""
    cells = [F.struct(F.lit(float(x)).alias("x"), clean(columns[x]).alias("y")) for x in sorted(columns)]
    return F.filter(F.array(*cells), lambda p: p["y"].isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(p: Points, low: float = float("-inf"), high: float = float("inf")) -> Points:
    return F.filter(p, lambda q: (q["x"] >= low) & (q["x"] <= high))


def added(values: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))


def mean(values: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.when(F.size(values) > 0, added(values, of) / F.size(values))


def value_at(p: Points, x: float) -> Column:
    return F.get(F.filter(p, lambda q: q["x"] == x), F.lit(0))["y"]


def ys(p: Points) -> Column:
    return F.transform(p, lambda q: q["y"])


def pairs(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(one, next) for neighbours."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), of)


def slope_of(p: Points) -> Column:
    def given(m: Column) -> Column:
        return ratio(added(p, lambda q: (q["x"] - m["x"]) * (q["y"] - m["y"])), added(p, lambda q: (q["x"] - m["x"]) * (q["x"] - m["x"])), 0.0)

    center = F.struct(mean(p, lambda q: q["x"]).alias("x"), mean(p, lambda q: q["y"]).alias("y"))
    return F.when(F.size(p) >= 2, let(center, given))


def quadratic_of(p: Points) -> Column:
    """Second-degree coefficient of the least squares parabola, of at least 3 positions; from sums over centred positions."""

    def given(m: Column) -> Column:
        c = F.transform(p, lambda q: F.struct((q["x"] - m).alias("x"), q["y"].alias("y")))
        n = F.size(p)
        sums = F.struct(
            added(c, lambda q: q["x"] * q["x"]).alias("xx"), added(c, lambda q: q["x"] * q["x"] * q["x"]).alias("xxx"), added(c, lambda q: q["x"] * q["x"] * q["x"] * q["x"]).alias("xxxx"),
            added(c, lambda q: q["y"]).alias("y"), added(c, lambda q: q["x"] * q["y"]).alias("xy"), added(c, lambda q: q["x"] * q["x"] * q["y"]).alias("xxy"),
        )
        return let(sums, lambda s: ratio(s["xxy"] - s["xx"] * s["y"] / n - s["xxx"] / s["xx"] * s["xy"], s["xxxx"] - s["xx"] * s["xx"] / n - s["xxx"] * s["xxx"] / s["xx"], 0.0))

    return F.when(F.size(p) >= 3, let(mean(p, lambda q: q["x"]), given))


def median_of(values: Column) -> Column:
    """Median of an array without missing values."""
    return let(F.sort_array(values), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def area_of(p: Points) -> Column:
    return F.when(F.size(p) >= 2, added(pairs(p, lambda a, b: (a["y"] + b["y"]) / 2 * (b["x"] - a["x"]))))


def top_position(p: Points) -> Column:
    """The first position of the largest value."""
    return let(F.array_max(ys(p)), lambda top: F.get(F.filter(p, lambda q: q["y"] == top), F.lit(0))["x"])


def low_position(p: Points) -> Column:
    """The first position of the smallest value."""
    return let(F.array_min(ys(p)), lambda low: F.get(F.filter(p, lambda q: q["y"] == low), F.lit(0))["x"])


def std_of(values: Column) -> Column:
    """Population standard deviation."""
    return let(mean(values), lambda m: F.sqrt(mean(values, lambda v: (v - m) * (v - m))))


def correlation(pairs_: Column, a: str = "a", b: str = "b") -> Column:
    """Pearson over an array of structs, NULL where a side is constant (by its values: a mean of equal ones may be rounded off them)."""

    def varies(side: str) -> Column:
        v = F.transform(pairs_, lambda q: q[side])
        return F.array_max(v) > F.array_min(v)

    def given(m: Column) -> Column:
        cov = added(pairs_, lambda q: (q[a] - m["a"]) * (q[b] - m["b"]))
        va, vb = added(pairs_, lambda q: (q[a] - m["a"]) * (q[a] - m["a"])), added(pairs_, lambda q: (q[b] - m["b"]) * (q[b] - m["b"]))
        return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))

    return F.when(varies(a) & varies(b), let(F.struct(mean(pairs_, lambda q: q[a]).alias("a"), mean(pairs_, lambda q: q[b]).alias("b")), given))


def running_correlation(pairs_: Column, a: str = "a", b: str = "b") -> Column:
    """Pearson by moments that follow the rows one by one, as SQL's corr(a, b) and var_pop do; NULL where one of these is 0.

    Values that are equal up to rounding have the same correlation, or none, as there; correlation() has its own rounding.
    """

    def moved(s: Column, q: Column) -> Column:
        n, dx, dy = s["n"] + 1, q[b] - s["x"], q[a] - s["y"]
        x, y = s["x"] + dx / n, s["y"] + dy / n
        return F.struct(n.alias("n"), x.alias("x"), y.alias("y"), (s["c"] + dx * (q[a] - y)).alias("c"), (s["vx"] + (q[b] - x) * dx).alias("vx"), (s["vy"] + (q[a] - y) * dy).alias("vy"))

    none = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "x", "y", "c", "vx", "vy")))
    return F.aggregate(pairs_, none, moved, lambda s: F.when((s["vx"] > 0) & (s["vy"] > 0), s["c"] / s["n"] / (F.sqrt(s["vx"] / s["n"]) * F.sqrt(s["vy"] / s["n"]))))


def least_rank(values: Column, v: Column) -> Column:
    """Rank among the values, ties all at the least of their ranks: SQL's rank()."""
    return F.size(F.filter(values, lambda o: o < v)) + F.lit(1.0)


def average_rank(values: Column, v: Column) -> Column:
    """Rank among the values, ties averaged."""
    below, same = F.size(F.filter(values, lambda o: o < v)), F.size(F.filter(values, lambda o: o == v))
    return below + (same + F.lit(1)) / 2


def phenology(p: Points, months: Sequence[int]) -> dict[str, Column]:
    """auc, season_mean, amplitude, peak_month, early and late means, June to August, green-up and senescence slopes."""
    at = {m: value_at(p, m) for m in (6, 8) if m in months}
    return {
        "auc": area_of(p),
        "season_mean": mean(ys(p)),
        "amplitude": F.array_max(ys(p)) - F.array_min(ys(p)),
        "peak_month": top_position(p),
        "early_mean": mean(ys(within(p, high=6))),
        "late_mean": mean(ys(within(p, low=8))),
        "jun_to_aug_delta": at[8] - at[6] if len(at) == 2 else F.lit(None).cast("double"),
        "greenup_slope": slope_of(within(p, high=7)),
        "senescence_slope": slope_of(within(p, low=8)),
    }


def shape(p: Points, correlate: Callable[..., Column] = correlation) -> dict[str, Column]:
    """Variation, roughness, curvature energy, autocorrelation, trend fit, turns, sharpness, centre of mass, entropy.

    correlate: correlation(), or running_correlation() to round as SQL does; the trend fit is its square,
    NaN where SQL divides by a variance that rounding left at 0.
    """
    y = ys(p)
    slopes = pairs(p, lambda a, b: (b["y"] - a["y"]) / (b["x"] - a["x"]))
    bends = pairs(slopes, lambda a, b: b - a)
    signs = F.filter(F.transform(slopes, lambda s: F.signum(s)), lambda s: s != 0)
    turns = pairs(signs, lambda a, b: (a != b).cast("double"))
    neighbours = pairs(y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ordered = F.sort_array(y, asc=False)
    span = F.array_max(y) - F.array_min(y)

    def weighed(of: Callable[[Column, Column], Column]) -> Column:
        """of(weights by position, their sum), the weights being values scaled to 0..1."""
        bounds = F.struct(F.array_min(y).alias("low"), span.alias("span"))
        scaled = let(bounds, lambda b: F.transform(p, lambda q: F.struct(q["x"].alias("x"), ((q["y"] - b["low"]) / b["span"]).alias("w"))))
        return F.when(two & (span > 0), let(scaled, lambda w: let(added(w, lambda q: q["w"]), lambda mass: of(w, mass))))

    two, many = F.size(p) >= 2, F.size(p) >= 3
    trend = F.pow(correlate(p, "y", "x"), F.lit(2))
    return {
        "total_variation": F.when(two, added(pairs(y, lambda a, b: F.abs(b - a)))),
        "roughness": F.when(many, mean(bends, lambda b: F.abs(b))),
        "curvature_energy": F.when(many, mean(bends, lambda b: b * b)),
        "lag1_autocorr": F.when(many, correlate(neighbours, "b", "a")),
        "linear_trend_r2": F.when(two & (span > 0), trend if correlate is correlation else F.coalesce(trend, F.lit(float("nan")))),
        "turning_fraction": F.when(many, F.coalesce(mean(turns), F.lit(0.0))),
        "peak_sharpness": F.when(two, F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))),
        "center_of_mass_month": weighed(lambda w, mass: added(w, lambda q: q["x"] * q["w"]) / mass),
        "shape_entropy": weighed(lambda w, mass: -added(F.filter(w, lambda q: q["w"] > 0), lambda q: q["w"] / mass * F.ln(q["w"] / mass)) / F.ln(F.size(w))),
    }


def both(a: Mapping[int, str], b: Mapping[int, str]) -> Column:
    """Positions at which two trajectories have values, as structs x, a, b."""
    cells = [F.struct(F.lit(float(x)).alias("x"), clean(a[x]).alias("a"), clean(b[x]).alias("b")) for x in sorted(a)]
    return F.filter(F.array(*cells), lambda q: q["a"].isNotNull() & q["b"].isNotNull())


def agreement(pa: Points, pb: Points, shared: Column, eps: float = EPSILON) -> dict[str, Column]:
    """Season differences of two sensors and the error where both have values."""
    a, b = mean(ys(pa)), mean(ys(pb))
    return {
        "season_mean_difference": a - b,
        "season_mean_ratio": ratio(a, b, eps),
        "monthly_rmse": F.sqrt(mean(shared, lambda q: (q["a"] - q["b"]) * (q["a"] - q["b"]))),
    }


def shape_similarity(pa: Points, pb: Points, shared: Column, eps: float = EPSILON, rank: Callable[[Column, Column], Column] = average_rank, correlate: Callable[..., Column] = correlation) -> dict[str, Column]:
    """Correlations (of at least 3 shared positions), normalised error, symmetric difference, distance of the peaks.

    rank: how Spearman's ranks treat ties. correlate: as in shape().
    """
    a, b = F.transform(shared, lambda q: q["a"]), F.transform(shared, lambda q: q["b"])
    ranks = F.transform(shared, lambda q: F.struct(rank(a, q["a"]).alias("a"), rank(b, q["b"]).alias("b")))
    enough = F.size(shared) >= 3
    rmse = F.sqrt(mean(shared, lambda q: (q["a"] - q["b"]) * (q["a"] - q["b"])))
    span = F.greatest(F.array_max(ys(pa)), F.array_max(ys(pb))) - F.least(F.array_min(ys(pa)), F.array_min(ys(pb)))
    norm = F.sqrt(added(a, lambda v: v * v)) * F.sqrt(added(b, lambda v: v * v))
    change = F.filter(F.transform(shared, lambda q: F.abs(symmetric_change(q["a"], q["b"], eps))), lambda v: v.isNotNull())
    return {
        "pearson_r": F.when(enough, correlate(shared)),
        "spearman_r": F.when(enough, correlate(ranks)),
        "cosine_similarity": F.when(enough & (norm > 0), added(shared, lambda q: q["a"] * q["b"]) / norm),
        "normalized_rmse": ratio(rmse, span, eps),
        "mean_abs_symmetric_difference": mean(change),
        "peak_month_abs_difference": F.abs(top_position(pa) - top_position(pb)),
    }


def anomaly(current: Points, history: Points, shared: Column, months: Sequence[int], eps: float = EPSILON, with_ratio: bool = True) -> dict[str, Column]:
    """Departure of the current season (a) from history (b). `late` is the last three positions of the season."""
    late = sorted(months)[-3:]
    gap = F.transform(shared, lambda q: q["a"] - q["b"])
    out = {
        "season_mean_delta": mean(gap),
        "season_mean_ratio": ratio(mean(ys(current)), mean(ys(history)), eps),
        "auc_delta": area_of(current) - area_of(history),
        "august_delta": F.get(F.transform(F.filter(shared, lambda q: q["x"] == 8), lambda q: q["a"] - q["b"]), F.lit(0)),
        "late_season_delta": mean(F.transform(F.filter(shared, lambda q: q["x"].isin([float(m) for m in late])), lambda q: q["a"] - q["b"])),
        "peak_month_shift": top_position(current) - top_position(history),
    }
    return out if with_ratio else {k: v for k, v in out.items() if k != "season_mean_ratio"}


def range_position(p: Points, low: Column | str, high: Column | str, scale: float = 1.0, eps: float = EPSILON) -> dict[str, Column]:
    """Where a season lies in a historical range: scale (y - low) / (high - low), not clipped, multiplied first: what rounding puts above the scale is as in SQL."""
    at = F.filter(F.transform(p, lambda q: ratio(F.lit(scale) * (q["y"] - col(low)), col(high) - col(low), eps)), lambda v: v.isNotNull())
    return {
        "season_mean": mean(at),
        "season_min": F.array_min(at),
        "season_max": F.array_max(at),
        "season_range": F.array_max(at) - F.array_min(at),
        "below_history_fraction": mean(at, lambda v: (v < 0).cast("double")),
        "above_history_fraction": mean(at, lambda v: (v > scale).cast("double")),
    }


def change_features(shared: Column, eps: float = EPSILON) -> dict[str, Column]:
    """Symmetric change of a against b by position. Sign changes skip zeros; fewer than two signs count 0."""
    change = F.filter(F.transform(shared, lambda q: F.struct(q["x"].alias("x"), symmetric_change(q["a"], q["b"], eps).alias("y"))), lambda q: q["y"].isNotNull())
    y = ys(change)
    signs = F.filter(F.transform(y, lambda v: F.signum(v)), lambda v: v != 0)
    turns = pairs(signs, lambda a, b: (a != b).cast("double"))
    return {
        "season_mean": mean(y),
        "rms": F.sqrt(mean(y, lambda v: v * v)),
        "max_abs": F.array_max(F.transform(y, lambda v: F.abs(v))),
        "late_mean": mean(ys(within(change, low=8))),
        "positive_fraction": mean(y, lambda v: (v > 0).cast("double")),
        "sign_change_fraction": F.when(F.size(y) > 0, F.coalesce(mean(turns), F.lit(0.0))),
    }


def aggregate_geometry(average: Column | str, std: Column | str, low: Column | str, high: Column | str, eps: float = EPSILON) -> dict[str, Column]:
    m, s, a, b = col(average), col(std), col(low), col(high)
    return {
        "cv_absmean": ratio(s, F.abs(m), eps),
        "std_over_range": ratio(s, b - a, eps),
        "mean_position_in_range": ratio(m - a, b - a, eps),
        "range_asymmetry": ratio(b + a - F.lit(2.0) * m, b - a, eps),
    }


def lag_correlation(shared_a: Column, shared_b: Column, max_lag: int, least: int) -> Column:
    """struct(lag, r): the best correlation of equally long value arrays over shifts -max..max; the first shift wins ties."""

    def at(lag: int) -> Column:
        n = F.size(shared_a) - abs(lag)
        a = F.slice(shared_a, 1 + max(0, -lag), F.greatest(n, F.lit(0)))
        b = F.slice(shared_b, 1 + max(0, lag), F.greatest(n, F.lit(0)))
        zipped = F.filter(F.zip_with(a, b, lambda u, v: F.struct(u.alias("a"), v.alias("b"))), lambda q: q["a"].isNotNull() & q["b"].isNotNull())
        return F.struct(F.when(F.size(zipped) >= least, correlation(zipped)).alias("r"), F.lit(-lag).alias("order"), F.lit(lag).alias("lag"))

    found = F.filter(F.array(*(at(lag) for lag in range(-max_lag, max_lag + 1))), lambda q: q["r"].isNotNull())
    return F.array_max(found)


def with_features(df: DataFrame, arrays: Mapping[str, Column], features: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One projection for the point arrays, one for what is read from them."""
    held = df.select(*keep, *(a.alias(n) for n, a in arrays.items()))
    return held.select(*keep, *(c.alias(n) for n, c in features.items()))
