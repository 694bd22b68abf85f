"""Feature recipes: one aggregate of one column per group, in a window of time."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import num
from panelforge.operators.checks import join_checked, require_columns

DAY_MICROS = 86_400_000_000.0


@dataclass(frozen=True)
class FeatureRecipe:
    name: str
    value_column: str
    group_column: str
    aggregation: str
    date_column: str | None = None
    start: str | None = None
    end: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


#: Aggregates that need no order; std is of the sample.
SIMPLE = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "sum": F.sum}


def days(ts: Column) -> Column:
    """Fractional days since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(DAY_MICROS)


def slope(value: str, day: str) -> Column:
    """Least squares slope by day, NULL under two rows or without a span of time; computed from centred sums of `day0`-relative days."""
    return F.when((F.count(value) >= 2) & (F.max(day) > F.min(day)), F.regr_slope(F.col(value), F.col(day)))


def trapezoid(value: str, day: str, before_value: str, before_day: str) -> Column:
    area = F.sum((F.col(value) + F.col(before_value)) / 2 * (F.col(day) - F.col(before_day)))
    return F.when((F.count(value) >= 2) & (F.max(day) > F.min(day)), area)


def apply_recipe(df: DataFrame, recipe: FeatureRecipe, tie: str | None = None) -> DataFrame:
    """(group, name): rows without a value, group or needed date are left out, and groups without rows vanish.

    Rows of one time keep the order of `tie`, so areas are defined. One shuffle by group; the ordered aggregates share it with
    their window.
    """
    require_columns(df, [recipe.value_column, recipe.group_column, *([recipe.date_column] if recipe.date_column else [])])
    v, g = num(recipe.value_column).alias("v_"), F.col(recipe.group_column)
    columns = [g, v] + ([days(F.col(recipe.date_column)).alias("t_")] if recipe.date_column else []) + ([F.col(tie).alias("tie_")] if tie else [])
    rows = df
    if recipe.date_column:
        date = F.col(recipe.date_column).cast("timestamp_ntz")
        rows = rows.where(date.isNotNull())
        if recipe.start:
            rows = rows.where(date >= F.lit(recipe.start).cast("timestamp_ntz"))
        if recipe.end:
            rows = rows.where(date <= F.lit(recipe.end).cast("timestamp_ntz"))
    rows = rows.select(*columns).where(F.col("v_").isNotNull() & g.isNotNull())
    if recipe.aggregation in SIMPLE:
        return rows.groupBy(recipe.group_column).agg(SIMPLE[recipe.aggregation]("v_").alias(recipe.name))
    if not recipe.date_column:
        raise ValueError(f"{recipe.aggregation} needs a date column")
    if recipe.aggregation == "slope":
        return rows.groupBy(recipe.group_column).agg(slope("v_", "t_").alias(recipe.name))
    if recipe.aggregation == "auc":
        w = Window.partitionBy(recipe.group_column).orderBy("t_", *(["tie_"] if tie else ["v_"]))
        rows = rows.withColumn("pv_", F.lag("v_").over(w)).withColumn("pt_", F.lag("t_").over(w))
        return rows.groupBy(recipe.group_column).agg(trapezoid("v_", "t_", "pv_", "pt_").alias(recipe.name))
    raise ValueError(f"unknown aggregation: {recipe.aggregation}")


def merge_features(base: DataFrame, *features: DataFrame, on: str, validate: str = "1:1") -> DataFrame:
    for f in features:
        base = join_checked(base, f, [on], validate)
    return base
