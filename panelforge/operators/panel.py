"""Summaries of a longitudinal panel: one row per entity, columns named by sensor, variable and statistic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import slug, total

STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median, "sum": F.sum}


def levels(df: DataFrame, column: str) -> list:
    """The distinct values of a low-cardinality column: pivots name them, so plans have a fixed schema."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def names_of(values: Sequence) -> dict:
    """Value -> slug, on the driver."""
    return {v: "_".join(filter(None, "".join(c if c.isalnum() else " " for c in str(v).lower()).split())) for v in values}


def pivot_named(df: DataFrame, keys: Sequence[str], by: str, values: Sequence, aggregates: dict, prefix: str) -> DataFrame:
    """groupBy + pivot with columns prefix__<value>__<aggregate name>."""
    out = df.groupBy(*keys).pivot(by, list(values)).agg(*(a.alias(n) for n, a in aggregates.items()))
    slugs = names_of(values)
    single = len(aggregates) == 1
    name = {(f"{v}" if single else f"{v}_{n}"): f"{prefix}__{slugs[v]}__{n}" for v in values for n in aggregates}
    return out.withColumnsRenamed(name)


def period_summary(df: DataFrame, key: str, sensor: str, variables: Sequence[str], sensors: Sequence, prefix: str, statistics: Sequence[str] = ("mean", "std", "min", "max")) -> DataFrame:
    """Statistics of each variable by entity and sensor, unstacked."""
    aggregates = {f"{v}__{s}": STATISTICS[s](v) for v in variables for s in statistics}
    return pivot_named(df.where(F.col(sensor).isNotNull()), [key], sensor, sensors, aggregates, prefix)


def coverage(df: DataFrame, key: str, sensor: str, date: str, cloud: str, variables: Sequence[str], sensors: Sequence, prefix: str) -> DataFrame:
    """n_records, n_dates, mean and median cloud, and the mean share of variables that a row has."""
    share = total([F.col(v).isNotNull().cast("double") for v in variables]) / len(variables)
    aggregates = {
        "n_records": F.count(F.lit(1)),
        "n_dates": F.count_distinct(F.to_date(date)),
        "cloud_mean": F.avg(cloud),
        "cloud_median": F.median(cloud),
        "valid_fraction": F.avg(share),
    }
    return pivot_named(df.where(F.col(sensor).isNotNull()), [key], sensor, sensors, aggregates, prefix)


def position_means(df: DataFrame, key: str, sensor: str, position: str, variable: str, sensors: Sequence, positions: Sequence[int], prefix: str, order: str | None = None) -> DataFrame:
    """Mean by entity, sensor and position in the season, wide: prefix__<sensor>__<variable>__mNN.

    With `order`, a column that tells the rows of a cell apart, values are added one after another in that order: means are then
    the same to the last bit however the rows are partitioned, which ties between means depend on. A cell's values meet in a task.
    """
    tag = F.concat_ws("__", slug(F.col(sensor).cast("string")), F.format_string("m%02d", F.col(position)))
    values = [f"{s}__m{p:02d}" for s in names_of(sensors).values() for p in positions]
    rows = df.where(F.col(sensor).isNotNull()).withColumn("tag_", tag)
    if order:
        cell = F.when(F.col(variable).isNotNull(), F.struct(F.col(order).alias("o"), F.col(variable).cast("double").alias("v")))
        cells = rows.groupBy(key, "tag_").agg(F.array_sort(F.collect_list(cell)).alias("c_"))
        total = F.aggregate("c_", F.lit(0.0), lambda a, c: a + c["v"])
        rows, average = cells.select(key, "tag_", F.when(F.size("c_") > 0, total / F.size("c_")).alias("mean_")), F.first("mean_")
    else:
        average = F.avg(variable)
    out = rows.groupBy(key).pivot("tag_", values).agg(average)
    return out.withColumnsRenamed({v: f"{prefix}__{v.replace('__', f'__{variable}__')}" for v in values})


def collapse(df: DataFrame, key: str) -> DataFrame:
    """One row a key: numbers averaged, anything else its least non-null value."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema if f.name != key}
    return df.groupBy(key).agg(*((F.avg(c) if k in ("double", "float", "integer", "long") else F.min(c)).alias(c) for c, k in kinds.items()))


def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, median, std, min, max and count; the null group stays."""
    stats = {n: STATISTICS[n](value) for n in ("mean", "median", "std", "min", "max")}
    return df.groupBy(by).agg(*(a.alias(n) for n, a in stats.items()), F.count(value).alias("count"))


def shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of the values, within groups if given."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    if not by:
        whole = counts.agg(F.sum("n").alias("all_"))
        return counts.crossJoin(F.broadcast(whole)).select(column, "n", (F.col("n") / F.col("all_")).alias("share"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def total_variation(df: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """Half the summed differences between the shares of two groups."""
    s = shares(df.where(F.col(group).isin([a, b])), column, [group])
    sides = [s.where(F.col(group) == v).select(column, F.col("share").alias(n)) for v, n in ((a, "p"), (b, "q"))]
    joined = sides[0].join(sides[1], column, "full")
    return joined.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("total_variation"))


def presence(df: DataFrame, key: str, by: str, values: Sequence) -> DataFrame:
    """Whether an entity has a row for each value."""
    out = df.groupBy(key).pivot(by, list(values)).agg(F.count(F.lit(1)))
    return out.select(key, *((F.coalesce(F.col(f"`{v}`"), F.lit(0)) > 0).cast("int").alias(f"has_{n}") for v, n in names_of(values).items()))


def union_all(*blocks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)


def long_to_wide(df: DataFrame, keys: Sequence[str], by: str, value: str, values: Sequence) -> DataFrame:
    """One value a (key, column): duplicates raise."""
    if df.groupBy(*keys, by).count().where("count > 1").limit(1).count():
        raise ValueError("several values for one cell")
    return df.groupBy(*keys).pivot(by, list(values)).agg(F.first(value))


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str]) -> DataFrame:
    """About n rows at even steps of the order, first and last among them, in each group."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("row_", F.row_number().over(w.orderBy(*order)) - 1).withColumn("all_", F.count("*").over(w))
    step = F.floor(F.col("row_") * (n - 1) / (F.col("all_") - 1))
    before = F.floor((F.col("row_") - 1) * (n - 1) / (F.col("all_") - 1))
    keep = (F.col("all_") <= n) | (F.col("row_") == 0) | (step > before)
    return ranked.where(keep).drop("row_", "all_")
