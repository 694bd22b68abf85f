"""Yearly statistics by area: weighted roll-ups, scopes, fallbacks, histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import ratio


def yearly(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of planted, harvested, lost and production; yield over harvested, damage over planted."""
    sums = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("planted", "harvested", "lost", "production")))
    return sums.withColumn("yield", ratio("production", "harvested", 0.0)).withColumn("damage", ratio("lost", "planted", 0.0))


def history(df: DataFrame, keys: Sequence[str], year: str, value: str, last: int | None = None, prefix: str = "hist") -> DataFrame:
    """Mean, population deviation, slope by year and number of years."""
    y = F.col(value) if last is None else F.when(F.col(year) <= last, F.col(value))
    x = F.when(y.isNotNull(), F.col(year)).cast("double")
    trend = F.when((F.count(y) >= 2) & (F.max(x) > F.min(x)), F.regr_slope(y, x))
    return df.groupBy(*keys).agg(F.avg(y).alias(f"{prefix}_mean"), F.stddev_pop(y).alias(f"{prefix}_std"), trend.alias(f"{prefix}_trend"), F.count(y).alias(f"{prefix}_years"))


def scope(df: DataFrame, keys: Sequence[str], filters: Mapping[str, object], name: str) -> DataFrame:
    """Yearly sums under optional predicates (None: all) and the production-weighted reported yield."""
    for c, v in filters.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    out = yearly(df, keys)
    return out.select(*keys, F.col("yield").alias(f"{name}_yield"), F.col("production").alias(f"{name}_production"))


def scopes_cube(df: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """All scopes of the dimensions in one pass: grouping sets, NULL standing for all, with their grouping id."""
    sets = ", ".join(f"({', '.join([*keys, *s])})" for s in subsets(dims))
    df.createOrReplaceTempView("scopes_")
    return df.sparkSession.sql(
        f"SELECT {', '.join([*keys, *dims])}, cast(grouping_id({', '.join([*keys, *dims])}) as bigint) AS gid, sum(production) AS production, sum(harvested) AS harvested FROM scopes_ GROUP BY GROUPING SETS ({sets})"
    )


def subsets(items: Sequence[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for i in items:
        out += [[*s, i] for s in out]
    return out


def fallback(columns: Mapping[str, Column | str]) -> tuple[Column, Column]:
    """(first value that is there, its label)."""
    cols = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for n, c in cols.items():
        label = label.when(c.isNotNull(), F.lit(n))
    return F.coalesce(*cols.values()), label


def canonical(files: DataFrame, year: str, name: str, preferred: str) -> DataFrame:
    """One file a year: the one whose name matches, else the first by name."""
    w = Window.partitionBy(year).orderBy(F.col(name).rlike(preferred).desc(), name)
    return files.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def join_by_name(left: DataFrame, right: DataFrame, name: str, key: str, spatial: str) -> DataFrame:
    """Key by normalised name, else by the spatial key, and which of them it was."""
    from panelforge.functions.expressions import label

    names = right.select(label(name).alias("n_"), F.col(key).alias("k_")).groupBy("n_").agg(F.min("k_").alias("k_"))
    out = left.withColumn("n_", label(name)).join(F.broadcast(names), "n_", "left")
    return out.withColumn(key, F.coalesce("k_", spatial)).withColumn("join_source", F.when(F.col("k_").isNotNull(), "official_name").when(F.col(spatial).isNotNull(), "spatial_fallback")).drop("n_", "k_")
