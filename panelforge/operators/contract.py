"""Data contracts as rows (name, status, observed): one aggregate pass a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Each check is an aggregate and the value it must have."""
    one = df.agg(*(a.cast("long").alias(n) for n, (a, _) in checks.items()))
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.when(F.col(n) == v, "ok").otherwise("error").alias("status"), F.col(n).alias("observed")) for n, (_, v) in checks.items()))
    return one.select(F.explode(cells).alias("e")).select("e.*")


def violations(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def split_contract(df: DataFrame, key: str, target: str, split: str, train, predict) -> DataFrame:
    """Unique keys, known split labels, targets exactly where the split says."""
    return check_rows(
        df,
        {
            "null_keys": (violations(F.col(key).isNull()), 0),
            "repeated_keys": (F.count(key) - F.count_distinct(key), 0),
            "unknown_split": (violations(~F.coalesce(F.col(split).isin([train, predict]), F.lit(False))), 0),
            "train_without_target": (violations((F.col(split) == train) & F.col(target).isNull()), 0),
            "predict_with_target": (violations((F.col(split) == predict) & F.col(target).isNotNull()), 0),
        },
    )


def feature_contract(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Unique keys, no infinite or NaN value."""
    bad = {f"not_finite_{c}": (violations(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), 0) for c in columns}
    return check_rows(df, {"repeated_keys": (F.count(key) - F.count_distinct(key), 0), **bad})


def partition_split(df: DataFrame, split: str, train, predict) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(split) == train), df.where(F.col(split) == predict)


def panel_audit(df: DataFrame, key: str, date: str, sensor: str, variables: Sequence[str]) -> DataFrame:
    """By sensor: rows, entities, first and last date, repeated (key, date, sensor) rows and missing share of each variable."""
    dated = df.withColumn("d_", F.to_date(date))
    per = dated.groupBy(sensor, key, "d_").agg(F.count("*").alias("n_"), *(F.count(v).alias(v) for v in variables))
    return per.groupBy(sensor).agg(
        F.sum("n_").alias("rows"), F.count_distinct(key).alias("entities"), F.min("d_").alias("first_date"), F.max("d_").alias("last_date"), F.sum(F.col("n_") - 1).alias("repeated_rows"),
        *((1 - F.sum(v) / F.sum("n_")).alias(f"missing_{v}") for v in variables),
    )


def coverage_by_split(df: DataFrame, key: str, date: str, split: str) -> DataFrame:
    """Median, least and most rows of an entity and the median of its distinct dates, by split."""
    per = df.groupBy(split, key).agg(F.count("*").alias("n_"), F.count_distinct(F.to_date(date)).alias("d_"))
    return per.groupBy(split).agg(F.median("n_").alias("median_rows"), F.min("n_").alias("min_rows"), F.max("n_").alias("max_rows"), F.median("d_").alias("median_dates"))


def profile(df: DataFrame) -> DataFrame:
    """A row a column: type, missing rows, distinct values."""
    names = df.columns
    one = df.agg(F.count("*").alias("n_"), *(x for c in names for x in (F.count(c).alias(f"k_{c}"), F.count_distinct(c).alias(f"d_{c}"))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), (F.col("n_") - F.col(f"k_{c}")).alias("missing"), F.col(f"d_{c}").alias("distinct")) for c, t in df.dtypes))
    return one.select(F.explode(cells).alias("e")).select("e.*")
