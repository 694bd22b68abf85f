"""Sinks: tables with a manifest of their columns, and partitioned shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def manifest(spark, records: Sequence[dict]) -> DataFrame:
    """Provenance of feature columns: column, family, mode, inputs, formula, meaning."""
    rows = [(r["column"], r.get("family"), r.get("mode"), list(r.get("inputs", [])), r.get("formula"), r.get("meaning")) for r in records]
    return spark.createDataFrame(rows, "column string, family string, mode string, inputs array<string>, formula string, meaning string")


def write_projections(df: DataFrame, folder: str, key: str, records: Sequence[dict], format: str = "parquet") -> None:
    """The whole table, the columns of mode `clean` and those of mode `competition`, and the manifest as JSON."""
    modes = {r["column"]: r.get("mode") for r in records}
    for name, wanted in (("all", None), ("clean", "clean"), ("competition", "competition")):
        cols = [c for c in df.columns if c == key or wanted is None or modes.get(c) == wanted]
        out = df.select(*cols).write.mode("overwrite")
        (out.option("header", True).csv if format == "csv" else out.parquet)(f"{folder}/{name}")
    manifest(df.sparkSession, records).write.mode("overwrite").json(f"{folder}/manifest")


def write_shards(df: DataFrame, folder: str, by: str) -> None:
    """One folder a value; a run over some values replaces only theirs."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
