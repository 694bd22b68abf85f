"""End-to-end plans: the feature-table build and the pseudo competition."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelforge.operators.recipes import FeatureRecipe
from panelforge.plans import competition, feature_table
from panelforge.plans.registry import columns_of, split_with


def panel_rows(spark):
    rows = [(f"P{i % 4}", f"2025-0{4 + i % 5}-1{i % 9}", "S2" if i % 2 else "L8", float(i % 7), 10.0 * (i % 3)) for i in range(40)]
    return spark.createDataFrame(rows, "id string, date string, sensor string, ndvi double, cloud double").withColumn("empty", F.lit(None).cast("double"))


def test_feature_table(spark, tmp_path):
    df = panel_rows(spark)
    spec = feature_table.PanelSpec("s2", "id", "sensor", "date", "cloud", ["ndvi", "empty"], "2025-04-01", "2025-10-31", (4, 5, 6), "clean", (FeatureRecipe("ndvi_slope", "ndvi", "id", "slope", "date"),))
    extra = df.groupBy("id").agg(F.max("ndvi").alias("peak"))
    base = df.select("id").distinct()
    table, notes = feature_table.build(base, "id", {"s2": (df, spec)}, [(extra, "extra", "competition")])
    assert table.count() == 4
    assert not [c for c in table.columns if "empty" in c]
    assert {"s2__s2__ndvi__mean", "ndvi_slope", "peak"} <= set(table.columns)
    assert {n["column"] for n in notes} == set(table.columns) - {"id"}
    feature_table.publish(table, notes, str(tmp_path / "out"), "id")
    clean = spark.read.parquet(str(tmp_path / "out/clean"))
    assert "peak" not in clean.columns and "ndvi_slope" in clean.columns
    with pytest.raises(ValueError):
        feature_table.build(base, "id", {}, [(extra.withColumn("peak", F.lit(float("nan"))), "extra", "clean")])
    with pytest.raises(ValueError):
        feature_table.build(base.unionByName(base), "id", {}, [(extra, "extra", "clean")])


def test_competition_ignores_target_labels(spark):
    rows = [(i, i % 3, [float(i % 7), float(i % 5)], float(i % 7) * 2 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g long, x array<double>, y double")
    edges = df.alias("a").join(df.alias("b"), F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.abs(F.col("a.id") - F.col("b.id")).cast("double").alias("d"))
    membership = competition.make_splits(df, "id", "g", 12, 2)
    assert membership.where("role = 'pseudo_target'").count() == 24
    first = {tuple(r)[:3]: r["predicted"] for r in competition.predict(membership, df, edges, "id", "g", "x", "y", ks=(6,)).collect()}
    targets = [r["id"] for r in membership.where("role = 'pseudo_target' and split_id = 0").select("id").collect()]
    changed = df.withColumn("y", F.when(F.col("id").isin(targets), F.lit(1e9)).otherwise(F.col("y")))
    second = {tuple(r)[:3]: r["predicted"] for r in competition.predict(membership, changed, edges, "id", "g", "x", "y", ks=(6,)).collect()}
    zero = [k for k in first if k[0] == 0]
    assert len(zero) == 36
    assert all(first[k] == pytest.approx(second[k]) for k in zero)
    out = competition.report(competition.predict(membership, df, edges, "id", "g", "x", "y", ks=(6,)))
    assert {r["method"] for r in out["methods"].collect()} == {"group_mean", "idw_k6", "local_ridge_k6"}
    assert out["selection"].count() == 2


def test_registry_helpers():
    assert columns_of("l: a b, d: x") == [("a", "l"), ("b", "l"), ("x", "d")]
    sql = "WITH a AS (SELECT 1), b AS (SELECT (2)) SELECT * FROM a"
    assert sql[split_with(sql) :] == "SELECT * FROM a"


def test_leave_one_out_predicts_every_row(spark):
    from panelforge import plans

    rows = plans.QUERIES["leave_one_out"](spark, "/root/testdata/sf0.001").collect()
    ids = [r["vec_id"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r["i"] for r in rows) == sorted(ids)
