"""Rasters as cell tables (raster, row, col, value) and polygons as rings of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.trajectories import let

ZONAL = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "median": F.median, "count": F.count, "sum": F.sum}


def zonal(cells: DataFrame, members: DataFrame, on: Sequence[str], key: str, value: str, stats: Sequence[str], divisor: float = 1.0, prefix: str = "zonal") -> DataFrame:
    """Statistics of the valid cells of each zone."""
    v = cells.where(F.col(value).isNotNull()).withColumn("v_", F.col(value) / divisor)
    return members.join(v, list(on)).groupBy(key).agg(*(ZONAL[s]("v_").alias(f"{prefix}_{s}") for s in stats))


def area_weighted(cells: DataFrame, members: DataFrame, on: Sequence[str], key: str, value: str, weight: str) -> DataFrame:
    """Weighted and plain mean, covered share of the weight, cells and effective cells of each zone."""
    met = members.join(cells, list(on), "left")
    ok = F.col(value).isNotNull()
    w = F.when(ok, F.col(weight))
    return met.groupBy(key).agg(
        F.when(F.sum(w) > 0, F.sum(w * F.col(value)) / F.sum(w)).alias("weighted_mean"), F.avg(value).alias("plain_mean"),
        F.when(F.sum(weight) > 0, F.coalesce(F.sum(w), F.lit(0.0)) / F.sum(weight)).alias("coverage"), F.count(value).alias("n_cells"),
        F.when(F.sum(w * w) > 0, F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_cells"),
    )


def overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Area that two boxes share."""
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def largest_overlap(pairs: DataFrame, key: str, other: str, area: str) -> DataFrame:
    """The partner with the largest shared area and its share; ties to the smaller key."""
    w = Window.partitionBy(key)
    ranked = pairs.withColumn("r_", F.row_number().over(w.orderBy(F.desc(area), other))).withColumn("all_", F.sum(area).over(w))
    return ranked.where("r_ = 1").select(key, other, F.when(F.col("all_") > 0, F.col(area) / F.col("all_")).alias("overlap_fraction"))


def ring_area(ring: Column) -> Column:
    """Planar area of a closed ring array<struct<x, y>> by the shoelace sum."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    cross = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    parts = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("sx"), (a["y"] + b["y"]).alias("sy")))
    twice = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v["c"])

    def center(axis: str) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v[axis] * v["c"]) / F.nullif(3 * twice, F.lit(0.0))

    return center("sx"), center("sy")


def signed_rings(polygons: Column) -> Column:
    """All rings of several polygons (arrays of an outer ring and its holes) as struct<r, s>: s is 1, for holes -1."""
    return F.flatten(F.transform(polygons, lambda p: F.transform(p, lambda r, i: F.struct(r.alias("r"), F.when(i == 0, 1.0).otherwise(-1.0).alias("s")))))


def polygon_area(polygons: Column) -> Column:
    """Area of several polygons: outer rings less their holes, whatever way the rings turn."""
    return F.aggregate(signed_rings(polygons), F.lit(0.0), lambda s, x: s + x["s"] * ring_area(x["r"]))


def polygon_centroid(polygons: Column) -> tuple[Column, Column]:
    """Centre of area of several polygons with holes."""
    rings = signed_rings(polygons)
    total = polygon_area(polygons)

    def centre(axis: int) -> Column:
        moment = F.aggregate(rings, F.lit(0.0), lambda s, x: s + x["s"] * ring_area(x["r"]) * F.coalesce(ring_centroid(x["r"])[axis], F.lit(0.0)))
        return F.when(total > 0, moment / total)

    return centre(0), centre(1)


def half_plane(ring: Column, axis: str, bound: Column, keep: int) -> Column:
    """The part of a ring on one side of an axis-parallel line: its points there and the points where its edges cross it."""

    def corner(p: Column, q: Column) -> Column:
        a, b = (p[axis] - bound) * keep, (q[axis] - bound) * keep
        t = a / F.nullif(a - b, F.lit(0.0))
        point = F.struct(p["x"].alias("x"), p["y"].alias("y"), (a >= 0).alias("ok"))
        cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"), F.coalesce(a * b < 0, F.lit(False)).alias("ok"))
        return F.array(point, cross)

    def cut(r: Column) -> Column:
        return F.filter(F.flatten(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), corner)), lambda p: p["ok"])

    return let(ring, cut)


def clip_area(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a closed ring of any shape inside an axis-aligned cell: cut by each of the four sides in turn."""
    out = ring
    for axis, bound, keep in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        out = half_plane(out, axis, bound, keep)
    return let(out, lambda r: F.when(F.size(r) > 2, ring_area(F.concat(r, F.slice(r, 1, 1)))).otherwise(F.lit(0.0)))


def polygon_cells(polygons: DataFrame, key: str, step: float) -> DataFrame:
    """(key, bx, by, area) of the grid cells of a given width that polygons cover, holes left out: only cells of a polygon's box are tried."""
    rings = polygons.select(key, F.explode("polygons").alias("p_")).select(key, F.posexplode("p_").alias("at_", "r_"))
    for c in ("x", "y"):
        values = F.col(f"r_.{c}")
        rings = rings.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.array_min(values) / step), F.floor(F.array_max(values) / step))))
    inside = clip_area(F.col("r_"), F.col("bx") * step, F.col("by") * step, (F.col("bx") + 1) * step, (F.col("by") + 1) * step)
    return rings.groupBy(key, "bx", "by").agg(F.sum(F.when(F.col("at_") == 0, inside).otherwise(-inside)).alias("area")).where("area > 1e-12")



def complete_scenes(bands: DataFrame, scene: str, band: str, required: Sequence[str]) -> DataFrame:
    """By scene the bands it lacks and whether it is complete."""
    out = bands.groupBy(scene).agg(F.collect_set(band).alias("have_"), F.count("*").alias("files"))
    lack = F.array_except(F.array(*map(F.lit, required)), F.col("have_"))
    return out.select(scene, "files", F.array_join(F.array_sort(lack), ",").alias("missing_bands"), (F.size(lack) == 0).alias("complete"))


def missing_inventory(inventory: DataFrame, variables: Sequence, years: Sequence[int], months: Sequence[int]) -> DataFrame:
    """Expected (variable, year, month) that the inventory lacks."""
    spark = inventory.sparkSession
    one = spark.range(1)
    grid = one.select(F.explode(F.array(*map(F.lit, variables))).alias("variable")).crossJoin(one.select(F.explode(F.array(*map(F.lit, years))).alias("year"))).crossJoin(one.select(F.explode(F.array(*map(F.lit, months))).alias("month")))
    return grid.join(inventory.select("variable", "year", "month").distinct(), ["variable", "year", "month"], "left_anti")


def best_scene(scenes: DataFrame, key: str, windows: DataFrame, date: str, order: Sequence) -> DataFrame:
    """The best scene of each entity in each window (name, start, end, middle), by the given order and then nearness to its middle."""
    met = scenes.join(F.broadcast(windows), F.col(date).between(F.col("start"), F.col("end")))
    w = Window.partitionBy(key, "window").orderBy(*order, F.abs(F.date_diff(date, "middle")), date)
    return met.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_", "start", "end", "middle")
