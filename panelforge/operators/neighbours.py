"""Nearest neighbours, graphs and spatial statistics over edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import EARTH_KM, haversine_km
from panelforge.session import materialize, partitions


QUERY_ROWS = 10_000
FEW_ROWS = 5_000  # of a right side that all queries meet at once
REACH = 8  # buckets in each direction before a place meets all rows
BLOCK_ROWS = 1024  # of a block of rows: two blocks make a group
TILE_ROWS = 32  # of a block that meet another block at once


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def edges(left: DataFrame, right: DataFrame, key: str, distance, columns: Sequence[str], blocks: Sequence[str] = ()) -> DataFrame:
    """(i, j, d) of the pairs i <> j that share the block columns, d from distance(row of i, row of j).

    Without blocks every row of the left side, a stated query set, meets all rows of the right one: in blocks of QUERY_ROWS
    queries, one of which is broadcast, more of which are joined by block.
    """
    a = left.select(F.col(key).alias("i"), *blocks, F.struct(*columns).alias("a_"))
    b = right.select(F.col(key).alias("j"), *blocks, F.struct(*columns).alias("b_"))
    met = a.join(b, list(blocks)) if blocks else against(a, b, "i")
    return met.where("i <> j").select(*blocks, "i", "j", distance(F.col("a_"), F.col("b_")).alias("d"))


def against(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each query beside each row, the queries counted and dealt to blocks of about QUERY_ROWS."""
    parts = -(-queries.count() // QUERY_ROWS)
    if parts <= 1:
        return rows.crossJoin(F.broadcast(queries))
    dealt = queries.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return rows.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, "part_").drop("part_")


def block_pairs(df: DataFrame, key: str, block: str, read: Callable, measure: Callable, weigh: Callable) -> DataFrame:
    """(i, j, d) of all pairs i <> j of rows that share a block, each measured once, by numpy, for both directions.

    Rows of a block value are dealt by key to parts of about BLOCK_ROWS; each two parts are a group, so the rows are sent once
    for each part and a frequent value is shared by many tasks. read(table) gives arrays with rows along their last axis;
    measure(a, b) of two such lists gives matrices that don't depend on the direction, with masks of what is missing;
    weigh(i, *measured) gives d of the rows i towards the others and its mask. Keys are whole numbers.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(block).isNotNull())
    parts = F.ceil(F.col("rows_") / BLOCK_ROWS).cast("int")
    counts = rows.groupBy(block).agg(F.count("*").alias("rows_")).select(block, parts.alias("parts_"))
    cells = int(counts.agg(F.sum(F.col("parts_") * (F.col("parts_") + 1) / 2)).first()[0] or 0)
    dealt = rows.join(counts, block).withColumn("part_", F.pmod(F.xxhash64(key), F.col("parts_")).cast("int"))
    sent = dealt.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    sent = sent.withColumn("low_", F.least("part_", "other_")).withColumn("high_", F.greatest("part_", "other_")).drop("parts_", "other_")
    spread = min(max(cells, partitions(df.sparkSession)), 10_000)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        low = np.equal(t["part_"].to_numpy(), t["low_"].to_numpy())
        same = t["low_"][0] == t["high_"][0]
        a, b = t.filter(pa.array(low)), t if same else t.filter(pa.array(~low))
        keys, j, left, right = a[key].to_numpy(), b[key].to_numpy(), read(a), read(b)
        for n in range(0, len(a) if len(b) else 0, TILE_ROWS):
            i = keys[n : n + TILE_ROWS]
            found = measure([x[..., n : n + TILE_ROWS] for x in left], right)
            there = weigh(i[:, None], *found)
            one, other = np.repeat(i, len(j)), np.tile(j, len(i))
            keep = one != other if same else None
            yield batch_of(one, other, *there, keep)
            if not same:
                yield batch_of(other, one, *weigh(j[None, :], *found), keep)

    return sent.repartition(spread, block, "low_", "high_").groupBy(block, "low_", "high_").applyInArrow(meet, "i long, j long, d double")


def batch_of(i: np.ndarray, j: np.ndarray, d: np.ndarray, missing: np.ndarray | None, keep: np.ndarray | None) -> pa.RecordBatch:
    d, missing = d.ravel(), None if missing is None else missing.ravel()
    if keep is not None:
        i, j, d, missing = i[keep], j[keep], d[keep], None if missing is None else missing[keep]
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d, mask=missing)], names=["i", "j", "d"])


def place_arrays(t: pa.Table, lat: str, lon: str) -> list[np.ndarray]:
    """Coordinates, NaN where missing."""
    return [t[c].to_numpy().astype(float) for c in (lat, lon)]


def place_matrix(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """haversine_km between two place_arrays(); as there, and in SQL, a place without coordinates lies half the globe away."""
    (y, x), (v, u) = a, b
    h = np.square(np.sin(np.radians(v[None, :] - y[:, None]) / 2)) + np.cos(np.radians(y))[:, None] * np.cos(np.radians(v))[None, :] * np.square(np.sin(np.radians(u[None, :] - x[:, None]) / 2))
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.fmin(1.0, h)))


def vector_arrays(t: pa.Table, column: str) -> list[np.ndarray]:
    """Vectors by place, zeros after their end, and their lengths, -1 of those that are missing or have gaps."""
    lists = t[column].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    values, at = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
    gaps = np.concatenate([[0], np.cumsum(lists.values.is_null().to_numpy(zero_copy_only=False))])
    sizes = np.diff(at)
    out = np.zeros((sizes.max(initial=0), len(t)))
    for k in range(len(out)):
        out[k, sizes > k] = values[at[:-1][sizes > k] + k]
    return [out, np.where(t[column].is_valid().to_numpy() & (gaps[at[1:]] == gaps[at[:-1]]), sizes, -1)]


def vector_matrix(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """euclidean between two vector_arrays(), summed place by place, and where a vector is missing, has a gap or another length."""
    (p, m), (q, n) = a, b
    total, gap = np.zeros((len(m), len(n))), np.empty((len(m), len(n)))
    for v, u in zip(p, q, strict=False):  # places beyond the shorter side belong to pairs of unequal length
        np.subtract(v[:, None], u[None, :], out=gap)
        np.multiply(gap, gap, out=gap)
        np.add(total, gap, out=total)
    alike = (m[:, None] == n[None, :]) & (m >= 0)[:, None]
    return np.sqrt(total, out=total), None if alike.all() else ~alike


def by_embedding(column: str):
    return lambda a, b: euclidean(a[column], b[column])


def by_place(lat: str, lon: str):
    return lambda a, b: haversine_km(a[lat], a[lon], b[lat], b[lon])


def nearest(e: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest of each i; ties to the smaller j; unknown distances last. The rank prunes before the shuffle."""
    w = Window.partitionBy(*by, "i").orderBy(F.col("d").asc_nulls_last(), "j")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_places(left: DataFrame, right: DataFrame, key: str, lat: str, lon: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, d, rank): the k places of the right side nearest to each of the left one, other than itself, over the sphere.

    With `by` (columns of the right side) each left place has k in every group. Exact, without meeting all pairs: a place looks
    at the grid buckets around it, and once more at twice the reach until its k-th neighbour lies nearer than anything outside
    can; what a few rounds leave open meets all rows, in blocks. A round is written to the shared folder. Rows without
    coordinates take no part; ties go to the smaller j; fewer than k come back where there are no more.
    """
    held = [F.col(key).alias("j"), *by, F.col(lat).cast("double").alias("lat_j"), F.col(lon).cast("double").alias("lon_j")]
    r = right.select(*held).where("lat_j is not null and lon_j is not null")
    box = r.agg(F.count("*").alias("n"), F.min("lat_j").alias("a"), F.max("lat_j").alias("b"), F.min("lon_j").alias("c"), F.max("lon_j").alias("d")).first()
    pending = left.select(F.col(key).alias("i"), F.col(lat).cast("double").alias("lat_i"), F.col(lon).cast("double").alias("lon_i")).where("lat_i is not null and lon_i is not null")
    groups = r.select(*by).distinct() if by else None
    pending = pending.crossJoin(F.broadcast(groups)) if by else pending  # groups are folds or splits
    spread = max((box["b"] - box["a"]) * (box["d"] - box["c"]), 1e-6) if box["n"] else 1.0
    around = max(1, int(360 / max(0.001, min(90.0, (spread * k / max(1, box["n"])) ** 0.5))))  # buckets round the globe
    step = 360 / around
    by_y, by_x = (F.floor((F.col(c) + o) / step).cast("long") for c, o in (("lat_j", 90), ("lon_j", 180)))
    r = r if (box["n"] or 0) <= FEW_ROWS else materialize(r.withColumn("by_", by_y).withColumn("bx_", F.pmod(by_x, F.lit(around))), "places")
    pair = haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))
    names = [*by, "i"]

    def best(met: DataFrame) -> DataFrame:
        return nearest(met.where("i <> j").select(*names, "j", pair.alias("d"), "lat_i", "lon_i"), k, by)

    out, reach = None, 1
    while True:
        few = (box["n"] or 0) <= FEW_ROWS  # then rounds cost more than they spare
        whole = few or reach > REACH or 2 * reach + 1 >= around
        if few:
            asked = pending.repartition(partitions(pending.sparkSession), "i")
            met = asked.join(F.broadcast(r), list(by)) if by else asked.crossJoin(F.broadcast(r))
        elif whole:
            met = against(pending, r, "i") if not by else pending.withColumnsRenamed({c: f"{c}_l" for c in by})
            met = met if not by else against(met, r, "i").where(" and ".join(f"{c} <=> {c}_l" for c in by))
        else:
            rows = F.sequence(F.floor((F.col("lat_i") + 90) / step) - reach, F.floor((F.col("lat_i") + 90) / step) + reach)
            cols = F.transform(F.sequence(F.floor((F.col("lon_i") + 180) / step) - reach, F.floor((F.col("lon_i") + 180) / step) + reach), lambda x: F.pmod(x, F.lit(around)))
            met = pending.withColumn("by_", F.explode(rows)).withColumn("bx_", F.explode(cols)).join(r, [*by, "by_", "bx_"])
        found = best(met) if few else materialize(best(met), "nearest")
        kept = found.select(*names, "j", "d", "rank")
        if whole:
            return kept if out is None else out.unionByName(kept)
        # the covered box ends `reach` steps away at least: northward, or at a meridian that far off
        away = F.least(F.lit(reach * step), F.lit(90.0))
        safe = EARTH_KM * F.least(F.radians(away), F.asin(F.sin(F.radians(away)) * F.cos(F.radians("lat_i"))))
        done = found.where((F.col("rank") == k) & (F.col("d") <= safe)).select(*names)
        sure = kept.join(done, names, "left_semi")
        out = sure if out is None else out.unionByName(sure)
        pending = materialize(pending.join(done, names, "left_anti"), "pending")
        if not pending.limit(1).count():
            return out
        reach *= 2


def normalized(e: DataFrame) -> DataFrame:
    """Distances over the median distance of the nearest neighbour."""
    scale = e.where("d is not null").groupBy("i").agg(F.min("d").alias("m_")).agg(F.median("m_").alias("scale_"))
    return e.crossJoin(F.broadcast(scale)).withColumn("d", F.when(F.col("scale_") > 0, F.col("d") / F.col("scale_"))).drop("scale_")


def mixed(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of distances; a missing part adds 0 and weights stay; NULL where all are missing."""
    out = None
    for name, (e, _) in parts.items():
        one = e.select("i", "j", F.col("d").alias(name))
        out = one if out is None else out.join(one, ["i", "j"], "full")
    return out.select("i", "j", weighted({n: (F.col(n), w) for n, (_, w) in parts.items()}).alias("d"))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """mixed() of distances that stand in one row: pairs met once need no join of edge tables."""
    total = sum((F.coalesce(d * w, F.lit(0.0)) for d, w in parts.values()), F.lit(0.0))
    return F.when(F.coalesce(*(d for d, _ in parts.values())).isNotNull(), total)


def weighted_matrix(parts: dict[str, tuple[np.ndarray, np.ndarray | None, float]]) -> tuple[np.ndarray, np.ndarray | None]:
    """weighted() of matrices with masks of what is missing, and the mask of the result."""
    total = sum(d * w if no is None else np.where(no, 0.0, d * w) for d, no, w in parts.values())
    gaps = [no for _, no, _ in parts.values()]
    return total, None if any(no is None for no in gaps) else np.broadcast_to(np.logical_and.reduce(np.broadcast_arrays(*gaps)), total.shape)


def symmetric(e: DataFrame) -> DataFrame:
    """Undirected pairs of directed ones, the smaller distance."""
    return e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").groupBy("i", "j").agg(F.min("d").alias("d"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), *(c for c in e.columns if c not in ("i", "j"))))


def rbf_graph(e: DataFrame, k: int) -> DataFrame:
    """Symmetric k-nearest graph with weights exp(-(d / s)^2 / 2), s the median edge."""
    pairs = symmetric(nearest(e, k).select("i", "j", "d"))
    s = pairs.agg(F.median("d").alias("s_"))
    return both_ways(pairs.crossJoin(F.broadcast(s)).select("i", "j", "d", F.when(F.col("s_") > 0, F.exp(-0.5 * F.pow(F.col("d") / F.col("s_"), F.lit(2)))).otherwise(F.lit(1.0)).alias("w")))


def row_weights(e: DataFrame, k: int) -> DataFrame:
    """Symmetric k-nearest neighbours with weights that sum to 1 for each i."""
    pairs = both_ways(symmetric(nearest(e, k).select("i", "j", "d")))
    return pairs.withColumn("w", 1 / F.count("*").over(Window.partitionBy("i")))


def morans_i(weights: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """(n, morans_i, expected) of a value over weights (i, j, w)."""
    center = values.where(F.col(value).isNotNull()).agg(F.avg(value).alias("m_"), F.count("*").alias("n_"), (F.var_pop(value) * F.count("*")).alias("ss_"))
    v = values.where(F.col(value).isNotNull()).select(key, value)
    e = weights.join(v.select(F.col(key).alias("i"), F.col(value).alias("vi_")), "i").join(v.select(F.col(key).alias("j"), F.col(value).alias("vj_")), "j")
    sums = e.crossJoin(F.broadcast(center)).groupBy("n_", "ss_").agg(F.sum("w").alias("w_"), F.sum(F.col("w") * (F.col("vi_") - F.col("m_")) * (F.col("vj_") - F.col("m_"))).alias("c_"))
    return sums.select(F.col("n_").alias("n"), F.when((F.col("ss_") > 0) & (F.col("w_") > 0), F.col("n_") / F.col("w_") * F.col("c_") / F.col("ss_")).alias("morans_i"), (F.lit(-1.0) / (F.col("n_") - 1)).alias("expected"))


def nearest_cell(points: DataFrame, cells: DataFrame, key: str, cell: str, lat: str, lon: str, step: float) -> DataFrame:
    """The nearest grid cell of each point within one step: candidates come from the 3 x 3 buckets around it, by equality."""
    bucket = lambda c: F.floor(F.col(c) / step)
    around = F.explode(F.array(*(F.struct((bucket(lat) + a).alias("by_"), (bucket(lon) + b).alias("bx_")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    p = points.select(key, F.col(lat).alias("plat_"), F.col(lon).alias("plon_"), around.alias("b_")).select(key, "plat_", "plon_", "b_.*")
    c = cells.select(cell, F.col(lat).alias("clat_"), F.col(lon).alias("clon_"), bucket(lat).alias("by_"), bucket(lon).alias("bx_"))
    met = p.join(c, ["by_", "bx_"]).select(key, F.struct(haversine_km(F.col("plat_"), F.col("plon_"), F.col("clat_"), F.col("clon_")).alias("km"), F.col(cell).alias("cell")).alias("m_"))
    best = met.groupBy(key).agg(F.min("m_").alias("m_"))
    return best.select(key, F.col("m_.cell").alias(cell), F.col("m_.km").alias("distance_km"))


def idw(neighbours: DataFrame, value: str, by: Sequence[str], power: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Inverse-distance prediction for each i; neighbours at distance 0 alone decide, averaged."""
    exact = F.avg(F.when(F.col("d") <= 1e-12, F.col(value)))
    w = 1 / F.pow(F.col("d") + eps, F.lit(power))
    return neighbours.groupBy(*by, "i").agg(F.coalesce(exact, F.sum(w * F.col(value)) / F.sum(w)).alias("predicted"))
