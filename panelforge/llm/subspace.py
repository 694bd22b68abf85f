"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. A seeded random rotation spreads that distance over the
coordinates; the rotated vectors are split into blocks of BLOCK_DIMS and each block gets its proportional share of the budget.
By pigeonhole a linked pair is within budget in at least one block, so the union of the blocks' range joins holds every link; it
is verified with the unrotated vectors in double precision.

Equal vectors collapse first. The distinct ones are dealt to tiles by median splits fitted on a bounded sample (and by a hash where
the sample tells no more), written to the shared folder once. A task takes one tile with a share of the others, leaving out those
whose boxes are apart by more than the budget in every block. Within a pair of tiles each block is sorted by one projection, and a
strip of rows meets only the rows whose projections lie within the square root of the budget. A tile pair reports link counts and a
spanning forest, never pairs.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import files
from panelforge.llm.components import components, forest
from panelforge.session import materialize, partitions, scratch, ship

BLOCK_DIMS = 16
TILE_ROWS = 4096
SAMPLE_ROWS = 20_000
LEAF_ROWS = 8  # of the sample to a tile at least
STRIP = 256
SLACK = 1e-4  # of squared distances in single precision


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Splits:
    """Median splits, one coordinate a level, as many levels as the tiles need; dimension by dimension of the vectors."""

    def __init__(self, x: np.ndarray, levels: int):
        self.levels = levels
        self.cuts: list[tuple[int, np.ndarray]] = []
        tile = np.zeros(len(x), np.int64)
        for level in range(levels):
            spread = np.zeros(x.shape[1])
            for t in np.unique(tile):
                spread += x[tile == t].var(axis=0) * (tile == t).sum()
            axis = int(np.argmax(spread))
            cut = np.zeros(1 << level)
            for t in np.unique(tile):
                cut[t] = np.median(x[tile == t, axis])
            self.cuts.append((axis, cut))
            tile = tile * 2 + (x[:, axis] > cut[tile])

    def tiles(self, x: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(x), np.int64)
        for axis, cut in self.cuts:
            tile = tile * 2 + (x[:, axis] > cut[tile])
        return tile


def block_slices(dim: int) -> list[slice]:
    return [slice(a, min(dim, a + BLOCK_DIMS)) for a in range(0, dim, BLOCK_DIMS)]


def apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, budget: float) -> np.ndarray:
    """For many boxes: whether each is out of reach of one box in every block."""
    dim = low.shape[1]
    gap = np.maximum(0, np.maximum(low - other_high, other_low - high)) ** 2
    return np.all([gap[:, s].sum(axis=1) > budget * (s.stop - s.start) / dim + SLACK for s in block_slices(dim)], axis=0)


def linked(x: np.ndarray, y: np.ndarray, rotated_x: np.ndarray, rotated_y: np.ndarray, cosine: float, tally: list[int] | None = None):
    """Yields (rows of x, rows of y) with cosine at least `cosine`, strip by strip; tally[0] counts the compared pairs of blocks."""
    dim, budget = x.shape[1], 2 - 2 * cosine
    blocks = []
    for s in block_slices(dim):
        p, q = rotated_x[:, s], rotated_y[:, s]
        axis = int(np.argmax(p.var(axis=0) + q.var(axis=0)))
        order = np.argsort(q[:, axis], kind="stable")
        share = budget * (s.stop - s.start) / dim + SLACK
        blocks.append((p, np.square(p).sum(axis=1), p[:, axis], q[order], np.square(q[order]).sum(axis=1), q[order, axis], order, share))
    rows = np.argsort(blocks[0][2], kind="stable")
    for a in range(0, len(x), STRIP):
        strip = rows[a : a + STRIP]
        near = np.zeros((len(strip), len(y)), bool)
        for p, pp, along, q, qq, places, order, share in blocks:
            reach = np.sqrt(share) + SLACK
            low, high = np.searchsorted(places, [along[strip].min() - reach, along[strip].max() + reach])
            if low == high:
                continue
            distance = p[strip] @ q[low:high].T
            distance *= -2
            distance += pp[strip, None]
            distance += qq[low:high]
            i, j = np.nonzero(distance <= share)
            near[i, order[low + j]] = True
            if tally is not None:
                tally[0] += distance.size
        i, j = np.nonzero(near)
        if len(i) > near.size // 16:
            exact = (x[strip] @ y.T)[i, j]
        else:
            exact = np.concatenate([np.einsum("nd,nd->n", x[strip[i[b : b + 65536]]], y[j[b : b + 65536]]) for b in range(0, len(i), 65536)] or [np.zeros(0)])
        keep = exact >= cosine
        yield strip[i[keep]], j[keep]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Vectors link at a cosine of at least `cosine` (over 0), with vectors of their own length only. A vector that is null, empty or
    zero, holds a null or non-finite component, or has no id links with nothing and is its own component. Repeated rows count
    as vectors of their own; rows that share an id share its component. Extra columns are ignored. An empty table gives an empty
    result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    spark = ship(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = np.dtype("<f4" if single else "<f8")

    def raw(batches):
        for batch in batches:
            keys = []
            for v, i in zip(batch.column("v").to_pylist(), batch.column("id").to_pylist(), strict=True):
                x = np.array(v, kind) if v and i is not None and None not in v else np.zeros(0, kind)
                x = x + kind.type(0)  # one zero
                keys.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], names=["id", "key"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = materialize(source.mapInArrow(raw, "id long, key binary"), "vectors")
    distinct = materialize(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "distinct")
    by_dim = {r["d"]: r["n"] for r in distinct.groupBy((F.octet_length("key") / kind.itemsize).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}
    splits = {}
    for dim, n in by_dim.items():
        few = distinct.where(F.octet_length("key") == dim * kind.itemsize).orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS).select("key").collect()
        x = unit(np.stack([np.frombuffer(r["key"], kind) for r in few])) @ rotation(dim)
        levels = max(0, int(np.ceil(np.log2(min(n / TILE_ROWS, max(1, len(x) / LEAF_ROWS))))))
        splits[dim] = Splits(x, levels), -(-n // (TILE_ROWS << levels))
    shared = spark.sparkContext.broadcast(splits)
    folder = scratch(spark, "tiles")

    def place(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            out = np.zeros(len(keys), np.int64)
            size = np.array([len(k) // kind.itemsize for k in keys], np.int64)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                x = unit(np.stack([np.frombuffer(keys[i], kind) for i in at])) @ rotation(dim)
                fitted, salts = shared.value[dim]
                out[at] = fitted.tiles(x) * salts + np.array([zlib.crc32(keys[i]) % salts for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(out), *(batch.column(c) for c in ("key", "node", "copies"))], names=["dim", "tile", "key", "node", "copies"])

    def save(table: pa.Table) -> pa.Table:
        dim, tile = table.column("dim")[0].as_py(), table.column("tile")[0].as_py()
        x = np.stack([np.frombuffer(k, kind) for k in table.column("key").to_pylist()])
        r = unit(x) @ rotation(dim)
        path = files.fresh(folder, ".npz")
        with files.create(path) as out:
            np.savez(out, x=x, node=table.column("node").to_numpy(), copies=table.column("copies").to_numpy())
        return pa.table({"dim": [dim], "tile": [tile], "path": [path], "low": [r.min(axis=0)], "high": [r.max(axis=0)]})

    placed = distinct.mapInArrow(place, "dim long, tile long, key binary, node long, copies long")
    saved = placed.groupBy("dim", "tile").applyInArrow(lambda t: save(t), "dim long, tile long, path string, low array<double>, high array<double>")
    manifest = materialize(saved, "manifest")
    count = manifest.count()
    every = -(-4 * partitions(spark) // max(1, count))  # tasks to a tile, each with a share of the others
    where = manifest.inputFiles()

    def boxes(dim: int) -> list[tuple]:
        """(path, least and largest coordinates) of the tiles of one dimension, in a fixed order."""
        tables = []
        for path in where:
            with files.open_random(path) as f:
                tables.append(pq.read_table(f, columns=["dim", "path", "low", "high"], filters=[("dim", "=", dim)]))
        table = pa.concat_tables(tables).sort_by("path")
        return table.column("path").to_pylist(), *(np.array(table.column(c).to_pylist()) for c in ("low", "high"))

    def load(path: str):
        with files.open_random(path) as f, np.load(pa.PythonFile(f) if not hasattr(f, "seek") else f) as z:
            x, node, copies = z["x"], z["node"], z["copies"]
        x = unit(x)
        return x, (x @ rotation(x.shape[1])).astype(np.float32), node, copies

    known: dict[int, tuple] = {}

    def partners(dim: int, path: str, share: int) -> list[str]:
        """The tiles up to this one that a pair may link to, of one share."""
        if dim not in known:
            known[dim] = boxes(dim)
        paths, low, high = known[dim]
        a = bisect.bisect_left(paths, path)
        far = apart(low[: a + 1], high[: a + 1], low[a], high[a], 2 - 2 * cosine)
        return [paths[b] for b in np.flatnonzero(~far) if b % every == share]

    def join(batches):
        for batch in batches:
            for dim, one, share in zip(*(batch.column(c).to_pylist() for c in ("dim", "path", "share")), strict=True):
                tile = load(one)
                for other in partners(dim, one, share):
                    x, rx, node, copies = tile
                    y, ry, node_y, copies_y = tile if one == other else load(other)
                    count, count_y, links = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
                    for i, j in linked(x, y, rx, ry, cosine):
                        if one == other:
                            i, j = i[i < j], j[i < j]
                        np.add.at(count, i, copies_y[j])
                        np.add.at(count_y, j, copies[i])
                        if len(i):
                            links.append(forest(node[i], node_y[j]))
                    total: dict[int, int] = {}
                    for nodes, counts in ((node, count), (node_y, count_y)):
                        for k in np.flatnonzero(counts).tolist():
                            total[int(nodes[k])] = total.get(int(nodes[k]), 0) + int(counts[k])
                    a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True))) if links else (np.zeros(0, np.int64),) * 2
                    ids = np.concatenate([np.fromiter(total, np.int64, len(total)), a])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.fromiter(total.values(), np.int64, len(total)), b])), pa.array(np.arange(len(ids)) >= len(total))], names=["a", "b", "link"])

    units = manifest.select("dim", "path", F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias("share"))
    units = units.repartition(max(1, min(count * every, 4 * partitions(spark))), F.xxhash64("path", "share"))
    found = materialize(units.mapInArrow(join, "a long, b long, link boolean"), "links")
    counts = found.where("not link").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    roots = components(found.where("link").select("a", "b"))
    classes = distinct.join(counts, "node", "left").join(roots, "node", "left")
    classes = classes.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.where("key is not null").join(classes, "key").select("id", "n_links", "component_id")
    lone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(lone).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
