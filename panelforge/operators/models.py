"""Local predictors: aggregates where a formula allows, small numpy solves per group otherwise. Labels of the rows to predict are never read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import discard, materialize, partitions


def group_means(train: DataFrame, query: DataFrame, group: str, target: str, name: str = "predicted") -> DataFrame:
    """Mean of the group, else of all training rows."""
    means = train.groupBy(group).agg(F.avg(target).alias("g_"))
    whole = train.agg(F.avg(target).alias("a_"))
    return query.join(F.broadcast(means), group, "left").crossJoin(F.broadcast(whole)).withColumn(name, F.coalesce("g_", "a_")).drop("g_", "a_")


def shrunken_means(train: DataFrame, query: DataFrame, inner: str, outer: str, target: str, strength: float, name: str = "predicted") -> DataFrame:
    """(n inner mean + s outer mean) / (n + s); unknown groups fall back outward."""
    a = train.groupBy(outer, inner).agg(F.avg(target).alias("mi_"), F.count(target).alias("n_"))
    b = train.groupBy(outer).agg(F.avg(target).alias("mo_"))
    whole = train.agg(F.avg(target).alias("a_"))
    rows = query.join(a, [outer, inner], "left").join(b, outer, "left").crossJoin(F.broadcast(whole))
    base = F.coalesce("mo_", "a_")
    n = F.coalesce("n_", F.lit(0))
    return rows.withColumn(name, (n * F.coalesce("mi_", F.lit(0.0)) + strength * base) / (n + strength)).drop("mi_", "n_", "mo_", "a_")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median fill, then (x - mean) / population deviation over all rows (0 for a constant)."""
    row = df.agg(*(F.median(c).alias(c) for c in columns)).first()
    filled = df.withColumns({c: F.coalesce(c, F.lit(row[c])).cast("double") for c in columns})
    row = filled.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    return filled.withColumns({c: F.when(F.lit(row[f"s_{c}"]) > 0, (F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"]).otherwise(F.lit(0.0)) for c in columns})


def ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, q: np.ndarray, alpha: float):
    """Weighted ridge with an unpenalised intercept, evaluated at q (a point or several); the weights count as they are."""
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - mx, y - my
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + alpha * np.eye(x.shape[1]), (xc * w[:, None]).T @ yc)
    return my + (q - mx) @ beta


def local_ridge(x: np.ndarray, y: np.ndarray, d: np.ndarray, q: np.ndarray, alpha: float = 30.0, power: float = 1.0) -> float:
    """Ridge on the neighbours with weights 1 / (d + 1e-6)^power; under 3 neighbours their mean."""
    ok = np.isfinite(d) & np.isfinite(y)
    if ok.sum() < 3:
        return float(y[ok].mean()) if ok.any() else float("nan")
    return ridge(x[ok], y[ok], 1.0 / (d[ok] + 1e-6) ** power, q, alpha)


def mixed_ridge(x, y, d, q, alpha: float = 30.0, power: float = 1.0) -> float:
    """As local_ridge with weights 1 / (1 + d)."""
    ok = np.isfinite(d) & np.isfinite(y)
    return float(y[ok].mean()) if ok.sum() < 3 else ridge(x[ok], y[ok], 1.0 / (1.0 + d[ok]) ** power, q, alpha)


def huber_ridge(x, y, d, q, alpha: float = 30.0, power: float = 1.0, delta: float = 1.345, rounds: int = 10) -> float:
    """Local ridge reweighted by Huber's function of the residuals over their scaled median deviation."""
    ok = np.isfinite(d) & np.isfinite(y)
    if ok.sum() < 3:
        return float(y[ok].mean()) if ok.any() else float("nan")
    x, y, base = x[ok], y[ok], 1.0 / (d[ok] + 1e-6) ** power
    w = base / base.mean()
    for _ in range(rounds):
        fit = ridge(x, y, w, x, alpha)
        e = y - fit
        scale = 1.4826 * np.median(np.abs(e - np.median(e)))
        if scale <= 1e-12:
            break
        new = base * np.minimum(1.0, delta * scale / np.maximum(np.abs(e), 1e-12))
        w = new / new.mean()
    return ridge(x, y, w, q, alpha)


def elastic_net(x, y, d, q, alpha: float = 0.1, power: float = 1.0, mix: float = 0.5, rounds: int = 200) -> float:
    """Weighted elastic net by coordinate descent, evaluated at q."""
    ok = np.isfinite(d) & np.isfinite(y)
    if ok.sum() < 3:
        return float(y[ok].mean()) if ok.any() else float("nan")
    x, y, w = x[ok], y[ok], 1.0 / (d[ok] + 1e-6) ** power
    w = w / w.sum()
    mx, my = w @ x, w @ y
    xc, e = x - mx, y - my
    beta, scale = np.zeros(x.shape[1]), (w[:, None] * xc * xc).sum(axis=0)
    for _ in range(rounds):
        old = beta.copy()
        for j in np.flatnonzero(scale > 1e-12):
            rho = w @ (xc[:, j] * e) + scale[j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha * mix, 0) / (scale[j] + alpha * (1 - mix))
            e = e - xc[:, j] * (new - beta[j])
            beta[j] = new
        if np.abs(beta - old).max() < 1e-10:
            break
    return float(my + (q - mx) @ beta)


def arm_ridge(x, y, d, q, alpha: float = 30.0, power: float = 1.0, arm: str = "normalized") -> float:
    """Local ridge with weights that sum to the number of neighbours, in one of four arms.

    normalized: as it is. adaptive: the penalty grows by k over the effective number of neighbours. shrunk: as adaptive, the
    prediction drawn to the local mean as the weights concentrate. robust: three reweightings by the residuals.
    """
    ok = np.isfinite(d) & np.isfinite(y)
    if ok.sum() < 3:
        return float(y[ok].mean()) if ok.any() else float("nan")
    x, y, raw = x[ok], y[ok], 1.0 / (d[ok] + 1e-6) ** power
    k = len(y)
    w, effective = raw * k / raw.sum(), raw.sum() ** 2 / (raw @ raw)
    if arm == "robust":
        base = w
        for _ in range(3):
            e = y - ridge(x, y, w, x, alpha)
            scale = max(1.4826 * np.median(np.abs(e - np.median(e))), 0.15 * y.std(), 1e-6)
            w = base * np.minimum(1.0, 1.35 * scale / np.maximum(np.abs(e), 1e-12))
            w = w * k / w.sum()
    out = float(ridge(x, y, w, q, alpha * k / effective if arm in ("adaptive", "shrunk") else alpha))
    share = min(1.0, effective / k) if arm == "shrunk" else 1.0
    return share * out + (1 - share) * float(np.average(y, weights=w))


def gather(neighbours: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each (by, i): its neighbours' d, y and x (flat) nearest first, and its own q. The groups have at most k rows."""
    cell = F.struct(F.col("d").isNull().alias("u"), "d", "j", F.col("y").cast("double").alias("y"), "x")
    dealt = neighbours.repartition(partitions(neighbours.sparkSession), *by, "i")  # solves cost more than their few bytes tell
    rows = dealt.groupBy(*by, "i").agg(F.array_sort(F.collect_list(cell)).alias("c_"), F.first("q").alias("q"))
    return rows.select(*by, "i", F.col("c_.d").alias("d"), F.col("c_.y").alias("y"), F.flatten("c_.x").alias("x"), "q")


def solved(batch: pa.RecordBatch, solve: Callable[..., float]):
    """Yields solve(x, y, d, q) of each row of a batch of gather()."""
    parts = {}
    for c in ("d", "y", "x", "q"):
        column = batch.column(c)
        parts[c] = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float)
    for n in range(batch.num_rows):
        d, y, x, q = (values[at[n] : at[n + 1]] for at, values in parts.values())
        yield solve(x.reshape(len(d), -1), y, d, q)


def predict_local(neighbours: DataFrame, by: Sequence[str], solve: Callable = local_ridge, **options) -> DataFrame:
    """One solve per (by, i) over rows (x: features of j, y, d, q: features of i), many of them in a batch."""
    keys = [*by, "i"]
    rows = gather(neighbours, by)

    def predict(batches):
        for batch in batches:
            found = pa.array(list(solved(batch, lambda *a: solve(*a, **options))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), found], names=[*keys, "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(predict, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "predicted double"]))


#: Nodes and edges of a graph that a task may hold: some 100 bytes each with the copies that come and go.
HELD = 5_000_000


def laplacian(edges: DataFrame, labels: DataFrame, by: Sequence[str], key: str, target: str, penalty: float = 2.0, limit: int = 5000, held: int | None = None, rounds: int | None = None) -> DataFrame:
    """Graph-Laplacian regression (M + penalty L + 1e-8 I) f = M (y - mean) of each group.

    edges: by, i, j, w both ways; labels: by, key and the target, NULL where it is to be predicted. Groups whose nodes and edges
    are at most `held` together, HELD by default, are solved in a task: up to `limit` nodes densely, others by conjugate gradients
    over their edges. Larger ones share conjugate gradients over the edge table. A `limit` alone is the bound of both.

    With `rounds` the result is Jacobi's iteration after so many rounds, as SQL has it: nodes that hang on others by tiny weights
    may still be far from the solution then.
    """
    held = (HELD if limit >= 5000 else limit) if held is None else held
    edges = materialize(edges.select(*by, "i", "j", "w"), "edges")
    counts = labels.select(*by, F.lit(1).alias("n_")).unionByName(edges.select(*by, F.lit(1).alias("n_")))
    large = counts.groupBy(*by).agg(F.count("*").alias("size_")).where(F.col("size_") > held).drop("size_")
    large = materialize(large, "large")  # a row a group
    if not large.limit(1).count():
        return held_laplacian(edges, labels, by, key, target, penalty, limit, rounds)
    part = lambda df, how: df.join(large, list(by), how)
    small = held_laplacian(part(edges, "left_anti"), part(labels, "left_anti"), by, key, target, penalty, limit, rounds)
    few = part(edges, "left_semi"), part(labels, "left_semi"), by, key, target, penalty
    return small.unionByName(sparse_laplacian(*few) if rounds is None else sparse_jacobi(*few, rounds))


def sparse_laplacian(edges: DataFrame, labels: DataFrame, by: Sequence[str], key: str, target: str, penalty: float, tolerance: float = 1e-11, rounds: int = 500) -> DataFrame:
    """laplacian() by conjugate gradients with the diagonal as preconditioner: a round is one join of the edges with the state.

    The state has a row a node and is written to the shared folder each round; the scalars of a group are sums over it.
    """
    keys, node = list(by), [*by, key]
    edges = edges.select(*keys, "i", "j", "w").join(labels.select(*keys, F.col(key).alias("i")), [*keys, "i"], "left_semi").join(labels.select(*keys, F.col(key).alias("j")), [*keys, "j"], "left_semi")
    edges = materialize(edges, "edges")
    degree = edges.groupBy(*keys, F.col("i").alias(key)).agg(F.sum("w").alias("deg"))
    means = labels.groupBy(*keys).agg(F.avg(target).alias("mean"))
    state = labels.select(*node, target).join(degree, node, "left").join(means, keys)
    known = F.col(target).isNotNull()
    state = state.withColumn("deg", F.coalesce("deg", F.lit(0.0))).withColumn("known", known.cast("double")).withColumn("diag", F.col("known") + penalty * F.col("deg") + 1e-8)
    state = state.select(*node, "mean", "known", "deg", "diag", F.lit(0.0).alias("f"), F.coalesce(F.col(target) - F.col("mean"), F.lit(0.0)).alias("r"))
    state = materialize(state.withColumn("p", F.col("r") / F.col("diag")), "state")
    first = materialize(state.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("first_")), "first")
    for _ in range(rounds):
        held = state
        pulled = edges.join(state.select(*keys, F.col(key).alias("j"), F.col("p").alias("pj")), [*keys, "j"]).groupBy(*keys, F.col("i").alias(key)).agg(F.sum(F.col("w") * F.col("pj")).alias("pull"))
        image = F.col("diag") * F.col("p") - penalty * F.coalesce("pull", F.lit(0.0))
        step = materialize(state.join(pulled, node, "left").withColumn("image", image).drop("pull"), "step")
        sums = step.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("rz"), F.sum(F.col("p") * F.col("image")).alias("pq"))
        a = F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(F.lit(0.0))
        moved = step.join(sums, keys).withColumn("f", F.col("f") + a * F.col("p")).withColumn("r", F.col("r") - a * F.col("image"))
        new = moved.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("new_"))
        turned = moved.join(new, keys).withColumn("p", F.col("r") / F.col("diag") + F.when(F.col("rz") > 0, F.col("new_") / F.col("rz")).otherwise(F.lit(0.0)) * F.col("p"))
        state = materialize(turned.select(*node, "mean", "known", "deg", "diag", "f", "r", "p"), "state")
        discard(held)
        discard(step)
        left = state.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("left_")).join(first, keys)
        if not left.where(F.col("left_") > tolerance**2 * F.col("first_")).limit(1).count():
            break
    return state.select(*node, (F.col("mean") + F.col("f")).alias("predicted"))


def sparse_jacobi(edges: DataFrame, labels: DataFrame, by: Sequence[str], key: str, target: str, penalty: float, rounds: int) -> DataFrame:
    """laplacian() after `rounds` of Jacobi's iteration; a round joins the edges with the state and is written to the shared folder."""
    keys, node = list(by), [*by, key]
    edges = materialize(edges.select(*keys, "i", "j", "w"), "edges")
    means = labels.groupBy(*keys).agg(F.avg(target).alias("mean"))
    degree = edges.groupBy(*keys, F.col("i").alias(key)).agg(F.sum("w").alias("deg"))
    known = F.col(target).isNotNull().cast("double")
    state = labels.select(*node, target).join(degree, node, "left").join(means, keys)
    state = state.select(*node, "mean", F.coalesce(F.col(target) - F.col("mean"), F.lit(0.0)).alias("b"), (known + penalty * F.coalesce("deg", F.lit(0.0)) + 1e-8).alias("diag"))
    state = materialize(state.withColumn("f", F.col("b") / F.col("diag")), "state")
    for _ in range(rounds):
        held = state
        pulled = edges.join(state.select(*keys, F.col(key).alias("j"), "f"), [*keys, "j"]).groupBy(*keys, F.col("i").alias(key)).agg(F.sum(F.col("w") * F.col("f")).alias("pull"))
        moved = (F.col("b") + penalty * F.coalesce("pull", F.lit(0.0))) / F.col("diag")
        state = materialize(state.join(pulled, node, "left").select(*node, "mean", "b", "diag", moved.alias("f")), "state")
        discard(held)
    return state.select(*node, (F.col("mean") + F.col("f")).alias("predicted"))


def jacobi(i: np.ndarray, j: np.ndarray, w: np.ndarray, known: np.ndarray, b: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """The system of gradients() after `rounds` of Jacobi's iteration from b over the diagonal."""
    n = len(b)
    order = np.argsort(i, kind="stable")
    i, j, w = i[order], j[order], w[order]
    diag = known + penalty * np.bincount(i, w, n) + 1e-8
    f = b / diag
    for _ in range(rounds):
        last, f = f, (b + penalty * np.bincount(i, w * f[j], n)) / diag
        if np.array_equal(last, f):  # nothing moves any more
            break
    return f


def gradients(i: np.ndarray, j: np.ndarray, w: np.ndarray, known: np.ndarray, b: np.ndarray, penalty: float, tolerance: float = 1e-13) -> np.ndarray:
    """Solves (M + penalty L + 1e-8 I) f = b over directed edges i, j, w by conjugate gradients with the diagonal as preconditioner."""
    n = len(b)
    diag = known + penalty * np.bincount(i, w, n) + 1e-8
    f, r = np.zeros(n), b.copy()
    p = z = r / diag
    rz = first = r @ z
    for _ in range(20 * n):
        if rz <= tolerance**2 * first:
            break
        image = diag * p - penalty * np.bincount(i, w * p[j], n)
        a = rz / (p @ image)
        f, r = f + a * p, r - a * image
        z = r / diag
        rz, old = r @ z, rz
        p = z + rz / old * p
    return f


def held_laplacian(edges: DataFrame, labels: DataFrame, by: Sequence[str], key: str, target: str, penalty: float, limit: int, rounds: int | None = None) -> DataFrame:
    """laplacian() of groups that fit a task: dense up to `limit` nodes, sparse beyond; or `rounds` of Jacobi's iteration."""
    keys = list(by)

    def solve(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(key)
        nodes = v[key].to_numpy()
        i, j = (np.minimum(np.searchsorted(nodes, e[c].to_numpy()), len(nodes) - 1) for c in ("i", "j"))
        inside = (nodes[i] == e["i"].to_numpy()) & (nodes[j] == e["j"].to_numpy())
        y = v[target].to_numpy(float)
        known = np.isfinite(y)
        mean = y[known].mean() if known.any() else float("nan")
        given = e["w"].to_numpy(float)[inside]
        if len(v) > limit or rounds is not None:
            system = i[inside], j[inside], given, known.astype(float), np.where(known, y - mean, 0.0), penalty
            f = mean + (gradients(*system) if rounds is None else jacobi(*system, rounds))
            return pd.DataFrame({**{k: [v[k].iloc[0]] * len(v) for k in keys}, key: nodes, "predicted": f})
        w = np.zeros((len(v), len(v)))
        w[i[inside], j[inside]] = given
        a = np.diag(known.astype(float)) + penalty * (np.diag(w.sum(axis=1)) - w) + 1e-8 * np.eye(len(v))
        f = mean + np.linalg.solve(a, np.where(known, y - mean, 0.0))
        return pd.DataFrame({**{k: [v[k].iloc[0]] * len(v) for k in keys}, key: nodes, "predicted": f})

    kinds = {f.name: f.dataType.simpleString() for f in labels.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{key} {kinds[key]}", "predicted double"])
    return edges.groupBy(*keys).cogroup(labels.groupBy(*keys)).applyInPandas(lambda e, v: solve(e, v) if len(v) else v[[*keys, key]].assign(predicted=0.0), schema)


def linear(columns: Sequence[str], means: Sequence[float], beta: Sequence[float], intercept: float):
    """intercept + sum of beta (column - mean) as an expression."""
    return sum(((F.col(c) - F.lit(float(m))) * F.lit(float(b)) for c, m, b in zip(columns, means, beta, strict=True)), F.lit(float(intercept)))


def global_ridge(df: DataFrame, columns: Sequence[str], target: str, alpha: float, name: str = "predicted") -> DataFrame:
    """Ridge with a free intercept from the rows with a target, for all rows; only the cross products go to the driver."""
    from panelforge.operators.stats import gram

    n, m, c = gram(df.where(F.col(target).isNotNull()), [*columns, target])
    k = len(columns)
    beta = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k]) if n else np.zeros(k)
    return df.withColumn(name, linear(columns, m[:k], beta, m[k]))


def pls_weights(c: np.ndarray, components: int) -> np.ndarray:
    """Coefficients of partial least squares of the last column on the others, from their cross products, by deflation."""
    k = len(c) - 1
    s, x = c[:k, k].copy(), c[:k, :k].copy()
    w_all, p_all, q_all = [], [], []
    for _ in range(min(components, k)):
        size = np.linalg.norm(s)
        if size <= 1e-14:
            break
        w = s / size
        t = w @ x @ w
        p, q = x @ w / t, s @ w / t
        s, x = s - t * q * p, x - t * np.outer(p, p)
        w_all, p_all, q_all = [*w_all, w], [*p_all, p], [*q_all, q]
    if not w_all:
        return np.zeros(k)
    w, p = np.array(w_all).T, np.array(p_all).T
    return w @ np.linalg.solve(p.T @ w, np.array(q_all))


def global_pls(df: DataFrame, columns: Sequence[str], target: str, components: int, name: str = "predicted") -> DataFrame:
    """Partial least squares (columns as they are) from the rows with a target, for all rows."""
    from panelforge.operators.stats import gram

    _, m, c = gram(df.where(F.col(target).isNotNull()), [*columns, target])
    return df.withColumn(name, linear(columns, m[:-1], pls_weights(c, components), m[-1]))


def pls_anchor(df: DataFrame, columns: Sequence[str], target: str, fold: str, folds: int, components: int) -> DataFrame:
    """df with `anchor`, the fit of all labelled rows, and `residual`, the target less a fit without the row's own fold."""
    from panelforge.operators.stats import gram

    out = global_pls(df, columns, target, components, "anchor").withColumn("residual", F.lit(None).cast("double"))
    for f in range(folds):  # a bounded number of small fits
        _, m, c = gram(df.where(F.col(target).isNotNull() & (F.col(fold) != f)), [*columns, target])
        away = linear(columns, m[:-1], pls_weights(c, components), m[-1])
        out = out.withColumn("residual", F.when(F.col(fold) == f, F.col(target) - away).otherwise(F.col("residual")))
    return out


def pca(df: DataFrame, key: str, columns: Sequence[str], components: int) -> DataFrame:
    """Scores of standardised columns on their leading components: the k x k covariance goes to the driver, rows stay."""
    from panelforge.operators.stats import gram

    z = standardize(df.select(key, *columns), columns)
    n, _, c = gram(z, columns)
    values, vectors = np.linalg.eigh(c / max(1, n))
    order = np.argsort(values)[::-1][:components]
    out = []
    for p, o in enumerate(order, 1):
        v = vectors[:, o] * np.sign(vectors[np.argmax(np.abs(vectors[:, o])), o])
        score = F.lit(0.0)
        for c_, x in zip(columns, v, strict=True):
            score = score + F.col(c_) * F.lit(float(x))
        out.append(score.alias(f"pc{p:02d}"))
    return z.select(key, *out)


def dtw(a: Sequence[float], b: Sequence[float]) -> float:
    """Dynamic time warping with absolute costs over the longer length."""
    n, m = len(a), len(b)
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(n):
        new = np.full(m + 1, np.inf)
        for j in range(m):
            new[j + 1] = abs(a[i] - b[j]) + min(row[j], row[j + 1], new[j])
        row = new
    return float(row[m] / max(n, m))


def dtw_distance(a: str, b: str):
    @F.pandas_udf("double")
    def warp(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([dtw(p, q) if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(x, y, strict=True)], dtype="float64")

    return warp(F.col(a), F.col(b))


def z_curve(values: Sequence[float | None], least: int) -> np.ndarray | None:
    """Linear interpolation through the values that are there (ends held), standardised; None under `least` or without spread."""
    y = np.array([np.nan if v is None else v for v in values], float)
    ok = np.isfinite(y)
    if ok.sum() < least:
        return None
    y = np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok])
    return None if y.std() <= 1e-12 else (y - y.mean()) / y.std()


def interpolated_z(column: str, least: int = 3):
    @F.pandas_udf("array<double>")
    def curve(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else (None if (z := z_curve(v, least)) is None else z.tolist()) for v in x])

    return curve(F.col(column))


def mine_expressions(df: DataFrame, target: str, columns: Sequence[str], primitives: int = 6, top: int = 10) -> DataFrame:
    """Pairwise expressions of the columns best rank-correlated with the target, ranked; ties by operation, left, right.

    Primitives are ranked by |Spearman|; then all expressions over their pairs are made in one projection and screened in long form.
    """
    from panelforge.functions.expressions import pair_expressions
    from panelforge.operators.stats import correlation_screen

    first = correlation_screen(df, target, columns, "spearman").orderBy(F.abs("r").desc_nulls_last(), "feature").limit(primitives)
    chosen = [r["feature"] for r in first.select("feature").collect()]
    made = {f"{op}|{a}|{b}": e for i, a in enumerate(chosen) for b in chosen[i + 1 :] for op, e in pair_expressions(a, b).items()}
    wide = df.select(F.col(target).alias("target_"), *(e.alias(n) for n, e in made.items()))
    scored = correlation_screen(wide, "target_", list(made), "spearman")
    parts = F.split("feature", r"\|")
    out = scored.select(parts[0].alias("operation"), parts[1].alias("left"), parts[2].alias("right"), "r")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.abs("r"), 12).desc_nulls_last(), "operation", "left", "right"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def round_robin(catalog: DataFrame, family: str, order: Sequence, k: int) -> DataFrame:
    """k items, one of each family in turn."""
    ranked = catalog.withColumn("turn", F.row_number().over(Window.partitionBy(family).orderBy(*order)))
    return ranked.orderBy("turn", family).limit(k)
