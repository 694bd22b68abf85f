"""Builders of SQL for an independent engine: hashes, ridge systems, graph solves, eigenvectors and time warping in plain SQL."""

from __future__ import annotations


def hash_sql(parts: str) -> str:
    """The engine's stable hash of comma-separated SQL parts."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 15) AS BIGINT)"


def eliminate(name: str, size: int) -> str:
    """CTEs {name}_1 .. {name}_size: Gauss-Jordan steps over (g, m), m an augmented matrix as a list of rows, from {name}_0."""
    step = "SELECT g, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda x: x / r[{k}]) ELSE list_transform(r, lambda x, c: x - r[{k}] * m[{k}][c] / m[{k}][{k}]) END) AS m FROM {name}_{p}"
    return ", ".join(f"{name}_{k} AS ({step.format(k=k, p=k - 1, name=name)})" for k in range(1, size + 1))


def ridge_sql(size: int = 5, nb: str = "nb", out: str = "sol") -> str:
    """CTEs up to {out}(g, predicted, mean_y) from {nb}(g, j, w, x, y, q, alpha): weighted ridge at q, the mean under 3 rows."""
    return f"""{out}c AS (SELECT g, sum(w) AS sw, sum(w * y) / sum(w) AS my, avg(y) AS ay, count(*) AS n, any_value(q) AS q, any_value(alpha) AS alpha FROM {nb} GROUP BY g),
 {out}x AS (SELECT g, j, w, y, a, x[a] AS v FROM {nb}, range(1, {size + 1}) t(a)), {out}m AS (SELECT g, a, sum(w * v) / sum(w) AS m FROM {out}x GROUP BY g, a),
 {out}v AS (SELECT x.g, x.j, x.w, x.a, x.v - m.m AS v, x.y - c.my AS y FROM {out}x x JOIN {out}m m ON x.g = m.g AND x.a = m.a JOIN {out}c c ON x.g = c.g),
 {out}p AS (SELECT p.g, p.a, s.a AS b, sum(p.w * p.v * s.v) AS c FROM {out}v p JOIN {out}v s ON p.g = s.g AND p.j = s.j GROUP BY ALL UNION ALL SELECT g, a, {size + 1}, sum(w * v * y) FROM {out}v GROUP BY g, a),
 {out}r AS (SELECT g, a, list(p.c + CASE WHEN p.a = p.b THEN c.alpha ELSE 0 END ORDER BY p.b) AS r FROM {out}p p JOIN {out}c c USING (g) GROUP BY g, a),
 {out}_0 AS (SELECT g, list(r ORDER BY a) AS m FROM {out}r GROUP BY g), {eliminate(out, size)},
 {out}b AS (SELECT g, a, m[a][{size + 1}] AS beta FROM {out}_{size}, range(1, {size + 1}) t(a)),
 {out} AS (SELECT c.g, any_value(c.my) AS mean_y, CASE WHEN any_value(c.n) < 3 THEN any_value(c.ay) ELSE any_value(c.my) + sum(b.beta * (c.q[b.a] - m.m)) END AS predicted FROM {out}c c JOIN {out}b b ON c.g = b.g JOIN {out}m m ON c.g = m.g AND b.a = m.a GROUP BY c.g)"""


def laplacian_sql(rounds: int = 1500, penalty: float = 2.0, out: str = "lap") -> str:
    """CTEs up to {out}(label, id, f) from le(label, i, j, w) and ln(label, id, y): Jacobi's iteration of the smoothing system.

    The engine must allow USING KEY or plain recursion; each round holds one row a node.
    """
    return f"""{out}d AS (SELECT ln.label, ln.id, (y IS NOT NULL)::INT AS known, coalesce(y - avg(y) OVER (PARTITION BY label), 0) AS b, avg(y) OVER (PARTITION BY label) AS mean FROM ln),
 {out}g AS (SELECT d.*, known + {penalty} * coalesce((SELECT sum(w) FROM le WHERE le.label = d.label AND le.i = d.id), 0) + 1e-8 AS diag FROM {out}d d),
 {out}f(n, label, id, f) AS (SELECT 0, label, id, CAST(b / diag AS DOUBLE) FROM {out}g UNION ALL
  SELECT s.n, g.label, g.id, (g.b + {penalty} * coalesce(s.pull, 0)) / g.diag FROM {out}g g JOIN (SELECT max(f.n) + 1 AS n, u.label, u.id, sum(le.w * f.f) AS pull FROM {out}g u LEFT JOIN le ON le.label = u.label AND le.i = u.id LEFT JOIN {out}f f ON f.label = le.label AND f.id = le.j GROUP BY u.label, u.id) s ON s.label = g.label AND s.id = g.id WHERE s.n <= {rounds}),
 {out} AS (SELECT f.label, f.id, g.mean + f.f AS f FROM {out}f f JOIN {out}g g ON f.label = g.label AND f.id = g.id WHERE f.n = {rounds})"""


def product(a: str, b: str, size: int) -> str:
    idx = ", ".join(map(str, range(1, size + 1)))
    return f"list_transform({a}, lambda r: list_transform([{idx}], lambda c: list_sum(list_transform([{idx}], lambda k: r[k] * {b}[k][c]))))"


def leading_sql(source: str, size: int, out: str, squarings: int = 40) -> str:
    """CTEs up to {out}(v, l): the leading eigenvector (its largest entry positive) and eigenvalue of the matrix m of {source}."""
    idx = ", ".join(map(str, range(1, size + 1)))
    trace = f"list_sum(list_transform([{idx}], lambda k: m[k][k]))"
    scaled = f"list_transform(m, lambda r: list_transform(r, lambda x: x / {trace}))"
    parts, last = [f"{out}0 AS (SELECT m FROM {source})"], f"{out}0"
    for n in range(1, squarings + 1):
        parts.append(f"{out}{n} AS MATERIALIZED (SELECT {product('m', 'm', size)} AS m FROM (SELECT {scaled} AS m FROM {last}))")
        last = f"{out}{n}"
    parts.append(f"{out}h AS (SELECT (SELECT arg_max(c, m[c][c]) FROM range(1, {size + 1}) t(c)) AS c, m FROM {last})")
    parts.append(f"{out}u AS (SELECT list_transform(m, lambda r: r[c]) AS u FROM {out}h)")
    parts.append(f"{out}w AS (SELECT list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda z: z * z)))) AS v FROM {out}u)")
    parts.append(f"{out}s AS (SELECT CASE WHEN list_max(v) >= -list_min(v) THEN v ELSE list_transform(v, lambda x: -x) END AS v FROM {out}w)")
    value = f"list_sum(list_transform([{idx}], lambda i: v[i] * list_sum(list_transform([{idx}], lambda k: m[i][k] * v[k]))))"
    parts.append(f"{out} AS (SELECT v, {value} AS l FROM {out}s, {source})")
    return ", ".join(parts)


def warp_sql(out: str = "dtw") -> str:
    """CTEs up to {out}(user_id, d) from zz(user_id, a, b), two equally long lists: time warping, a cell a round of recursion."""
    return f"""{out}r(user_id, a, b, n, c) AS (SELECT user_id, a, b, 0, CAST([] AS DOUBLE[]) FROM zz UNION ALL
  SELECT user_id, a, b, n + 1, list_append(c, abs(a[n // len(b) + 1] - b[n % len(b) + 1]) + CASE WHEN n = 0 THEN 0 ELSE least(CASE WHEN n % len(b) > 0 THEN c[n] END, CASE WHEN n >= len(b) THEN c[n - len(b) + 1] END, CASE WHEN n >= len(b) AND n % len(b) > 0 THEN c[n - len(b)] END) END)
  FROM {out}r WHERE n < len(a) * len(b)), {out} AS (SELECT user_id, c[n] / greatest(len(a), len(b)) AS d FROM {out}r WHERE n = len(a) * len(b))"""
