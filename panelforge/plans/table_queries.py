"""Queries over the relational tables: joins, yearly statistics, screens, neighbours, predictors, evaluation, contracts.

Stand-ins: entity = customer with municipality c_nationkey and state n_regionkey, target c_acctbal, held out where
c_custkey % 10 < 3; yearly statistics from lineitem and orders; predictions derived from events.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import expressions as X
from panelforge.operators import annual, cells, checks, contract, evaluate, models, neighbours, panel, splits, stats
from panelforge.plans.oracles import hash_sql, leading_sql, warp_sql
from panelforge.plans.panel_queries import EV, MONTHS, TR, events
from panelforge.plans.registry import query, table
from panelforge.streaming import windows

CU = """cu AS (SELECT c_custkey AS id, c_nationkey AS muni, n_regionkey AS state, c_acctbal AS y_all, c_mktsegment AS segment, c_custkey % 10 >= 3 AS train, CASE WHEN c_custkey % 10 >= 3 THEN c_acctbal END AS y,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal / 1000 + c_custkey % 17 END AS x1, CAST((c_custkey * 37) % 101 AS DOUBLE) AS x2, CASE WHEN c_custkey % 10 < 3 THEN c_custkey % 29 + 5 ELSE c_custkey % 29 END AS x3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        k.alias("id"), F.col("c_nationkey").alias("muni"), F.col("n_regionkey").alias("state"), F.col("c_acctbal").alias("y_all"), F.col("c_mktsegment").alias("segment"), (k % 10 >= 3).alias("train"), F.when(k % 10 >= 3, F.col("c_acctbal")).alias("y"),
        F.when(k % 6 != 0, F.col("c_acctbal") / 1000 + k % 17).alias("x1"), ((k * 37) % 101).cast("double").alias("x2"), (k % 29 + F.when(k % 10 < 3, 5).otherwise(0)).cast("double").alias("x3"),
    )


@query("l: id, s: n_name r_name", "SELECT c_custkey AS id, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def mtoone_join(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    one = checks.attach_missing(table(spark, d, "customer"), n, ["c_nationkey"])
    return checks.attach_missing(one, r, ["n_regionkey"]).withColumnRenamed("c_custkey", "id")


@query("l: id", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_coverage(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("l: id", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_membership(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"))


@query("l: l_orderkey l_linenumber, d: l_quantity o_totalprice", "SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '2000-06-01' AND o_orderstatus = 'F'")
def inner_join_pushdown(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'2000-06-01'").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.join(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("l: a b, d: gap", f"WITH {CU} SELECT a.id AS a, b.id AS b, abs(a.y_all - b.y_all) AS gap FROM cu a JOIN cu b ON a.muni = b.muni AND a.id < b.id AND abs(a.y_all - b.y_all) < 300")
def pairs_upper_triangle(spark, d):
    c = customers(spark, d).select("id", "muni", "y_all")
    e = neighbours.edges(c, c, "id", lambda a, b: F.abs(a["y_all"] - b["y_all"]), ["y_all"], ["muni"])
    return e.where("i < j and d < 300").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").alias("gap"))


@query("l: id, s: best_segment, d: total", "WITH s AS (SELECT o_custkey AS id, o_orderpriority AS p, sum(o_totalprice) AS t FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, p) AS i FROM s) SELECT id, p AS best_segment, t AS total FROM r WHERE i = 1")
def argmax_row(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("best_segment")).agg(F.sum("o_totalprice").alias("total"))
    return evaluate.best_configuration(s, ["id"], [F.desc("total"), "best_segment"])


@query("l: o_custkey o_orderkey rank, d: o_totalprice", "SELECT o_custkey, o_orderkey, rank, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("l: place id, d: x1", f"WITH {CU} SELECT row_number() OVER (ORDER BY abs(x1 - 8) DESC NULLS LAST, id) AS place, id, x1 FROM cu ORDER BY abs(x1 - 8) DESC NULLS LAST, id LIMIT 25")
def sort_by_absolute_top25(spark, d):
    """A report of the 25 largest, nulls last: a top-k, then numbered."""
    top = customers(spark, d).orderBy(F.abs(F.col("x1") - 8).desc_nulls_last(), "id").limit(25)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.abs(F.col("x1") - 8).desc_nulls_last(), "id")))


@query("l: id, d: average_rank percent", f"WITH {CU}, r AS (SELECT id, muni, x3, rank() OVER (PARTITION BY muni ORDER BY x3) + (count(*) OVER (PARTITION BY muni, x3) - 1) / 2.0 AS average_rank, count(*) OVER (PARTITION BY muni) AS n FROM cu) SELECT id, average_rank, average_rank / n AS percent FROM r")
def average_ranks(spark, d):
    r = stats.average_rank(customers(spark, d), ["muni"], "x3", "average_rank")
    return r.withColumn("percent", F.col("average_rank") / F.count("*").over(Window.partitionBy("muni")))


@query("l: k", "SELECT n_regionkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer")
def set_intersection(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("k")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("l: k", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey"))


# -- yearly statistics ------------------------------------------------------------------------------------------------
YR = """yr AS (SELECT c_nationkey AS muni, year(o_orderdate) AS yr, o_orderpriority AS cycle, l_returnflag AS modality, l_quantity AS planted, l_quantity * (1 - l_discount) AS harvested, l_quantity * l_discount AS lost, l_extendedprice AS production
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def yearly_rows(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    q = F.col("l_quantity")
    return j.select(F.col("c_nationkey").alias("muni"), F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("cycle"), F.col("l_returnflag").alias("modality"), q.alias("planted"), (q * (1 - F.col("l_discount"))).alias("harvested"), (q * F.col("l_discount")).alias("lost"), F.col("l_extendedprice").alias("production"))


@query("l: muni yr, m: planted harvested lost production, d: yield damage", f"WITH {YR} SELECT muni, yr, sum(planted) AS planted, sum(harvested) AS harvested, sum(lost) AS lost, sum(production) AS production, sum(production) / sum(harvested) AS yield, sum(lost) / sum(planted) AS damage FROM yr GROUP BY muni, yr")
def annual_rollup(spark, d):
    return annual.yearly(yearly_rows(spark, d), ["muni", "yr"])


HIST = f"WITH {YR}, g AS (SELECT muni, yr, sum(production) / sum(harvested) AS y FROM yr GROUP BY muni, yr)"


@query("l: muni, d: hist_mean hist_std, m: hist_trend, l: hist_years, d: recent_mean, l: recent_years", f"{HIST} SELECT muni, avg(y) AS hist_mean, stddev_pop(y) AS hist_std, CASE WHEN count(y) >= 2 THEN regr_slope(y, yr) END AS hist_trend, count(y) AS hist_years, avg(y) FILTER (yr <= 1998) AS recent_mean, count(y) FILTER (yr <= 1998) AS recent_years FROM g GROUP BY muni")
def annual_history(spark, d):
    g = annual.yearly(yearly_rows(spark, d), ["muni", "yr"]).withColumnRenamed("yield", "y")
    out = annual.history(g, ["muni"], "yr", "y")
    return out.join(annual.history(g, ["muni"], "yr", "y", 1998, "recent").select("muni", "recent_mean", "recent_years"), "muni")


@query("l: muni yr, s: cycle modality, l: gid, m: production harvested", f"WITH {YR} SELECT muni, yr, cycle, modality, GROUPING_ID(muni, yr, cycle, modality) AS gid, sum(production) AS production, sum(harvested) AS harvested FROM yr GROUP BY GROUPING SETS ((muni, yr), (muni, yr, cycle), (muni, yr, modality), (muni, yr, cycle, modality))")
def scoped_annual(spark, d):
    return annual.scopes_cube(yearly_rows(spark, d), ["muni", "yr"], ["cycle", "modality"])


SCOPES = {"exact": {"cycle": "1-URGENT", "modality": "R"}, "modal": {"cycle": None, "modality": "R"}, "any": {"cycle": None, "modality": None}}


def scoped(name: str) -> str:
    where = " AND ".join([f"{c} = '{v}'" for c, v in SCOPES[name].items() if v] or ["true"])
    return f"{name}_ AS (SELECT muni, yr, sum(production) / sum(harvested) AS {name}_yield FROM yr WHERE {where} GROUP BY muni, yr)"


@query("l: muni yr, d: exact_yield modal_yield any_yield", f"WITH {YR}, {', '.join(map(scoped, SCOPES))} SELECT coalesce(a.muni, b.muni, c.muni) AS muni, coalesce(a.yr, b.yr, c.yr) AS yr, exact_yield, modal_yield, any_yield FROM exact_ a FULL JOIN modal_ b ON a.muni = b.muni AND a.yr = b.yr FULL JOIN any_ c ON c.muni = coalesce(a.muni, b.muni) AND c.yr = coalesce(a.yr, b.yr)")
def full_outer_scopes(spark, d):
    rows = yearly_rows(spark, d)
    out = None
    for name, f in SCOPES.items():
        one = annual.scope(rows, ["muni", "yr"], f, name).select("muni", "yr", f"{name}_yield")
        out = one if out is None else out.join(one, ["muni", "yr"], "full")
    return out


@query("l: muni yr, d: prior, s: source", f"WITH {YR}, {', '.join(map(scoped, SCOPES))} SELECT c.muni, c.yr, coalesce(CASE WHEN c.yr % 2 = 0 THEN exact_yield END, CASE WHEN c.yr % 3 = 0 THEN modal_yield END, any_yield) AS prior, CASE WHEN c.yr % 2 = 0 AND exact_yield IS NOT NULL THEN 'exact' WHEN c.yr % 3 = 0 AND modal_yield IS NOT NULL THEN 'modal' WHEN any_yield IS NOT NULL THEN 'any' END AS source FROM any_ c LEFT JOIN exact_ a ON a.muni = c.muni AND a.yr = c.yr LEFT JOIN modal_ b ON b.muni = c.muni AND b.yr = c.yr")
def prior_fallback(spark, d):
    wide = full_outer_scopes(spark, d)
    value, label = annual.fallback({"exact": F.when(F.col("yr") % 2 == 0, F.col("exact_yield")), "modal": F.when(F.col("yr") % 3 == 0, F.col("modal_yield")), "any": "any_yield"})
    return wide.select("muni", "yr", value.alias("prior"), label.alias("source"))


@query("s: cycle modality, l: n, m: production", f"WITH {YR} SELECT cycle, modality, count(*) AS n, sum(production) AS production FROM yr GROUP BY CUBE (cycle, modality)")
def cube_scopes(spark, d):
    return yearly_rows(spark, d).cube("cycle", "modality").agg(F.count("*").alias("n"), F.sum("production").alias("production"))


@query("l: yr, s: name", "WITH f AS (SELECT 1990 + p_size % 12 AS yr, p_name || '_' || p_brand AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY CASE WHEN name LIKE 'red%' THEN 0 ELSE 1 END, name) AS i FROM (SELECT DISTINCT * FROM f)) SELECT yr, name FROM r WHERE i = 1")
def canonical_file_per_year(spark, d):
    f = table(spark, d, "part").select((F.lit(1990) + F.col("p_size") % 12).alias("yr"), F.concat_ws("_", "p_name", "p_brand").alias("name")).distinct()
    return annual.canonical(f, "yr", "name", "^red")


@query("l: id, s: area_key join_source", f"WITH {CU}, nn AS (SELECT lower(n_name) AS n, CAST(n_nationkey AS VARCHAR) AS k FROM nation WHERE n_nationkey % 3 = 0) SELECT id, coalesce(k, CASE WHEN id % 4 <> 0 THEN 's' || muni END) AS area_key, CASE WHEN k IS NOT NULL THEN 'official_name' WHEN id % 4 <> 0 THEN 'spatial_fallback' END AS join_source FROM cu LEFT JOIN nn ON n = 'nation_' || muni")
def name_join_fallback(spark, d):
    left = customers(spark, d).select("id", F.concat(F.lit("  NÁTION_"), "muni").alias("name"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("s"), "muni")).alias("spatial"))
    right = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("area_key"))
    return annual.join_by_name(left, right, "name", "area_key", "spatial")


# -- statistics -------------------------------------------------------------------------------------------------------
FEATURES = ["x1", "x2", "x3", "y_all"]
LONG = f"{CU}, lf AS (SELECT id, train, y, feature, x FROM cu CROSS JOIN LATERAL (VALUES ('x1', x1), ('x2', x2), ('x3', CAST(x3 AS DOUBLE)), ('y_all', y_all)) t(feature, x))"


@query("s: col_, l: missing, d: pct", f"WITH {CU} SELECT c AS \"column\", missing, 100.0 * missing / n AS pct FROM (SELECT count(*) AS n, count(*) - count(y) AS y, count(*) - count(x1) AS x1, count(*) - count(x2) AS x2 FROM cu) CROSS JOIN LATERAL (VALUES ('y', y), ('x1', x1), ('x2', x2)) t(c, missing)".replace('AS "column"', "AS col_"))
def missingness_table(spark, d):
    return stats.missingness(customers(spark, d), ["y", "x1", "x2"]).withColumnRenamed("column", "col_")


@query("s: feature, l: n, d: q1 q3 lower upper, l: outliers", f"WITH {LONG}, q AS (SELECT feature, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM lf GROUP BY feature) SELECT feature, any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q1 - 0.4 * (q3 - q1)) AS lower, any_value(q3 + 0.4 * (q3 - q1)) AS upper, count(*) FILTER (x < q1 - 0.4 * (q3 - q1) OR x > q3 + 0.4 * (q3 - q1)) AS outliers FROM lf JOIN q USING (feature) GROUP BY feature")
def outlier_iqr(spark, d):
    return stats.outlier_summary(customers(spark, d), FEATURES, 0.4).withColumnRenamed("column", "feature")


@query("s: feature, l: n, d: r", f"WITH {LONG} SELECT feature, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 THEN corr(x, y) END AS r FROM lf WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY feature")
def pearson_screen(spark, d):
    return stats.correlation_screen(customers(spark, d), "y", FEATURES)


SPEAR = f"WITH {LONG}, r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM lf WHERE x IS NOT NULL AND y IS NOT NULL)"


@query("s: feature, l: n, d: r", f"{SPEAR} SELECT feature, count(*) AS n, corr(rx, ry) AS r FROM r GROUP BY feature")
def spearman_screen(spark, d):
    return stats.correlation_screen(customers(spark, d), "y", FEATURES, "spearman")


PV = "pv AS (SELECT p_partkey AS id, p_size AS g, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE ((p_partkey * 7919) % 997 + 0.5) / 20000.0 END AS p FROM part)"


def pvalues(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("g"), F.when(k % 9 != 0, ((k * 7919) % 997 + 0.5) / 20000.0).alias("p"))


@query("l: id, d: p bonf", f"WITH {PV} SELECT id, p, CASE WHEN p IS NOT NULL THEN least(1.0, p * count(p) OVER (PARTITION BY g)) END AS bonf FROM pv")
def p_adjust_bonferroni(spark, d):
    return stats.adjust_pvalues(pvalues(spark, d), "p", "bonferroni", "bonf", ["g"])


@query("l: id, d: holm", f"WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p NULLS LAST, id) AS i, count(p) OVER (PARTITION BY g) AS m FROM pv) SELECT id, CASE WHEN p IS NOT NULL THEN least(1.0, max(p * (m - i + 1)) OVER (PARTITION BY g ORDER BY i)) END AS holm FROM r")
def p_adjust_holm(spark, d):
    return stats.adjust_pvalues(pvalues(spark, d), "p", "holm", "holm", ["g"])


@query("l: id, d: bh", f"WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p NULLS LAST, id) AS i, count(p) OVER (PARTITION BY g) AS m FROM pv) SELECT id, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / i) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS bh FROM r")
def p_adjust_bh(spark, d):
    return stats.adjust_pvalues(pvalues(spark, d), "p", "fdr_bh", "bh", ["g"])


SHIFT = f"""{LONG}, ks AS (SELECT feature, max(abs(fa - fb)) AS ks FROM (SELECT feature, x, sum(a) OVER o * 1.0 / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER o * 1.0 / sum(b) OVER (PARTITION BY feature) AS fb FROM (SELECT feature, x, count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM lf WHERE x IS NOT NULL GROUP BY feature, x) WINDOW o AS (PARTITION BY feature ORDER BY x)) GROUP BY feature),
 sh AS (SELECT feature, count(x) FILTER (train) AS n_first, count(x) FILTER (NOT train) AS n_second, avg(x) FILTER (train) AS mean_first, avg(x) FILTER (NOT train) AS mean_second, 1 - count(x) FILTER (train) * 1.0 / count(*) FILTER (train) AS missing_first, 1 - count(x) FILTER (NOT train) * 1.0 / count(*) FILTER (NOT train) AS missing_second, (avg(x) FILTER (train) - avg(x) FILTER (NOT train)) / sqrt((var_samp(x) FILTER (train) + var_samp(x) FILTER (NOT train)) / 2) AS smd FROM lf GROUP BY feature)"""
SHIFTED = "s: feature, l: n_first n_second, d: mean_first mean_second missing_first missing_second smd ks"


@query(SHIFTED, f"WITH {SHIFT} SELECT sh.*, ks FROM sh JOIN ks USING (feature)")
def ks_smd_shift(spark, d):
    return stats.shift_screen(customers(spark, d), FEATURES, "train")


@query(f"{SHIFTED}, d: q01 q99 out_of_range, b: flag_smd flag_range", f"WITH {SHIFT}, bd AS (SELECT feature, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM lf WHERE train GROUP BY feature), ou AS (SELECT feature, avg(CASE WHEN x < lo OR x > hi THEN 1.0 ELSE 0.0 END) FILTER (x IS NOT NULL) AS out_of_range FROM lf JOIN bd USING (feature) WHERE NOT train GROUP BY feature) SELECT sh.*, ks, q01, q99, out_of_range, abs(smd) > 0.25 AS flag_smd, out_of_range > 0.05 AS flag_range FROM sh JOIN ks USING (feature) JOIN bd USING (feature) JOIN ou USING (feature)")
def train_pred_diagnostics(spark, d):
    return stats.train_prediction_diagnostics(customers(spark, d), FEATURES, "train")


@query("l: muni n, d: mean mad skewness kurtosis", f"WITH {CU}, m AS (SELECT *, median(x1) OVER (PARTITION BY muni) AS md, avg(x1) OVER (PARTITION BY muni) AS mu, stddev_pop(x1) OVER (PARTITION BY muni) AS sd FROM cu) SELECT muni, count(x1) AS n, avg(x1) AS mean, median(abs(x1 - md)) AS mad, CASE WHEN count(x1) > 2 AND any_value(sd) > 1e-12 THEN avg(pow((x1 - mu) / sd, 3)) END AS skewness, CASE WHEN count(x1) > 2 AND any_value(sd) > 1e-12 THEN avg(pow((x1 - mu) / sd, 4)) - 3 END AS kurtosis FROM m GROUP BY muni")
def mad_moments(spark, d):
    return stats.moments(customers(spark, d), ["muni"], "x1")


@query("l: muni, d: effective smd, d: q05 q50 q95", f"WITH {CU} SELECT muni, pow(sum(x2), 2) / sum(x2 * x2) AS effective, CASE WHEN count(x1) FILTER (train) >= 2 AND count(x1) FILTER (NOT train) >= 2 THEN (avg(x1) FILTER (train) - avg(x1) FILTER (NOT train)) / sqrt(((count(x1) FILTER (train) - 1) * var_samp(x1) FILTER (train) + (count(x1) FILTER (NOT train) - 1) * var_samp(x1) FILTER (NOT train)) / (count(x1) - 2)) END AS smd, quantile_cont(x2, 0.05) AS q05, quantile_cont(x2, 0.5) AS q50, quantile_cont(x2, 0.95) AS q95 FROM cu GROUP BY muni")
def effective_size_and_quantiles(spark, d):
    c = customers(spark, d)
    q = F.percentile("x2", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return c.groupBy("muni").agg(stats.effective_size("x2").alias("effective"), stats.standardized_difference("x1", "train", True, False).alias("smd"), q.alias("q")).select("muni", "effective", "smd", *(F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


@query("d: eta_squared", f"WITH {CU}, g AS (SELECT muni, count(*) AS n, avg(x1) AS m, var_pop(x1) * count(*) AS w FROM cu WHERE x1 IS NOT NULL GROUP BY muni) SELECT (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (sum(w) + sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) AS eta_squared FROM g")
def eta_squared(spark, d):
    return stats.eta_squared(customers(spark, d), "muni", "x1")


@query(
    "s: lang, d: auc average_precision brier",
    "WITH b AS (SELECT lang, quality AS y, ntile_ AS s FROM (SELECT lang, quality, least(n_chars, 5000) // 250 / 20.0 AS ntile_ FROM labels JOIN documents USING (doc_id)) WHERE y IS NOT NULL), st AS (SELECT lang, s, sum(y) AS p, count(*) AS n, sum(pow(s - y, 2)) AS br FROM b GROUP BY ALL), w AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY s DESC) AS al, coalesce(sum(n - p) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg FROM st) SELECT lang, CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN sum(p * (neg + (n - p) / 2.0)) / (sum(p) * sum(n - p)) END AS auc, CASE WHEN sum(p) > 0 THEN sum(p * tp * 1.0 / al) / sum(p) END AS average_precision, sum(br) / sum(n) AS brier FROM w GROUP BY lang",
)
def binary_metrics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.floor(F.least("n_chars", F.lit(5000)) / 250) / 20.0).alias("s"))
    return stats.binary_metrics(table(spark, d, "labels").join(docs, "doc_id"), "quality", "s", ["lang"])


@query("s: feature, d: vif", f"WITH {CU}, c AS (SELECT corr(x1, x2) AS r, corr(x1, y_all) AS s, corr(x2, y_all) AS t FROM cu WHERE x1 IS NOT NULL), v AS (SELECT *, 1 + 2 * r * s * t - r * r - s * s - t * t AS det FROM c) SELECT feature, vif FROM v CROSS JOIN LATERAL (VALUES ('x1', (1 - t * t) / det), ('x2', (1 - s * s) / det), ('y_all', (1 - r * r) / det)) f(feature, vif)")
def vif_gram(spark, d):
    return stats.vif(customers(spark, d), ["x1", "x2", "y_all"])


@query("d: intercept slope rmse r2", f"WITH {CU}, f AS (SELECT regr_slope(y_all, x1) AS b, regr_intercept(y_all, x1) AS a, regr_r2(y_all, x1) AS r2 FROM cu) SELECT any_value(a) AS intercept, any_value(b) AS slope, sqrt(avg(pow(y_all - a - b * x1, 2))) AS rmse, any_value(r2) AS r2 FROM cu, f WHERE x1 IS NOT NULL")
def linear_regression(spark, d):
    out = stats.linear_regression(customers(spark, d), "y_all", ["x1"])
    return spark.createDataFrame([(out["intercept"], out["coefficients"]["x1"], out["rmse"], out["r2"])], "intercept double, slope double, rmse double, r2 double")


POISSON = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(12)]


@query("d: mean low high, l: clusters", f"WITH {CU}, s AS (SELECT muni, sum(x1) AS s, count(*) AS n FROM cu WHERE x1 IS NOT NULL GROUP BY muni), u AS (SELECT *, ({hash_sql('7, muni, replicate')} % 1073741824 + 0.5) / 1073741824 AS u FROM s, range(1, 201) t(replicate)), t AS (SELECT *, {' + '.join(f'CAST(u > {x!r} AS INT)' for x in POISSON)} AS t FROM u), m AS (SELECT replicate, sum(s * t) / nullif(sum(n * t), 0) AS m FROM t GROUP BY replicate) SELECT (SELECT sum(s) / sum(n) FROM s) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, (SELECT count(*) FROM s) AS clusters FROM m")
def bootstrap_cluster(spark, d):
    return stats.bootstrap_mean(customers(spark, d), "x1", "muni")


# -- neighbours -------------------------------------------------------------------------------------------------------
KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
EU = "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))))"


def places(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.alias("e"), "label", (e[0].cast("double") * 20 + 20).alias("lat"), (e[1].cast("double") * 20 - 100).alias("lon"))


EM = "em AS (SELECT vec_id AS id, embedding AS e, label, CAST(embedding[1] AS DOUBLE) * 20 + 20 AS lat, CAST(embedding[2] AS DOUBLE) * 20 - 100 AS lon FROM embeddings)"


@query("l: i rank j, d: d", f"WITH {EM}, p AS (SELECT a.id AS i, b.id AS j, {KM} AS d FROM em a JOIN em b ON a.id <> b.id WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM p) SELECT i, rank, j, d FROM r WHERE rank <= 4")
def haversine_knn(spark, d):
    p = places(spark, d)
    return neighbours.nearest(neighbours.edges(p.where("id % 50 = 0"), p, "id", neighbours.by_place("lat", "lon"), ["lat", "lon"]), 4)


@query("l: i rank j, d: d", f"WITH {EM}, p AS (SELECT a.id AS i, b.id AS j, {EU} AS d FROM em a JOIN em b ON a.id <> b.id WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM p) SELECT i, rank, j, d FROM r WHERE rank <= 5")
def embedding_knn(spark, d):
    p = places(spark, d)
    return neighbours.nearest(neighbours.edges(p.where("id % 50 = 0"), p, "id", neighbours.by_embedding("e"), ["e"]), 5)


GEO = f"{EM}, ed AS (SELECT a.id AS i, b.id AS j, a.label, {KM} AS d FROM em a JOIN em b ON a.label = b.label AND a.id <> b.id)"


def label_edges(spark, d, how="place"):
    """Edges inside a label: blocks keep pairs from growing with the whole table."""
    p = places(spark, d)
    f, cols = (neighbours.by_place("lat", "lon"), ["lat", "lon"]) if how == "place" else (neighbours.by_embedding("e"), ["e"])
    return neighbours.edges(p, p, "id", f, cols, ["label"]).select("i", "j", "d")


ALL = f"{EM}, ed AS (SELECT a.id AS i, b.id AS j, {KM} AS d FROM em a JOIN em b ON a.id <> b.id)"


def near(spark, d, k, asked="true", known="true"):
    """The k nearest places, over all places."""
    p = places(spark, d)
    return neighbours.nearest_places(p.where(asked), p.where(known), "id", "lat", "lon", k)


@query("l: i j, d: d", f"WITH {GEO}, sc AS (SELECT median(m) AS s FROM (SELECT i, min(d) AS m FROM ed GROUP BY i)) SELECT i, j, d / s AS d FROM ed, sc")
def normalized_distance(spark, d):
    return neighbours.normalized(label_edges(spark, d))


@query("l: i j, f: d", f"WITH {GEO}, fe AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id % 7 = 0 THEN NULL ELSE {EU} END AS d FROM em a JOIN em b ON a.label = b.label AND a.id <> b.id) SELECT ed.i, ed.j, 0.3 * ed.d / 100 + coalesce(0.7 * fe.d, 0) AS d FROM ed JOIN fe ON ed.i = fe.i AND ed.j = fe.j")
def mixed_distance(spark, d):
    """Both distances of a pair where it meets, for both directions: pairs are neither shuffled nor joined."""

    def read(t):
        return [*neighbours.place_arrays(t, "lat", "lon"), *neighbours.vector_arrays(t, "e")]

    def measure(a, b):
        return 0.3 * neighbours.place_matrix(a[:2], b[:2]) / 100, *neighbours.vector_matrix(a[2:], b[2:])

    def weigh(i, geo, feature, no_feature):
        return neighbours.weighted_matrix({"geo": (geo, None, 1.0), "feature": (feature, i % 7 == 0 if no_feature is None else no_feature | (i % 7 == 0), 0.7)})

    return neighbours.block_pairs(places(spark, d), "id", "label", read, measure, weigh)


KN = f"{ALL}, kn AS (SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM ed) WHERE r <= 3), sy AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS d FROM kn GROUP BY 1, 2), bo AS (SELECT i, j, d FROM sy UNION ALL SELECT j, i, d FROM sy)"


@query("l: i j, d: d w", f"WITH {KN}, s AS (SELECT median(d) AS s FROM sy) SELECT i, j, d, exp(-0.5 * pow(d / s, 2)) AS w FROM bo, s")
def knn_graph_rbf(spark, d):
    return neighbours.rbf_graph(near(spark, d, 3), 3)


@query("l: n, d: morans_i expected", f"WITH {KN}, w AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM bo), v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings), c AS (SELECT avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM v) SELECT any_value(n) AS n, any_value(n) / sum(w) * sum(w * (a.v - m) * (b.v - m)) / any_value(ss) AS morans_i, -1.0 / (any_value(n) - 1) AS expected FROM w JOIN v a ON i = a.id JOIN v b ON j = b.id, c")
def moran_i(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("v"))
    return neighbours.morans_i(neighbours.row_weights(near(spark, d, 3), 3), v, "id", "v")


@query("l: id cell, d: distance_km", f"WITH {EM}, ce AS (SELECT la * 1000 + lo AS cell, la * 1.0 AS lat, -120.0 + lo AS lon FROM range(0, 41) a(la), range(0, 41) b(lo)), p AS (SELECT a.id, b.cell, {KM} AS km FROM em a JOIN ce b ON abs(floor(a.lat) - floor(b.lat)) <= 1 AND abs(floor(a.lon) - floor(b.lon)) <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, cell) AS i FROM p) SELECT id, cell, km AS distance_km FROM r WHERE i = 1")
def nearest_cell(spark, d):
    g = spark.range(41).select(F.col("id").alias("la")).crossJoin(spark.range(41).select(F.col("id").alias("lo")))
    ce = g.select((F.col("la") * 1000 + F.col("lo")).alias("cell"), F.col("la").cast("double").alias("lat"), (F.col("lo") - 120.0).alias("lon"))
    return neighbours.nearest_cell(places(spark, d), ce, "id", "cell", "lat", "lon", 1.0)


@query("l: i, d: predicted", f"WITH {ALL}, q AS (SELECT i, j, d FROM ed WHERE i % 10 < 3 AND j % 10 >= 3), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM q) WHERE r <= 6) SELECT i, coalesce(avg(v) FILTER (d <= 1e-12), sum(v / (d + 1e-8)) / sum(1 / (d + 1e-8))) AS predicted FROM k JOIN (SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings) ON j = vec_id GROUP BY i")
def idw_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("j"), F.col("embedding")[2].cast("double").alias("v"))
    return neighbours.idw(near(spark, d, 6, "id % 10 < 3", "id % 10 >= 3").join(v, "j"), "v", [])


def neighbour_rows(spark, d, k=24):
    p = places(spark, d).select("id", F.slice(F.transform("e", lambda x: x.cast("double")), 4, 5).alias("x"), F.col("e")[2].cast("double").alias("y"))
    return near(spark, d, k, "id % 10 < 3", "id % 10 >= 3").join(p.select(F.col("id").alias("j"), "x", "y"), "j").join(p.select(F.col("id").alias("i"), F.col("x").alias("q")), "i").select("i", "j", "d", "x", "y", "q")


query("l: i, d: predicted", name="local_ridge_huber")(lambda s, d: models.predict_local(neighbour_rows(s, d, 10), [], models.huber_ridge))
query("l: i, d: predicted", name="local_elastic_net")(lambda s, d: models.predict_local(neighbour_rows(s, d), [], models.elastic_net))


@query("l: id, d: predicted", f"WITH {CU}, g AS (SELECT muni, avg(y) AS m FROM cu WHERE train AND muni % 4 <> 0 GROUP BY muni), a AS (SELECT avg(y) AS m FROM cu WHERE train AND muni % 4 <> 0) SELECT id, coalesce(g.m, a.m) AS predicted FROM cu LEFT JOIN g USING (muni), a WHERE NOT train")
def state_mean_fallback(spark, d):
    c = customers(spark, d)
    return models.group_means(c.where("train and muni % 4 <> 0"), c.where("not train"), "muni", "y")


@query("l: id, d: predicted", f"WITH {CU}, t AS (SELECT * FROM cu WHERE train AND muni % 4 <> 0 AND state <> 2), i AS (SELECT state, muni, avg(y) AS m, count(y) AS n FROM t GROUP BY ALL), o AS (SELECT state, avg(y) AS m FROM t GROUP BY state), a AS (SELECT avg(y) AS m FROM t) SELECT id, (coalesce(i.n, 0) * coalesce(i.m, 0) + 5 * coalesce(o.m, a.m)) / (coalesce(i.n, 0) + 5) AS predicted FROM cu LEFT JOIN i ON cu.state = i.state AND cu.muni = i.muni LEFT JOIN o ON cu.state = o.state, a WHERE NOT train")
def shrinkage(spark, d):
    c = customers(spark, d)
    return models.shrunken_means(c.where("train and muni % 4 <> 0 and state <> 2"), c.where("not train"), "muni", "state", "y", 5.0)


@query("l: id, d: x1 x2", f"WITH {CU}, f AS (SELECT id, coalesce(x1, (SELECT median(x1) FROM cu)) AS a, x2 AS b FROM cu), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f) SELECT id, (a - ma) / sa AS x1, (b - mb) / sb AS x2 FROM f, m")
def standardized_profile(spark, d):
    return models.standardize(customers(spark, d), ["x1", "x2"])


FOUR = ["x1", "x2", "x3", "y_all"]
query("l: id, d: pc01 pc02", f"WITH {CU}, f AS (SELECT id, {', '.join(f'coalesce({c}, (SELECT median({c}) FROM cu)) AS v{k}' for k, c in enumerate(FOUR, 1))} FROM cu), t AS (SELECT {', '.join(f'avg(v{k}) AS m{k}, stddev_pop(v{k}) AS s{k}' for k in range(1, 5))} FROM f), z AS (SELECT id, {', '.join(f'CASE WHEN s{k} > 0 THEN (v{k} - m{k}) / s{k} ELSE 0 END AS z{k}' for k in range(1, 5))} FROM f, t), co AS (SELECT [{', '.join('[' + ', '.join(f'covar_pop(z{a}, z{b})' for b in range(1, 5)) + ']' for a in range(1, 5))}] AS m FROM z), {leading_sql('co', 4, 'ea')}, de AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, c: x - ea.l * ea.v[i] * ea.v[c])) AS m FROM co, ea), {leading_sql('de', 4, 'eb')} SELECT id, {' + '.join(f'z{k} * ea.v[{k}]' for k in range(1, 5))} AS pc01, {' + '.join(f'z{k} * eb.v[{k}]' for k in range(1, 5))} AS pc02 FROM z, ea, eb", name="pca_scores")(lambda s, d: models.pca(customers(s, d), "id", ["x1", "x2", "x3", "y_all"], 2))
OPS = {"product": "a * b", "sum": "a + b", "difference": "a - b", "reverse_difference": "b - a", "safe_ratio": "a / (b + CASE WHEN b < 0 THEN -1e-6 ELSE 1e-6 END)", "reverse_safe_ratio": "b / (a + CASE WHEN a < 0 THEN -1e-6 ELSE 1e-6 END)", "symmetric_change": "2.0 * (a - b) / (abs(a) + abs(b) + 1e-6)"}


def spearman_sql(source: str, keys: str) -> str:
    """Rank correlation of v with y over the complete rows of each group of keys."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
    return f"SELECT {keys}, CASE WHEN count(*) >= 3 AND var_pop(p) > 0 AND var_pop(q) > 0 THEN corr(p, q) END AS r FROM (SELECT {keys}, {rank('v')} AS p, {rank('y')} AS q FROM {source} WHERE v IS NOT NULL AND y IS NOT NULL) GROUP BY {keys}"


MINED = f"WITH {CU}, tr AS (SELECT id, y, x1, x2, x3 FROM cu WHERE train), lo AS (SELECT id, y, feature, v FROM tr CROSS JOIN LATERAL (VALUES ('x1', x1), ('x2', x2), ('x3', x3)) t(feature, v)), pr AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature) AS n FROM ({spearman_sql('lo', 'feature')})), pa AS (SELECT a.feature AS l, b.feature AS rt, a.n AS na, b.n AS nb FROM pr a JOIN pr b ON a.n < b.n), ex AS (SELECT op, l, rt, y, v FROM (SELECT pa.l, pa.rt, p.y, p.v AS a, q.v AS b FROM pa JOIN lo p ON p.feature = pa.l JOIN lo q ON q.feature = pa.rt AND p.id = q.id) CROSS JOIN LATERAL (VALUES {', '.join(f"('{o}', {e})" for o, e in OPS.items())}) t(op, v)), sc AS ({spearman_sql('ex', 'op, l, rt')}) SELECT op AS operation, l AS left_, rt AS right_, r, row_number() OVER (ORDER BY round(abs(r), 12) DESC NULLS LAST, op, l, rt) AS rank FROM sc QUALIFY rank <= 10"
query("s: operation left_ right_, d: r, l: rank", MINED, name="expression_miner")(lambda s, d: models.mine_expressions(customers(s, d).where("train"), "y", ["x1", "x2", "x3"]).withColumnsRenamed({"left": "left_", "right": "right_"}))


WARPED = f"""WITH RECURSIVE {TR}, gr AS (SELECT u.user_id, s, i FROM us u, (VALUES ('click'), ('view')) t(s), range(0, {len(MONTHS)}) r(i)), kp AS (SELECT user_id, s, x - {min(MONTHS)} AS x, y, count(*) OVER (PARTITION BY user_id, s) AS n FROM tr), nx AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, first_value(x) OVER w AS xf, first_value(y) OVER w AS yf, last_value(x) OVER w AS xl, last_value(y) OVER w AS yl FROM kp WHERE n >= 3 WINDOW o AS (PARTITION BY user_id, s ORDER BY x), w AS (PARTITION BY user_id, s ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 fi AS (SELECT gr.user_id, gr.s, gr.i, max(CASE WHEN i < xf THEN yf WHEN i >= xl THEN yl WHEN x <= i AND i < x2 THEN y + (y2 - y) * (i - x) / (x2 - x) END) AS v FROM gr JOIN nx USING (user_id, s) GROUP BY ALL), st AS (SELECT user_id, s, avg(v) AS m, stddev_pop(v) AS sd FROM fi GROUP BY ALL HAVING stddev_pop(v) > 1e-12), zs AS (SELECT user_id, s, list((v - m) / sd ORDER BY i) AS z FROM fi JOIN st USING (user_id, s) GROUP BY ALL),
 zz AS (SELECT p.user_id, p.z AS a, q.z AS b FROM zs p JOIN zs q ON p.user_id = q.user_id AND p.s = 'click' AND q.s = 'view'), {warp_sql()} SELECT u.user_id, dtw.d AS dtw FROM us u LEFT JOIN dtw USING (user_id)"""


@query("l: user_id, d: dtw", WARPED)
def dtw_distance(spark, d):
    from panelforge.plans.panel_queries import A, B, wide

    w = wide(spark, d).select("user_id", F.array(*A.values()).alias("a"), F.array(*B.values()).alias("b"))
    z = w.select("user_id", models.interpolated_z("a").alias("a"), models.interpolated_z("b").alias("b"))
    return z.select("user_id", models.dtw_distance("a", "b").alias("dtw"))


@query("l: id turn, s: family", "WITH r AS (SELECT p_partkey AS id, p_brand AS family, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part) SELECT id, turn, family FROM r ORDER BY turn, family LIMIT 40")
def seed_round_robin(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), "p_retailprice")
    return models.round_robin(p, "family", [F.desc("p_retailprice"), "id"], 40)


# -- splits -----------------------------------------------------------------------------------------------------------
@query("l: state muni n seats", f"WITH {CU}, c AS (SELECT state, muni, count(*) AS n FROM cu GROUP BY ALL), e AS (SELECT *, 37.0 * n / sum(n) OVER (PARTITION BY state) AS x FROM c), f AS (SELECT *, floor(x) AS b, round(x - floor(x), 12) AS r FROM e) SELECT state, muni, n, b + CASE WHEN row_number() OVER (PARTITION BY state ORDER BY r DESC, n DESC, muni DESC) <= 37 - sum(b) OVER (PARTITION BY state) THEN 1 ELSE 0 END AS seats FROM f")
def hamilton(spark, d):
    c = customers(spark, d).groupBy("state", "muni").agg(F.count("*").alias("n"))
    return splits.hamilton(c.withColumn("n", F.col("n").cast("double")), "muni", "n", 37, ["state"])


query("l: id fold", f"WITH {CU} SELECT id, (row_number() OVER (PARTITION BY state ORDER BY {hash_sql('0, id')}, id) - 1) % 5 AS fold FROM cu", name="stratified_folds")(lambda s, d: splits.stratified_folds(customers(s, d), "id", "state", 5))
query("l: id fold", f"WITH {CU} SELECT id, {hash_sql('0, muni')} % 5 AS fold FROM cu", name="grouped_folds")(lambda s, d: splits.grouped_folds(customers(s, d), "muni", 5))
query("l: id repeat fold", f"WITH {CU} SELECT id, repeat, {hash_sql('repeat, id')} % 5 AS fold FROM cu, range(0, 3) t(repeat)", name="repeated_folds")(lambda s, d: splits.repeated_folds(customers(s, d), "id", 5, 3))


@query("s: family split_id, l: id, s: role", f"WITH {CU}, l AS (SELECT 'fa' AS family, id, id % 3 AS fold FROM cu UNION ALL SELECT 'fb', id, muni % 4 FROM cu), n AS (SELECT DISTINCT family, fold AS sf FROM l) SELECT l.family, l.family || '_' || sf AS split_id, id, CASE WHEN fold = sf THEN 'pseudo_target' ELSE 'pseudo_train' END AS role FROM l JOIN n USING (family)")
def folds_to_splits(spark, d):
    c = customers(spark, d).select("id", (F.col("id") % 3).cast("int").alias("fa"), (F.col("muni") % 4).cast("int").alias("fb"))
    return splits.folds_to_splits(c, "id", ["fa", "fb"])


@query("l: split_id n_rows targets repeated unknown missing", f"WITH {CU}, m AS (SELECT id % 4 AS split_id, c.id + CASE WHEN c.id % 50 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN c.id % 3 = 0 THEN 1 ELSE 0 END AS t FROM cu c UNION ALL SELECT 1, id, 0 FROM cu WHERE id % 40 = 1), p AS (SELECT split_id, id, count(*) AS n, max(t) AS t FROM m GROUP BY ALL) SELECT split_id, sum(n) AS \"rows\", sum(t) AS targets, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (id >= 1000000) AS unknown, (SELECT count(*) FROM cu) - count(*) FILTER (id < 1000000) AS missing FROM p GROUP BY split_id".replace('AS "rows"', "AS n_rows"))
def membership_checks(spark, d):
    c = customers(spark, d)
    role = F.when(F.col("id") % 3 == 0, "pseudo_target").otherwise("pseudo_train")
    m = c.select((F.col("id") % 4).alias("split_id"), (F.col("id") + F.when(F.col("id") % 50 == 0, 1000000).otherwise(0)).alias("id"), role.alias("role"))
    m = m.unionByName(c.where("id % 40 = 1").select(F.lit(1).cast("long").alias("split_id"), "id", F.lit("pseudo_train").alias("role")))
    return splits.validate_membership(m, "id", c).withColumnRenamed("rows", "n_rows")


# -- evaluation -------------------------------------------------------------------------------------------------------
PR = f"""{EV}, base AS (SELECT event_id AS id, event_id % 16 AS split_id, user_id, event_type AS tier, full_value AS observed, avg(full_value) OVER (PARTITION BY user_id) AS m_user, avg(full_value) OVER (PARTITION BY event_type) AS m_type, avg(full_value) OVER (PARTITION BY p) AS m_pos FROM ev),
 pr AS (SELECT id, split_id, user_id, tier, observed, method, predicted FROM base CROSS JOIN LATERAL (VALUES ('m_user', m_user), ('m_type', m_type), ('m_pos', m_pos)) t(method, predicted))"""
METHODS = ["m_user", "m_type", "m_pos"]


def base(spark, d):
    w = lambda *k: F.avg("full_value").over(Window.partitionBy(*k))
    return events(spark, d).select(F.col("event_id").alias("id"), (F.col("event_id") % 16).alias("split_id"), "user_id", F.col("event_type").alias("tier"), F.col("full_value").alias("observed"), w("user_id").alias("m_user"), w("event_type").alias("m_type"), w("p").alias("m_pos"))


def predictions(spark, d):
    return base(spark, d).unpivot(["id", "split_id", "user_id", "tier", "observed"], METHODS, "method", "predicted")


@query("l: split_id, s: method, l: n, d: rmse mae r2", f"WITH {PR} SELECT split_id, method, count(*) AS n, sqrt(avg(pow(predicted - observed, 2))) AS rmse, avg(abs(predicted - observed)) AS mae, 1 - sum(pow(predicted - observed, 2)) / (var_pop(observed) * count(*)) AS r2 FROM pr GROUP BY ALL")
def split_metrics(spark, d):
    return evaluate.metrics(predictions(spark, d), ["split_id", "method"])


@query("s: method, l: splits, d: rmse_mean rmse_std rmse_best rmse_worst rmse_pooled", f"WITH {PR}, s AS (SELECT method, split_id, count(*) AS n, sum(pow(predicted - observed, 2)) AS e FROM pr GROUP BY ALL) SELECT method, count(*) AS splits, avg(sqrt(e / n)) AS rmse_mean, stddev_samp(sqrt(e / n)) AS rmse_std, min(sqrt(e / n)) AS rmse_best, max(sqrt(e / n)) AS rmse_worst, sqrt(sum(e) / sum(n)) AS rmse_pooled FROM s GROUP BY method")
def pooled_metrics(spark, d):
    return evaluate.method_summary(predictions(spark, d))


LO = "s AS (SELECT {k} split_id, method, sqrt(avg(pow(predicted - observed, 2))) AS rmse FROM pr GROUP BY ALL), o AS (SELECT *, (sum(rmse) OVER (PARTITION BY {k} method) - rmse) / (count(*) OVER (PARTITION BY {k} method) - 1) AS others FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY {k} split_id ORDER BY others, method) AS i FROM o)"


@query("l: split_id, s: method, d: selection_rmse held_out_rmse", f"WITH {PR}, {LO.format(k='')} SELECT split_id, method, others AS selection_rmse, rmse AS held_out_rmse FROM b WHERE i = 1")
def loso_selection(spark, d):
    return evaluate.loso_selection(predictions(spark, d))


@query("l: id split_id, s: tier method, d: predicted", f"WITH {PR}, {LO.format(k='tier,')} SELECT pr.id, pr.split_id, pr.tier, pr.method, predicted FROM pr JOIN b ON b.tier = pr.tier AND b.split_id = pr.split_id AND b.method = pr.method AND i = 1")
def loso_tier_routing(spark, d):
    return evaluate.loso_routing(predictions(spark, d), "tier")


TA = f"{PR}, tr_ AS (SELECT *, id % 5 <> 0 AS train FROM pr), bd AS (SELECT split_id, round(quantile_cont(observed, 0.15), 9) AS lo, round(quantile_cont(observed, 0.85), 9) AS hi FROM tr_ WHERE train AND method = 'm_user' GROUP BY split_id), ta AS (SELECT tr_.*, CASE WHEN observed <= lo THEN 'low' WHEN observed >= hi THEN 'high' ELSE 'center' END AS tail FROM tr_ JOIN bd USING (split_id))"


def tailed(spark, d):
    b = evaluate.fold_tails(base(spark, d).withColumn("train", F.col("id") % 5 != 0), "split_id", "train", "observed")
    return b.unpivot(["id", "split_id", "observed", "tail"], METHODS, "method", "predicted")


@query("l: id, s: method tail", f"WITH {TA} SELECT id, method, tail FROM ta")
def tail_assignment(spark, d):
    return tailed(spark, d)


@query("s: method tail, l: n, d: bias rmse over_fraction", f"WITH {TA} SELECT method, tail, count(*) AS n, avg(predicted - observed) AS bias, sqrt(avg(pow(predicted - observed, 2))) AS rmse, avg(CASE WHEN predicted > observed THEN 1.0 ELSE 0 END) AS over_fraction FROM ta GROUP BY ALL")
def tail_bias(spark, d):
    return evaluate.tail_bias(tailed(spark, d), ["method", "tail"])


@query("s: method, d: rmse rmse_low rmse_center rmse_high", f"WITH {TA} SELECT method, sqrt(avg(pow(predicted - observed, 2))) AS rmse, {', '.join(f'''sqrt(avg(pow(predicted - observed, 2)) FILTER (tail = '{t}')) AS rmse_{t}''' for t in ('low', 'center', 'high'))} FROM ta GROUP BY method")
def tail_metrics(spark, d):
    return evaluate.tail_metrics(tailed(spark, d), ["method"])


@query("s: method, d: offset_low offset_high", f"WITH {TA} SELECT method, CASE WHEN count(*) FILTER (tail = 'low') >= 5 THEN 0.5 * avg(observed - predicted) FILTER (tail = 'low') END AS offset_low, CASE WHEN count(*) FILTER (tail = 'high') >= 5 THEN 0.5 * avg(observed - predicted) FILTER (tail = 'high') END AS offset_high FROM ta GROUP BY method")
def tail_offset_mixture(spark, d):
    return evaluate.tail_offsets(tailed(spark, d), ["method"], "tail", 0.5)


@query("s: method, l: entities, d: top_1_share top_5_share top_10_share top_10pct_share top_20pct_share", f"WITH {PR}, s AS (SELECT method, user_id, sum(pow(predicted - observed, 2)) AS e FROM pr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY e DESC, user_id) AS i, count(*) OVER (PARTITION BY method) AS n FROM s) SELECT method, count(*) AS entities, sum(e) FILTER (i <= 1) / sum(e) AS top_1_share, sum(e) FILTER (i <= 5) / sum(e) AS top_5_share, sum(e) FILTER (i <= 10) / sum(e) AS top_10_share, sum(e) FILTER (i <= ceil(n * 0.1)) / sum(e) AS top_10pct_share, sum(e) FILTER (i <= ceil(n * 0.2)) / sum(e) AS top_20pct_share FROM r GROUP BY method")
def sse_concentration(spark, d):
    return evaluate.sse_concentration(predictions(spark, d), ["method"], "user_id")


@query("l: user_id, s: method, l: splits, d: mean_residual median_residual std_residual max_abs_residual rmse", f"WITH {PR} SELECT user_id, method, count(DISTINCT split_id) AS splits, avg(predicted - observed) AS mean_residual, median(predicted - observed) AS median_residual, CASE WHEN count(*) > 1 THEN stddev_samp(predicted - observed) ELSE 0 END AS std_residual, max(abs(predicted - observed)) AS max_abs_residual, sqrt(avg(pow(predicted - observed, 2))) AS rmse FROM pr GROUP BY ALL")
def residual_rollup(spark, d):
    return evaluate.residual_rollup(predictions(spark, d), ["user_id", "method"])


@query("l: id, s: method, d: disagreement predicted residual", f"WITH {PR} SELECT id, method, disagreement, predicted, predicted - observed AS residual FROM (SELECT *, greatest(m_user, m_type, m_pos) - least(m_user, m_type, m_pos) AS disagreement, (m_user + m_type + m_pos) / 3 AS mm FROM base) CROSS JOIN LATERAL (VALUES ('m_user', m_user), ('m_type', m_type), ('m_pos', m_pos), ('mean_of_methods', mm)) t(method, predicted)")
def residual_long(spark, d):
    return evaluate.residual_long(base(spark, d), ["id"], "observed", METHODS)


@query("s: method other, l: n, d: r", f"WITH {PR} SELECT a.method, b.method AS other, count(*) AS n, corr(a.predicted - a.observed, b.predicted - b.observed) AS r FROM pr a JOIN pr b ON a.id = b.id AND a.method < b.method GROUP BY ALL")
def residual_correlation(spark, d):
    return evaluate.residual_correlation(predictions(spark, d), ["id"])


@query("s: a b, d: jaccard", f"WITH {PR}, r AS (SELECT method, user_id, row_number() OVER (PARTITION BY method ORDER BY e DESC, user_id) AS i FROM (SELECT method, user_id, max(abs(predicted - observed)) AS e FROM pr GROUP BY ALL)), s AS (SELECT * FROM r WHERE i <= 10), n AS (SELECT a.method AS a, b.method AS b, count(*) FILTER (a.user_id = b.user_id) AS k FROM s a, s b WHERE a.method < b.method GROUP BY ALL) SELECT a, b, k * 1.0 / (20 - k) AS jaccard FROM n")
def topk_jaccard(spark, d):
    e = predictions(spark, d).groupBy("method", "user_id").agg(F.max(F.abs(F.col("predicted") - F.col("observed"))).alias("e"))
    return evaluate.top_overlap(e, "method", "user_id", "e", 10)


@query("s: method, d: score_a score_b mean worst gap", f"WITH {PR}, s AS (SELECT method, CASE WHEN split_id < 8 THEN 'a' ELSE 'b' END AS protocol, sqrt(avg(pow(predicted - observed, 2))) AS rmse FROM pr GROUP BY ALL) SELECT method, max(rmse) FILTER (protocol = 'a') AS score_a, max(rmse) FILTER (protocol = 'b') AS score_b, avg(rmse) AS mean, max(rmse) AS worst, max(rmse) - min(rmse) AS gap FROM s GROUP BY method")
def robustness_pivot(spark, d):
    p = predictions(spark, d).withColumn("protocol", F.when(F.col("split_id") < 8, "a").otherwise("b"))
    return evaluate.robustness(evaluate.metrics(p, ["method", "protocol"]), "method", "protocol", "rmse", ["a", "b"])


@query("d: weight rmse", f"WITH {PR} SELECT w AS weight, sqrt(avg(pow(w * m_user + (1 - w) * m_type - observed, 2))) AS rmse FROM base CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) t(w) GROUP BY w")
def blend_weights(spark, d):
    b = evaluate.blends(base(spark, d), "m_user", "m_type", [0.0, 0.25, 0.5, 0.75, 1.0])
    return b.groupBy("weight").agg(evaluate.error_metrics()["rmse"].alias("rmse"))


@query("l: id, s: method, d: observed predicted", f"WITH {PR} SELECT id, 'pair' AS method, observed, (m_user + m_type) / 2 AS predicted FROM base")
def equal_ensemble(spark, d):
    return evaluate.ensemble(predictions(spark, d), ["id"], ["m_user", "m_type"], "pair")


@query("l: id, s: method, d: predicted", f"WITH {PR}, c AS (SELECT split_id, avg(observed) AS c FROM base WHERE id % 5 <> 0 GROUP BY split_id) SELECT id, method, c + 1.3 * (predicted - c) AS predicted FROM pr JOIN c USING (split_id) WHERE id % 5 = 0")
def stretch_calibration(spark, d):
    return evaluate.stretch(predictions(spark, d).withColumn("train", F.col("id") % 5 != 0), ["split_id"], "train", 1.3)


@query("l: id, d: routed", f"WITH {PR} SELECT id, m_user + CASE WHEN (id % 10) / 10.0 < 0.6 AND (id % 7) / 7.0 < 0.6 THEN m_type - m_user ELSE 0 END AS routed FROM base")
def abstention_gate(spark, d):
    b = base(spark, d).withColumn("predicted", F.col("m_user")).withColumn("delta", F.col("m_type") - F.col("m_user")).withColumn("a", (F.col("id") % 10) / 10.0).withColumn("b", (F.col("id") % 7) / 7.0)
    return b.select("id", evaluate.abstain("delta", "a", "b", 0.6).alias("routed"))


@query("d: max_abs_diff, l: unmatched", f"WITH {PR}, a AS (SELECT id, m_user AS x FROM base WHERE id % 11 <> 0), b AS (SELECT id, m_type AS y FROM base WHERE id % 13 <> 0) SELECT max(abs(x - y)) AS max_abs_diff, count(*) FILTER (x IS NULL OR y IS NULL) AS unmatched FROM a FULL JOIN b ON a.id = b.id")
def control_parity(spark, d):
    b = base(spark, d)
    return evaluate.control_parity(b.where("id % 11 <> 0").select("id", F.col("m_user").alias("p")), b.where("id % 13 <> 0").select("id", F.col("m_type").alias("p")), ["id"], "p")


@query("s: method, l: missing repeated", f"WITH {PR}, k AS (SELECT id, method FROM pr WHERE NOT (method = 'm_pos' AND id % 9 = 0) UNION ALL SELECT id, method FROM pr WHERE method = 'm_user' AND id % 8 = 0), s AS (SELECT id, method, count(*) AS n FROM k GROUP BY ALL), e AS (SELECT DISTINCT id, m.method FROM base, (VALUES ('m_user'), ('m_type'), ('m_pos')) m(method)) SELECT e.method, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated FROM e LEFT JOIN s USING (id, method) GROUP BY e.method")
def oof_coverage(spark, d):
    p = predictions(spark, d)
    k = p.where("not (method = 'm_pos' and id % 9 = 0)").unionByName(p.where("method = 'm_user' and id % 8 = 0"))
    return evaluate.fold_coverage(k, p, ["id"])


@query("s: method, l: selected_folds, d: selection_rate mean_rank", f"WITH {PR}, r AS (SELECT split_id, method, row_number() OVER (PARTITION BY split_id ORDER BY e, method) AS k FROM (SELECT split_id, method, sqrt(avg(pow(predicted - observed, 2))) AS e FROM pr GROUP BY ALL)) SELECT method, count(DISTINCT split_id) AS selected_folds, count(DISTINCT split_id) / 16.0 AS selection_rate, avg(k) AS mean_rank FROM r WHERE k <= 2 GROUP BY method")
def recurrence(spark, d):
    m = evaluate.metrics(predictions(spark, d), ["split_id", "method"])
    r = m.withColumn("k", F.row_number().over(Window.partitionBy("split_id").orderBy("rmse", "method"))).where("k <= 2")
    return evaluate.recurrence(r, ["method"], "split_id", "k", 16)


# -- cells, contracts, windows ----------------------------------------------------------------------------------------
@query("l: zone, d: zonal_mean zonal_std zonal_min zonal_max zonal_median zonal_sum, l: zonal_count", "SELECT l_suppkey % 40 AS zone, avg(v) AS zonal_mean, stddev_pop(v) AS zonal_std, min(v) AS zonal_min, max(v) AS zonal_max, median(v) AS zonal_median, sum(v) AS zonal_sum, count(v) AS zonal_count FROM (SELECT l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END / 10 AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1")
def zonal_statistics(spark, d):
    c = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("value"))
    m = table(spark, d, "lineitem").select("l_suppkey").distinct().withColumn("zone", F.col("l_suppkey") % 40)
    return cells.zonal(c, m, ["l_suppkey"], "zone", "value", list(cells.ZONAL), 10.0)


@query("l: zone, d: weighted_mean plain_mean coverage, l: n_cells, d: effective_cells", "WITH c AS (SELECT s_suppkey AS cell, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal / 1000 END AS v FROM supplier), m AS (SELECT s_nationkey AS zone, s_suppkey AS cell, 0.25 + s_suppkey % 3 AS w FROM supplier) SELECT zone, sum(w * v) / sum(w) FILTER (v IS NOT NULL) AS weighted_mean, avg(v) AS plain_mean, coalesce(sum(w) FILTER (v IS NOT NULL), 0) / sum(w) AS coverage, count(v) AS n_cells, pow(sum(w) FILTER (v IS NOT NULL), 2) / sum(w * w) FILTER (v IS NOT NULL) AS effective_cells FROM m LEFT JOIN c USING (cell) GROUP BY zone")
def area_weighted_mean(spark, d):
    s = table(spark, d, "supplier")
    c = s.select(F.col("s_suppkey").alias("cell"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") / 1000).alias("v"))
    m = s.select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("cell"), (F.lit(0.25) + F.col("s_suppkey") % 3).cast("double").alias("w"))
    return cells.area_weighted(c, m, ["cell"], "zone", "v", "w")


@query("l: id area, d: overlap_fraction", f"WITH {CU}, b AS (SELECT id, (id % 10) * 1.0 AS x0, (id % 7) * 1.0 AS y0 FROM cu), a AS (SELECT n_nationkey AS area, (n_nationkey % 5) * 2.0 + 0.5 AS u0, (n_nationkey // 5) * 2.0 AS v0 FROM nation), o AS (SELECT id, area, greatest(0, least(x0 + 1.5, u0 + 2) - greatest(x0, u0)) * greatest(0, least(y0 + 1.5, v0 + 2) - greatest(y0, v0)) AS s FROM b, a), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, area) AS i, sum(s) OVER (PARTITION BY id) AS t FROM o WHERE s > 0) SELECT id, area, s / t AS overlap_fraction FROM r WHERE i = 1")
def largest_overlap(spark, d):
    """Boxes meet zones through the grid cells that they touch, by equality."""
    c = customers(spark, d).select("id", (F.col("id") % 10).cast("double").alias("x0"), (F.col("id") % 7).cast("double").alias("y0"))
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), ((F.col("n_nationkey") % 5) * 2.0 + 0.5).alias("u0"), (F.floor(F.col("n_nationkey") / 5) * 2.0).alias("v0"))

    def touched(x, y, size):
        xs = F.sequence(F.floor(F.col(x)).cast("int"), F.floor(F.col(x) + size).cast("int"))
        ys = F.sequence(F.floor(F.col(y)).cast("int"), F.floor(F.col(y) + size).cast("int"))
        return F.explode(F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("gx"), j.alias("gy"))))))

    left = c.select("*", touched("x0", "y0", 1.5).alias("g")).select("id", "x0", "y0", "g.*")
    right = a.select("*", touched("u0", "v0", 2.0).alias("g")).select("area", "u0", "v0", "g.*")
    met = left.join(F.broadcast(right), ["gx", "gy"]).dropDuplicates(["id", "area"])
    area = cells.overlap(F.col("x0"), F.col("y0"), F.col("x0") + 1.5, F.col("y0") + 1.5, F.col("u0"), F.col("v0"), F.col("u0") + 2.0, F.col("v0") + 2.0)
    return cells.largest_overlap(met.withColumn("s", area).where("s > 0"), "id", "area", "s")


@query("l: id, d: area cx cy", f"WITH {CU} SELECT id, 2.0 * (1 + id % 5) * (1 + id % 3) AS area, id % 10 + (1 + id % 5) AS cx, id % 7 + (1 + id % 3) / 2.0 AS cy FROM cu")
def ring_geometry(spark, d):
    c = customers(spark, d).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), (2.0 * (1 + F.col("id") % 5)).alias("w"), (1.0 + F.col("id") % 3).alias("h"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    zero = F.lit(0.0)
    c = c.withColumn("ring", F.array(at(zero, zero), at(F.col("w"), zero), at(F.col("w"), F.col("h")), at(zero, F.col("h")), at(zero, zero)))
    cx, cy = cells.ring_centroid(F.col("ring"))
    return c.select("id", cells.ring_area(F.col("ring")).alias("area"), cx.alias("cx"), cy.alias("cy"))


BANDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("l: o_custkey files, s: missing_bands, b: complete", f"WITH a AS (SELECT DISTINCT o_custkey, b FROM orders, (VALUES {', '.join(f'''('{b}')''' for b in BANDS)}) t(b)), h AS (SELECT DISTINCT o_custkey, o_orderpriority AS b FROM orders), m AS (SELECT o_custkey, string_agg(b, ',' ORDER BY b) AS mb FROM a ANTI JOIN h USING (o_custkey, b) GROUP BY o_custkey) SELECT o.o_custkey, count(*) AS files, coalesce(any_value(mb), '') AS missing_bands, any_value(mb) IS NULL AS complete FROM orders o LEFT JOIN m USING (o_custkey) GROUP BY o.o_custkey")
def complete_scenes(spark, d):
    return cells.complete_scenes(table(spark, d, "orders"), "o_custkey", "o_orderpriority", BANDS)


@query("s: variable, l: year month", "SELECT v AS variable, y AS year, m AS month FROM (VALUES ('F'), ('O'), ('P')) a(v), range(1995, 2003) b(y), range(1, 13) c(m) WHERE (v, y, m) NOT IN (SELECT o_orderstatus, year(o_orderdate), month(o_orderdate) FROM orders)")
def missing_inventory(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("variable"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return cells.missing_inventory(o, ["F", "O", "P"], list(range(1995, 2003)), list(range(1, 13)))


@query("l: user_id event_id, s: window_", f"WITH {EV}, w AS (SELECT * FROM (VALUES ('w1', DATE '2024-01-01', DATE '2024-01-10', DATE '2024-01-05'), ('w2', DATE '2024-01-11', DATE '2024-01-25', DATE '2024-01-18')) t(wn, s, e, mid)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, wn ORDER BY cloud ASC NULLS LAST, full_value DESC, abs(d - mid), event_id) AS i FROM ev JOIN w ON d BETWEEN s AND e) SELECT user_id, event_id, wn AS win FROM r WHERE i = 1".replace("AS win", "AS window_"))
def best_scene(spark, d):
    w = spark.createDataFrame([("w1", "2024-01-01", "2024-01-10", "2024-01-05"), ("w2", "2024-01-11", "2024-01-25", "2024-01-18")], "window string, start string, end string, middle string")
    w = w.select("window", *(F.to_date(c).alias(c) for c in ("start", "end", "middle")))
    return cells.best_scene(events(spark, d), "user_id", w, "d", [F.col("cloud").asc_nulls_last(), F.desc("full_value")]).withColumnRenamed("window", "window_")


@query("s: name status, l: observed", f"WITH {CU}, s AS (SELECT id, CASE WHEN id % 97 = 0 THEN NULL ELSE y END AS y, train FROM cu), c AS (SELECT 0 AS null_keys, count(id) - count(DISTINCT id) AS repeated_keys, 0 AS unknown_split, count(*) FILTER (train AND y IS NULL) AS train_without_target, count(*) FILTER (NOT train AND y IS NOT NULL) AS predict_with_target FROM s) SELECT name, CASE WHEN observed = 0 THEN 'ok' ELSE 'error' END AS status, observed FROM c CROSS JOIN LATERAL (VALUES ('null_keys', null_keys), ('repeated_keys', repeated_keys), ('unknown_split', unknown_split), ('train_without_target', train_without_target), ('predict_with_target', predict_with_target)) t(name, observed)")
def contract_checks(spark, d):
    c = customers(spark, d).withColumn("y", F.when(F.col("id") % 97 != 0, F.col("y")))
    return contract.split_contract(c, "id", "y", "train", True, False)


@query("s: event_type, l: n_rows entities, t: first_date last_date, l: repeated_rows, d: missing_v missing_cloud", f"WITH {EV}, g AS (SELECT event_type, user_id, d, count(*) AS n, count(v) AS v, count(cloud) AS c FROM ev GROUP BY ALL) SELECT event_type, sum(n) AS n_rows, count(DISTINCT user_id) AS entities, min(d) AS first_date, max(d) AS last_date, sum(n - 1) AS repeated_rows, 1 - sum(v) * 1.0 / sum(n) AS missing_v, 1 - sum(c) * 1.0 / sum(n) AS missing_cloud FROM g GROUP BY event_type")
def panel_audit(spark, d):
    return contract.panel_audit(events(spark, d), "user_id", "ts", "event_type", ["v", "cloud"]).withColumnRenamed("rows", "n_rows")


@query("l: part, d: median_rows, l: min_rows max_rows, d: median_dates", f"WITH {EV}, g AS (SELECT user_id % 2 AS part, user_id, count(*) AS n, count(DISTINCT d) AS k FROM ev GROUP BY ALL) SELECT part, median(n) AS median_rows, min(n) AS min_rows, max(n) AS max_rows, median(k) AS median_dates FROM g GROUP BY part")
def coverage_by_split(spark, d):
    return contract.coverage_by_split(events(spark, d).withColumn("part", F.col("user_id") % 2), "user_id", "ts", "part")


@query("s: col_, l: missing distinct_", f"WITH {CU} SELECT c AS col_, m AS missing, k AS distinct_ FROM (SELECT count(*) - count(x1) AS m1, count(DISTINCT x1) AS k1, count(*) - count(y) AS m2, count(DISTINCT y) AS k2 FROM cu) CROSS JOIN LATERAL (VALUES ('x1', m1, k1), ('y', m2, k2)) t(c, m, k)")
def data_profile(spark, d):
    return contract.profile(customers(spark, d).select("x1", "y")).withColumnsRenamed({"column": "col_", "distinct": "distinct_"})


@query("z: window_start, s: event_type, l: n, m: total", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "6 hours", ["event_type"], "value")


@query("l: user_id, z: session_start, l: n, m: total", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER o + INTERVAL 4 HOUR OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k")
def session_window(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "4 hours", ["user_id"], "value")


@query("s: family mode, l: n n_numeric", "SELECT CASE WHEN p_name LIKE '%widget%' THEN 'widget' WHEN p_name LIKE '%ring%' THEN 'ring' ELSE 'other' END AS family, p_type AS mode, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS n_numeric FROM part GROUP BY ALL")
def feature_inventory(spark, d):
    p = table(spark, d, "part")
    family = F.when(F.col("p_name").contains("widget"), "widget").when(F.col("p_name").contains("ring"), "ring").otherwise("other")
    return p.groupBy(family.alias("family"), F.col("p_type").alias("mode")).agg(F.count("*").alias("n"), F.sum((F.col("p_size") > 25).cast("long")).alias("n_numeric"))


@query("l: id, s: tier", f"WITH {ALL}, n AS (SELECT i, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM ed) WHERE r <= 3 GROUP BY i), q AS (SELECT *, (SELECT count(*) FROM n b WHERE b.m >= a.m) * 1.0 / (SELECT count(*) FROM n) AS s FROM n a) SELECT i AS id, CASE WHEN s >= 0.8 THEN 'A' WHEN s >= 0.6 THEN 'B' WHEN s >= 0.4 THEN 'C' WHEN s >= 0.2 THEN 'D' ELSE 'E' END AS tier FROM q")
def support_tiers(spark, d):
    """Share of rows at least as far from their neighbours, cut into five tiers: a running total over distinct distances."""
    m = near(spark, d, 3).groupBy("i").agg(F.avg("d").alias("m"))
    steps = stats.running_total(m.groupBy("m").agg(F.count("*").alias("n")), "m", "n", "reached", descending=True)
    whole = m.agg(F.count("*").alias("all_"))
    at_least = steps.crossJoin(F.broadcast(whole)).select("m", (F.col("reached") / F.col("all_")).alias("s"))
    s = F.col("s")
    return m.join(at_least, "m").select(F.col("i").alias("id"), F.when(s >= 0.8, "A").when(s >= 0.6, "B").when(s >= 0.4, "C").when(s >= 0.2, "D").otherwise("E").alias("tier"))
