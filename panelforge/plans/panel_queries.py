"""Queries over the events panel: recipes, filters, summaries, alignment, trajectories.

Stand-ins: entity = user_id, sensor = event_type, variable = value (missing where event_id % 7 = 0), cloud = props.k (missing
where event_id % 11 = 0), season = seven positions 4..10 in the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import expressions as X
from panelforge.operators import checks, filters, panel, recipes, temporal
from panelforge.operators import trajectories as T
from panelforge.plans.registry import query, table

SENSORS = ["click", "error", "purchase", "signup", "view"]
MONTHS = [4, 5, 6, 7, 8, 9, 10]
EV = """ev AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, value AS full_value,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS cloud, 4 + ((day(ts) - 1) * 7) // 30 AS p, CAST(ts AS DATE) AS d FROM events)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.col("value").alias("full_value"),
        F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k").cast("double")).alias("cloud"), (4 + F.floor((F.dayofmonth("ts") - 1) * 7 / 30)).cast("int").alias("p"), F.to_date("ts").alias("d"),
    )


def recipe(spark, d, how):
    r = recipes.FeatureRecipe("feature", "v", "user_id", how, "ts", "2024-01-03", "2024-01-28")
    return recipes.apply_recipe(events(spark, d), r, "event_id")


WINDOWED = f"WITH {EV}, w AS (SELECT user_id, v, event_id, epoch_us(ts) / 86400000000.0 AS t FROM ev WHERE v IS NOT NULL AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-28')"
for how, agg in {"mean": "avg(v)", "median": "median(v)", "min": "min(v)", "max": "max(v)", "std": "CASE WHEN count(v) > 1 THEN stddev_samp(v) END", "sum": "sum(v)"}.items():
    query("l: user_id, d: feature", f"{WINDOWED} SELECT user_id, {agg} AS feature FROM w GROUP BY user_id", f"recipe_{how}")(lambda s, d, how=how: recipe(s, d, how))
query("l: user_id, d: feature", f"{WINDOWED} SELECT user_id, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN regr_slope(v, t) END AS feature FROM w GROUP BY user_id", "recipe_slope")(lambda s, d: recipe(s, d, "slope"))
query(
    "l: user_id, d: feature",
    f"{WINDOWED}, l AS (SELECT *, lag(v) OVER o AS pv, lag(t) OVER o AS pt FROM w WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN sum((v + pv) / 2 * (t - pt)) END AS feature FROM l GROUP BY user_id",
    "recipe_auc",
)(lambda s, d: recipe(s, d, "auc"))


@query(
    "l: user_id, d: slope area",
    f"{WINDOWED}, l AS (SELECT *, lag(v) OVER o AS pv, lag(t) OVER o AS pt FROM w WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN regr_slope(v, t) END AS slope, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN sum((v + pv) / 2 * (t - pt)) END AS area FROM l GROUP BY user_id",
)
def recipes_merged(spark, d):
    """Two features of the same groups joined 1:1."""
    a, b = (recipe(spark, d, h).withColumnRenamed("feature", n) for h, n in (("slope", "slope"), ("auc", "area")))
    return recipes.merge_features(a, b, on="user_id")


@query("l: event_id user_id, s: event_type, d: v", f"WITH {EV} SELECT event_id, user_id, event_type, v FROM ev WHERE event_type IN ('view', 'click') AND v BETWEEN 20 AND 200.5 AND regexp_matches(event_type, '(?i)IE|Lic') AND cloud IS NOT NULL")
def filter_declarative(spark, d):
    return filters.filter_frame(events(spark, d), filters.FilterSpec({"event_type": ["view", "click"], "user_id": []}, {"v": (20, 200.5)}, {"event_type": "IE|Lic"}, ["cloud"]))


@query("l: event_id user_id", f"WITH {EV} SELECT event_id, user_id FROM ev WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND month(d) IN (1, 2)")
def filter_period(spark, d):
    return events(spark, d).where(filters.in_period("ts", "2024-01-05", "2024-01-12", [1, 2]))


@query("l: event_id, d: number", f"WITH {EV} SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(full_value AS VARCHAR) END AS DOUBLE) AS number FROM ev")
def coerce_numeric(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("full_value").cast("string"))
    return events(spark, d).select("event_id", X.num(text).alias("number"))


@query("l: event_id, d: v cloud", f"WITH {EV} SELECT event_id, v, cloud FROM ev WHERE v IS NOT NULL AND cloud IS NOT NULL")
def drop_missing(spark, d):
    return events(spark, d).dropna("any", subset=["v", "cloud"])


@query("l: event_id, s: regime", f"WITH {EV} SELECT event_id, CASE WHEN v <= 30 THEN 'low' WHEN v >= 150 THEN 'high' WHEN v IS NOT NULL THEN 'center' END AS regime FROM ev")
def case_tails(spark, d):
    return events(spark, d).select("event_id", X.tails("v", F.lit(30), F.lit(150)).alias("regime"))


@query("l: event_id, b: clear usable", f"WITH {EV} SELECT event_id, coalesce((CAST(cloud AS INT) & 7) = 0, false) AS clear, coalesce(cloud > 10 AND cloud < 90 AND cloud <> 50, false) AS usable FROM ev")
def bitmask_and_range(spark, d):
    return events(spark, d).select("event_id", X.bits_clear(F.col("cloud").cast("int"), 7).alias("clear"), F.coalesce(X.in_range("cloud", 10, 90, 50), F.lit(False)).alias("usable"))


@query("l: event_id, d: decoded", f"WITH {EV} SELECT event_id, CASE WHEN cloud <> 7 THEN cloud * 0.02 + 1.5 END AS decoded FROM ev")
def packed_decode(spark, d):
    return events(spark, d).select("event_id", X.decode("cloud", 7, 0.02, 1.5).alias("decoded"))


names = ["product", "sum", "difference", "reverse_difference", "safe_ratio", "reverse_safe_ratio", "symmetric_change"]


@query(
    f"l: event_id, d: {' '.join('e_' + n for n in names)}",
    f"WITH {EV}, x AS (SELECT event_id, v AS a, cloud - 50 AS b FROM ev) SELECT event_id, a * b AS e_product, a + b AS e_sum, a - b AS e_difference, b - a AS e_reverse_difference, a / (b + CASE WHEN b < 0 THEN -1e-6 ELSE 1e-6 END) / 1e6 AS e_safe_ratio, b / (a + CASE WHEN a < 0 THEN -1e-6 ELSE 1e-6 END) AS e_reverse_safe_ratio, 2 * (a - b) / (abs(a) + abs(b) + 1e-6) AS e_symmetric_change FROM x",
)
def pair_expressions(spark, d):
    e = events(spark, d).select("event_id", F.col("v").alias("a"), (F.col("cloud") - 50).alias("b"))
    made = X.pair_expressions("a", "b")
    made["safe_ratio"] = made["safe_ratio"] / 1e6
    return e.select("event_id", *(c.alias(f"e_{n}") for n, c in made.items()))


@query(
    "l: event_id, d: safe change slog ssq lbasis clipped nd",
    f"WITH {EV}, x AS (SELECT event_id, v AS a, cloud - 50 AS b FROM ev) SELECT event_id, CASE WHEN abs(b) > 1e-12 THEN a / b END AS safe, CASE WHEN abs(a) + abs(b) > 1e-12 THEN 2 * (a - b) / (abs(a) + abs(b)) END AS change, sign(b) * ln(1 + abs(b)) AS slog, sign(b) * b * b AS ssq, CASE WHEN b >= 0 THEN ln(1 + b) END AS lbasis, CASE WHEN b IS NOT NULL THEN greatest(-20, least(20, b)) END AS clipped, CASE WHEN abs(a + b) > 1e-6 THEN (a - b) / (a + b) END AS nd FROM x",
)
def scalar_transforms(spark, d):
    e = events(spark, d).select("event_id", F.col("v").alias("a"), (F.col("cloud") - 50).alias("b"))
    return e.select("event_id", X.ratio("a", "b").alias("safe"), X.symmetric_change("a", "b").alias("change"), X.signed_log("b").alias("slog"), X.signed_square("b").alias("ssq"), X.log1p_basis("b").alias("lbasis"), X.clip("b", -20, 20).alias("clipped"), X.normalized_difference("a", "b").alias("nd"))


@query(
    "l: event_id, s: slug label padded month, l: doy",
    f"WITH {EV} SELECT event_id, 'sitio_nandu_' || event_type || '_a1' AS slug, 'año ' || event_type AS raw, 'ano ' || event_type AS label, CASE WHEN length(CAST(event_id AS VARCHAR)) < 5 THEN lpad(CAST(event_id AS VARCHAR), 5, '0') ELSE CAST(event_id AS VARCHAR) END AS padded, strftime(ts, '%Y_%m') AS month, dayofyear(ts) AS doy FROM ev",
)
def text_and_dates(spark, d):
    e = events(spark, d)
    return e.select(
        "event_id", X.slug(F.concat(F.lit(" Sitio-Ñandú "), "event_type", F.lit(" (Á1)"))).alias("slug"), X.label(F.concat(F.lit("  AÑO  "), F.upper("event_type"), F.lit(" "))).alias("label"),
        X.zero_pad("event_id", 5).alias("padded"), F.date_format("ts", "yyyy_MM").alias("month"), F.dayofyear("ts").alias("doy"),
    )


@query("l: event_id, d: wa wb wc, s: digest", f"WITH {EV}, x AS (SELECT event_id, event_type, v / 100 AS a, cloud / 100 AS b, p / 10.0 AS c FROM ev WHERE v IS NOT NULL AND cloud IS NOT NULL) SELECT event_id, exp(a) / (exp(a) + exp(b) + exp(c)) AS wa, exp(b) / (exp(a) + exp(b) + exp(c)) AS wb, exp(c) / (exp(a) + exp(b) + exp(c)) AS wc, sha256(event_type) AS digest FROM x")
def softmax_and_digest(spark, d):
    e = events(spark, d).dropna(subset=["v", "cloud"]).select("event_id", "event_type", (F.col("v") / 100).alias("a"), (F.col("cloud") / 100).alias("b"), (F.col("p") / 10.0).alias("c"))
    w = X.softmax(["a", "b", "c"])
    return e.select("event_id", w[0].alias("wa"), w[1].alias("wb"), w[2].alias("wc"), F.sha2("event_type", 256).alias("digest"))


@query("l: user_id, d: complete partial weighted", f"WITH {EV}, x AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN v END) AS a, avg(CASE WHEN event_type = 'view' AND p < 6 THEN v END) AS b, avg(CASE WHEN event_type = 'error' AND p = 9 THEN v END) AS c FROM ev GROUP BY user_id) SELECT user_id, a + b + c AS complete, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END AS partial, (a * 5 + b * 10 + c * 15) / 30 AS weighted FROM x")
def complete_and_partial_sums(spark, d):
    """Sums over layers: complete case, of what is there, and depth-weighted."""
    e = events(spark, d)
    m = lambda t, cond: F.avg(F.when((F.col("event_type") == t) & cond, F.col("v")))
    x = e.groupBy("user_id").agg(m("click", F.lit(True)).alias("a"), m("view", F.col("p") < 6).alias("b"), m("error", F.col("p") == 9).alias("c"))
    return x.select("user_id", X.total(["a", "b", "c"]).alias("complete"), X.total_some(["a", "b", "c"]).alias("partial"), X.weighted_mean(["a", "b", "c"], [5, 10, 15]).alias("weighted"))


STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
cells = [(s, v, n, f) for s in SENSORS for v in ("v", "cloud") for n, f in STATS.items()]


@query(
    f"l: user_id, d: {' '.join(f'sat__{s}__{v}__{n}' for s, v, n, _ in cells)}",
    f"WITH {EV} SELECT user_id, {', '.join(f'''CASE WHEN count({v}) FILTER (event_type = '{s}') > {1 if n == 'std' else 0} THEN {f}({v}) FILTER (event_type = '{s}') END AS sat__{s}__{v}__{n}''' for s, v, n, f in cells)} FROM ev GROUP BY user_id",
)
def period_sensor_summary(spark, d):
    return panel.period_summary(events(spark, d), "user_id", "event_type", ["v", "cloud"], SENSORS, "sat")


cov = {"n_records": "count(*)", "n_dates": "count(DISTINCT d)", "cloud_mean": "avg(cloud)", "cloud_median": "median(cloud)", "valid_fraction": "avg((CASE WHEN v IS NULL THEN 0 ELSE 1 END + CASE WHEN cloud IS NULL THEN 0 ELSE 1 END) / 2.0)"}


@query(
    f"l: user_id, d: {' '.join(f'cov__{s}__{n}' for s in SENSORS for n in cov)}",
    f"WITH {EV} SELECT user_id, {', '.join(f'''CASE WHEN count(*) FILTER (event_type = '{s}') > 0 THEN {a} FILTER (event_type = '{s}') END AS cov__{s}__{n}''' for s in SENSORS for n, a in cov.items())} FROM ev GROUP BY user_id",
)
def panel_coverage(spark, d):
    return panel.coverage(events(spark, d), "user_id", "event_type", "ts", "cloud", ["v", "cloud"], SENSORS, "cov")


@query(
    f"l: user_id, d: {' '.join(f'clim__{s}__v__m{p:02d}' for s in SENSORS[:3] for p in MONTHS)}",
    f"WITH {EV} SELECT user_id, {', '.join(f'''avg(v) FILTER (event_type = '{s}' AND p = {p}) AS clim__{s}__v__m{p:02d}''' for s in SENSORS[:3] for p in MONTHS)} FROM ev GROUP BY user_id",
)
def monthly_means_wide(spark, d):
    return panel.position_means(events(spark, d), "user_id", "event_type", "p", "v", SENSORS[:3], MONTHS, "clim")


@query("s: event_type, d: mean median std min max, l: count", f"WITH {EV}, g AS (SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type, v FROM ev) SELECT event_type, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, count(v) AS count FROM g GROUP BY event_type")
def group_summary(spark, d):
    return panel.group_summary(events(spark, d).withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type"))), "event_type", "v")


@query("s: event_type, l: n, d: share", "SELECT event_type, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def value_shares(spark, d):
    return panel.shares(table(spark, d, "events"), "event_type")


@query("l: user_id, s: event_type, l: n, d: share", "SELECT user_id, event_type, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY user_id, event_type")
def value_shares_by_user(spark, d):
    return panel.shares(table(spark, d, "events"), "event_type", ["user_id"])


@query("d: total_variation", f"WITH {EV}, s AS (SELECT p, event_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY p) AS q FROM ev WHERE p IN (4, 9) GROUP BY p, event_type) SELECT sum(abs(coalesce(a.q, 0) - coalesce(b.q, 0))) / 2 AS total_variation FROM (SELECT * FROM s WHERE p = 4) a FULL JOIN (SELECT * FROM s WHERE p = 9) b ON a.event_type = b.event_type")
def total_variation(spark, d):
    return panel.total_variation(events(spark, d), "event_type", "p", 4, 9)


@query(f"l: user_id {' '.join(f'has_{s}' for s in SENSORS)}", f"WITH {EV} SELECT user_id, {', '.join(f'''CASE WHEN count(*) FILTER (event_type = '{s}') > 0 THEN 1 ELSE 0 END AS has_{s}''' for s in SENSORS)} FROM ev GROUP BY user_id")
def presence_matrix(spark, d):
    return panel.presence(events(spark, d), "user_id", "event_type", SENSORS)


@query("l: user_id, d: v cloud, s: event_type", f"WITH {EV} SELECT user_id, avg(v) AS v, avg(cloud) AS cloud, min(event_type) AS event_type FROM ev GROUP BY user_id")
def collapse_to_entity(spark, d):
    return panel.collapse(events(spark, d).select("user_id", "v", "cloud", "event_type"), "user_id")


@query("l: user_id event_id, s: event_type", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n <= 5 OR i = 0 OR floor(i * 4 / (n - 1)) > floor((i - 1) * 4 / (n - 1))")
def evenly_spaced_sample(spark, d):
    return panel.evenly_spaced(table(spark, d, "events"), ["event_id"], 5, ["user_id"])


@query("l: user_id event_id, s: part", "SELECT user_id, event_id, 'a' AS part FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, event_id, NULL AS part FROM events WHERE event_id % 3 <> 0")
def union_of_blocks(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return panel.union_all(e.where("event_id % 3 = 0").withColumn("part", F.lit("a")), e.where("event_id % 3 <> 0"))


GAPS = f"WITH {EV}, dd AS (SELECT user_id, event_type, d, d - lag(d) OVER (PARTITION BY user_id, event_type ORDER BY d) AS gap FROM (SELECT DISTINCT user_id, event_type, d FROM ev)), g AS (SELECT user_id, event_type, count(*) AS n_unique_dates, median(gap) AS median_gap_days, max(gap) AS max_gap_days FROM dd GROUP BY user_id, event_type)"


@query(
    "l: user_id, s: event_type, l: n_records n_unique_dates, t: first_date last_date, l: span_days, d: median_gap_days, l: max_gap_days, d: cloud_mean cloud_median, l: n_2024_01",
    f"{GAPS} SELECT user_id, event_type, count(*) AS n_records, any_value(n_unique_dates) AS n_unique_dates, min(d) AS first_date, max(d) AS last_date, max(d) - min(d) AS span_days, any_value(median_gap_days) AS median_gap_days, any_value(max_gap_days) AS max_gap_days, avg(cloud) AS cloud_mean, median(cloud) AS cloud_median, count(*) FILTER (strftime(d, '%Y_%m') = '2024_01') AS n_2024_01 FROM ev JOIN g USING (user_id, event_type) GROUP BY user_id, event_type",
)
def coverage_gaps(spark, d):
    return temporal.coverage_gaps(events(spark, d), ["user_id", "event_type"], "ts", "cloud")


@query("t: grid_date", "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 5 DAY)) AS DATE) AS grid_date")
def grid_expand(spark, d):
    return temporal.grid(spark, "2024-01-01", "2024-01-30", 5)


def align_sql(k: int, cloudy: bool) -> str:
    share = "(1 - greatest(0, least(100, coalesce(c, 0))) / 100)" if cloudy else "1.0"
    one = lambda x: f"rk_{x} AS (SELECT user_id, event_type, g, {x} AS y, w, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY gap, day) AS r FROM n WHERE {x} IS NOT NULL), m_{x} AS (SELECT user_id, event_type, g, CASE WHEN sum(w) > 0 THEN sum(y * w) / sum(w) END AS {x} FROM rk_{x} WHERE r <= {k} GROUP BY ALL)"
    return f"""WITH {EV}, daily AS (SELECT user_id, event_type, d AS day, avg(v) AS v, avg(full_value) AS u, avg(cloud) AS c FROM ev GROUP BY ALL), grid AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 14 DAY)) AS DATE) AS g),
 keys AS (SELECT DISTINCT user_id, event_type FROM daily), kg AS (SELECT * FROM keys, grid), n AS (SELECT kg.user_id, kg.event_type, g, day, v, u, abs(g - day) AS gap, exp(-abs(g - day) / 7.0) * {share} AS w FROM kg JOIN daily b ON kg.user_id = b.user_id AND kg.event_type = b.event_type AND abs(g - day) <= 6),
 c AS (SELECT user_id, event_type, g, least(count(*), {k}) AS neighbor_count, min(gap) AS nearest_gap_days FROM n GROUP BY ALL), {one('v')}, {one('u')}
 SELECT kg.user_id, kg.event_type, kg.g AS grid_date, coalesce(neighbor_count, 0) AS neighbor_count, nearest_gap_days, m_v.v, m_u.u FROM kg LEFT JOIN c ON (kg.user_id, kg.event_type, kg.g) = (c.user_id, c.event_type, c.g) LEFT JOIN m_v ON (kg.user_id, kg.event_type, kg.g) = (m_v.user_id, m_v.event_type, m_v.g) LEFT JOIN m_u ON (kg.user_id, kg.event_type, kg.g) = (m_u.user_id, m_u.event_type, m_u.g)"""


ALIGNED = "l: user_id, s: event_type, t: grid_date, l: neighbor_count nearest_gap_days, d: v u"


def align(spark, d, k, cloud):
    e = events(spark, d).withColumnRenamed("full_value", "u")
    return temporal.align_nearest(e, "user_id", "event_type", "ts", ["v", "u"], temporal.grid(spark, "2024-01-01", "2024-01-30", 14), k, 7.0, 6, cloud)


query(ALIGNED, align_sql(1, False), "knn_align_k1")(lambda s, d: align(s, d, 1, None))
query(ALIGNED, align_sql(3, True), "knn_align_k3_cloud")(lambda s, d: align(s, d, 3, "cloud"))
DATES = ["2024-01-01", "2024-01-15", "2024-01-29"]
tag = [f"{s}__v__{x.replace('-', '_')}" for s in ("click", "view") for x in DATES]


@query(
    f"l: user_id, d: {' '.join(tag)}",
    f"WITH al AS ({align_sql(3, True)}) SELECT user_id, {', '.join(f'''max(v) FILTER (event_type = '{s}' AND grid_date = DATE '{x}') AS {s}__v__{x.replace('-', '_')}''' for s in ('click', 'view') for x in DATES)} FROM al WHERE event_type IN ('click', 'view') GROUP BY user_id",
)
def aligned_wide(spark, d):
    a = align(spark, d, 3, "cloud").where(F.col("event_type").isin("click", "view"))
    a = a.withColumn("tag", F.concat_ws("__", "event_type", F.lit("v"), F.date_format("grid_date", "yyyy_MM_dd")))
    return a.groupBy("user_id").pivot("tag", tag).agg(F.first("v"))


ANTE = f"WITH {EV}, daily AS (SELECT user_id, d, avg(v) AS v FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL), marks AS (SELECT DISTINCT user_id, d FROM ev WHERE event_type = 'purchase')"


@query(
    "l: user_id, t: date, d: mean_7d mean_14d",
    f"{ANTE} SELECT m.user_id, m.d AS date, avg(b.v) FILTER (b.d >= m.d - 7) AS mean_7d, avg(b.v) AS mean_14d FROM marks m LEFT JOIN daily b ON b.user_id = m.user_id AND b.d < m.d AND b.d >= m.d - 14 GROUP BY m.user_id, m.d",
)
def antecedent_mean(spark, d):
    e = events(spark, d)
    return temporal.antecedent_mean(e.where("event_type = 'purchase'").select("user_id", "ts"), e.where("event_type in ('view', 'click')"), "user_id", "ts", "v", [7, 14])


DAILY = f"WITH {EV}, daily AS (SELECT user_id, d, sum(v) AS v FROM ev GROUP BY ALL)"


def daily(spark, d):
    return events(spark, d).groupBy("user_id", "d").agg(F.sum("v").alias("v"))


@query("l: user_id, t: d, d: roll", f"{DAILY} SELECT user_id, d, sum(v) OVER (PARTITION BY user_id ORDER BY d ROWS 4 PRECEDING) AS roll FROM daily")
def rolling5_sum(spark, d):
    return temporal.rolling_sum(daily(spark, d), ["user_id"], "d", "v", 5, "roll")


@query(
    "l: user_id longest_run",
    f"{DAILY}, f AS (SELECT user_id, d, coalesce(v < 100, false) AS ok FROM daily), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - row_number() OVER (PARTITION BY user_id, ok ORDER BY d) AS island FROM f), r AS (SELECT user_id, ok, count(*) AS n FROM g GROUP BY user_id, ok, island) SELECT user_id, coalesce(max(n) FILTER (ok), 0) AS longest_run FROM r GROUP BY user_id",
)
def longest_run(spark, d):
    return temporal.longest_run(daily(spark, d), ["user_id"], "d", F.col("v") < 100)


@query(
    "l: user_id, d: total mean max_1d max_5d, l: wet_days heavy_days dry_days longest_dry_spell",
    f"{DAILY}, f AS (SELECT *, coalesce(v < 50, false) AS ok, sum(v) OVER (PARTITION BY user_id ORDER BY d ROWS 4 PRECEDING) AS roll FROM daily), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - row_number() OVER (PARTITION BY user_id, ok ORDER BY d) AS island FROM f), r AS (SELECT user_id, coalesce(max(n) FILTER (ok), 0) AS longest_dry_spell FROM (SELECT user_id, ok, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY user_id) SELECT f.user_id, sum(v) AS total, avg(v) AS mean, max(v) AS max_1d, max(roll) AS max_5d, count(*) FILTER (v >= 50) AS wet_days, count(*) FILTER (v >= 300) AS heavy_days, count(*) FILTER (ok) AS dry_days, any_value(longest_dry_spell) AS longest_dry_spell FROM f JOIN r USING (user_id) GROUP BY f.user_id",
)
def daily_extremes(spark, d):
    return temporal.daily_extremes(daily(spark, d), "user_id", "d", "v", 50, 300)


@query("t: missing_date", "SELECT m AS missing_date FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS m) WHERE m NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def calendar_gaps(spark, d):
    return temporal.calendar_gaps(table(spark, d, "events"), "ts", "2023-12-28", "2024-02-03")


# -- trajectories -----------------------------------------------------------------------------------------------------
TR = f"{EV}, tr AS (SELECT user_id, event_type AS s, p AS x, avg(v) AS y FROM ev WHERE v IS NOT NULL AND event_type IN ('click', 'view') GROUP BY ALL), us AS (SELECT DISTINCT user_id FROM ev), a AS (SELECT * FROM tr WHERE s = 'click'), b AS (SELECT * FROM tr WHERE s = 'view')"


def wide(spark, d):
    out = panel.position_means(events(spark, d).where("event_type in ('click', 'view')"), "user_id", "event_type", "p", "v", ["click", "view"], MONTHS, "t", order="event_id")
    everyone = events(spark, d).select("user_id").distinct()
    return everyone.join(out, "user_id", "left")


A = {m: f"t__click__v__m{m:02d}" for m in MONTHS}
B = {m: f"t__view__v__m{m:02d}" for m in MONTHS}
PHENOLOGY = ["auc", "season_mean", "amplitude", "peak_month", "early_mean", "late_mean", "jun_to_aug_delta", "greenup_slope", "senescence_slope"]
PHENO_SQL = """ph AS (SELECT user_id, s, CASE WHEN count(*) >= 2 THEN sum((y + py) / 2 * (x - px)) END AS auc, avg(y) AS season_mean, max(y) - min(y) AS amplitude, (list(x ORDER BY y DESC, x))[1] AS peak_month, avg(y) FILTER (x <= 6) AS early_mean,
 avg(y) FILTER (x >= 8) AS late_mean, max(y) FILTER (x = 8) - max(y) FILTER (x = 6) AS jun_to_aug_delta, CASE WHEN count(*) FILTER (x <= 7) >= 2 THEN regr_slope(y, x) FILTER (x <= 7) END AS greenup_slope,
 CASE WHEN count(*) FILTER (x >= 8) >= 2 THEN regr_slope(y, x) FILTER (x >= 8) END AS senescence_slope FROM (SELECT *, lag(y) OVER o AS py, lag(x) OVER o AS px FROM tr WINDOW o AS (PARTITION BY user_id, s ORDER BY x)) GROUP BY user_id, s)"""


@query(f"l: user_id, d: {' '.join(PHENOLOGY)}", f"WITH {TR}, {PHENO_SQL} SELECT us.user_id, {', '.join(PHENOLOGY)} FROM us LEFT JOIN ph ON us.user_id = ph.user_id AND s = 'click'")
def phenology(spark, d):
    w = wide(spark, d).withColumn("p_", T.points(A))
    return T.with_features(w, {"p": F.col("p_")}, T.phenology(F.col("p"), MONTHS), ["user_id"])


SHAPES = ["total_variation", "roughness", "curvature_energy", "lag1_autocorr", "linear_trend_r2", "turning_fraction", "peak_sharpness", "center_of_mass_month", "shape_entropy"]


@query(
    f"l: user_id, d: {' '.join(SHAPES)}",
    f"""WITH {TR}, s1 AS (SELECT user_id, x, y, lag(y) OVER o AS py, (y - lag(y) OVER o) / (x - lag(x) OVER o) AS sl, count(*) OVER u AS n, min(y) OVER u AS lo, max(y) OVER u - min(y) OVER u AS span, row_number() OVER (PARTITION BY user_id ORDER BY y DESC) AS ry FROM a WINDOW o AS (PARTITION BY user_id ORDER BY x), u AS (PARTITION BY user_id)),
 s2 AS (SELECT *, sl - lag(sl) OVER (PARTITION BY user_id ORDER BY x) AS bend, CASE WHEN span > 0 THEN (y - lo) / span END AS w FROM s1), s3 AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS q FROM s2),
 tn AS (SELECT user_id, avg(t) AS turning FROM (SELECT user_id, CASE WHEN lag(sign(sl)) OVER (PARTITION BY user_id ORDER BY x) IS NULL THEN NULL WHEN sign(sl) <> lag(sign(sl)) OVER (PARTITION BY user_id ORDER BY x) THEN 1.0 ELSE 0.0 END AS t FROM s1 WHERE sl <> 0) GROUP BY user_id),
 g AS (SELECT user_id, any_value(n) AS n, sum(abs(y - py)) AS total_variation, avg(abs(bend)) AS roughness, avg(bend * bend) AS curvature_energy, CASE WHEN any_value(n) >= 3 AND var_pop(CASE WHEN py IS NOT NULL THEN y END) > 0 AND var_pop(py) > 0 THEN corr(y, py) END AS lag1_autocorr,
 CASE WHEN any_value(n) >= 2 AND any_value(span) > 0 THEN pow(corr(y, x), 2) END AS linear_trend_r2, max(y) FILTER (ry = 1) - max(y) FILTER (ry = 2) AS peak_sharpness, CASE WHEN any_value(span) > 0 THEN sum(x * w) / sum(w) END AS center_of_mass_month,
 CASE WHEN any_value(span) > 0 THEN -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(any_value(n)) END AS shape_entropy FROM s3 GROUP BY user_id)
 SELECT us.user_id, total_variation, roughness, curvature_energy, lag1_autocorr, linear_trend_r2, CASE WHEN n >= 3 THEN coalesce(turning, 0) END AS turning_fraction, peak_sharpness, center_of_mass_month, shape_entropy FROM us LEFT JOIN g USING (user_id) LEFT JOIN tn USING (user_id)""",
)
def shape_descriptors(spark, d):
    w = wide(spark, d).withColumn("p_", T.points(A))
    return T.with_features(w, {"p": F.col("p_")}, T.shape(F.col("p"), T.running_correlation), ["user_id"])


def paired(spark, d, features):
    return T.with_features(wide(spark, d), {"pa": T.points(A), "pb": T.points(B), "sh": T.both(A, B)}, features, ["user_id"])


def in_order(pairs_):
    """running_correlation() over the pairs in the order of the SQL's last window: by b."""
    return T.running_correlation(F.array_sort(F.transform(pairs_, lambda q: F.struct(q["b"].alias("b"), q["a"].alias("a")))))


PAIR = f"{TR}, {PHENO_SQL}, sh AS (SELECT a.user_id, a.x, a.y AS ya, b.y AS yb FROM a JOIN b ON a.user_id = b.user_id AND a.x = b.x), pa AS (SELECT * FROM ph WHERE s = 'click'), pb AS (SELECT * FROM ph WHERE s = 'view')"
JOINED = "FROM us LEFT JOIN pa ON us.user_id = pa.user_id LEFT JOIN pb ON us.user_id = pb.user_id LEFT JOIN m ON us.user_id = m.user_id"


@query("l: user_id, d: season_mean_difference season_mean_ratio monthly_rmse", f"WITH {PAIR}, m AS (SELECT user_id, sqrt(avg(pow(ya - yb, 2))) AS monthly_rmse FROM sh GROUP BY user_id) SELECT us.user_id, pa.season_mean - pb.season_mean AS season_mean_difference, CASE WHEN abs(pb.season_mean) > 1e-12 THEN pa.season_mean / pb.season_mean END AS season_mean_ratio, monthly_rmse {JOINED}")
def sensor_agreement(spark, d):
    return paired(spark, d, T.agreement(F.col("pa"), F.col("pb"), F.col("sh")))


@query(
    "l: user_id, d: season_mean_delta season_mean_ratio auc_delta august_delta late_season_delta peak_month_shift",
    f"WITH {PAIR}, m AS (SELECT user_id, avg(ya - yb) AS season_mean_delta, max(ya - yb) FILTER (x = 8) AS august_delta, avg(ya - yb) FILTER (x >= 8) AS late_season_delta FROM sh GROUP BY user_id) SELECT us.user_id, season_mean_delta, CASE WHEN abs(pb.season_mean) > 1e-12 THEN pa.season_mean / pb.season_mean END AS season_mean_ratio, pa.auc - pb.auc AS auc_delta, august_delta, late_season_delta, pa.peak_month - pb.peak_month AS peak_month_shift {JOINED}",
)
def season_anomaly(spark, d):
    return paired(spark, d, T.anomaly(F.col("pa"), F.col("pb"), F.col("sh"), MONTHS))


@query(
    "l: user_id, d: pearson_r spearman_r cosine_similarity normalized_rmse mean_abs_symmetric_difference peak_month_abs_difference",
    f"""WITH {PAIR}, rk AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ya) AS ra, rank() OVER (PARTITION BY user_id ORDER BY yb) AS rb FROM sh),
 m AS (SELECT user_id, CASE WHEN count(*) >= 3 AND var_pop(ya) > 0 AND var_pop(yb) > 0 THEN corr(ya, yb) END AS pearson_r, CASE WHEN count(*) >= 3 AND var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS spearman_r, CASE WHEN count(*) >= 3 THEN sum(ya * yb) / (sqrt(sum(ya * ya)) * sqrt(sum(yb * yb))) END AS cosine_similarity, sqrt(avg(pow(ya - yb, 2))) AS rmse, avg(abs(2 * (ya - yb) / (abs(ya) + abs(yb)))) AS mean_abs_symmetric_difference FROM rk GROUP BY user_id),
 sp AS (SELECT user_id, max(y) - min(y) AS span FROM tr GROUP BY user_id HAVING count(DISTINCT s) = 2)
 SELECT us.user_id, pearson_r, spearman_r, cosine_similarity, CASE WHEN abs(span) > 1e-12 THEN rmse / span END AS normalized_rmse, mean_abs_symmetric_difference, abs(pa.peak_month - pb.peak_month) AS peak_month_abs_difference {JOINED} LEFT JOIN sp ON us.user_id = sp.user_id""",
)
def sensor_shape_similarity(spark, d):
    """Ranks and correlations as the SQL has them: ties at the least rank, moments row by row; the operator's own default averages ranks."""
    return paired(spark, d, T.shape_similarity(F.col("pa"), F.col("pb"), F.col("sh"), rank=T.least_rank, correlate=in_order))


@query(
    "l: user_id, d: season_mean season_min season_max season_range below_history_fraction above_history_fraction",
    f"WITH {TR}, h AS (SELECT user_id, min(y) AS lo, max(y) AS hi FROM b GROUP BY user_id), z AS (SELECT a.user_id, CASE WHEN abs(hi - lo) > 1e-12 THEN 100.0 * (y - lo) / (hi - lo) END AS z FROM a JOIN h USING (user_id)), m AS (SELECT user_id, avg(z) AS season_mean, min(z) AS season_min, max(z) AS season_max, max(z) - min(z) AS season_range, avg(CASE WHEN z < 0 THEN 1.0 ELSE 0 END) FILTER (z IS NOT NULL) AS below_history_fraction, avg(CASE WHEN z > 100 THEN 1.0 ELSE 0 END) FILTER (z IS NOT NULL) AS above_history_fraction FROM z GROUP BY user_id) SELECT us.user_id, season_mean, season_min, season_max, season_range, below_history_fraction, above_history_fraction FROM us LEFT JOIN m USING (user_id)",
)
def range_position(spark, d):
    w = wide(spark, d)
    low, high = F.array_min(T.ys(T.points(B))), F.array_max(T.ys(T.points(B)))
    return T.with_features(w, {"p": T.points(A), "lo": low, "hi": high}, T.range_position(F.col("p"), "lo", "hi", 100.0), ["user_id"])


@query(
    "l: user_id, d: season_mean rms max_abs late_mean positive_fraction sign_change_fraction",
    f"""WITH {PAIR}, c AS (SELECT user_id, x, 2 * (ya - yb) / (abs(ya) + abs(yb)) AS y FROM sh WHERE abs(ya) + abs(yb) > 1e-12), t AS (SELECT user_id, avg(f) AS f FROM (SELECT user_id, CASE WHEN lag(sign(y)) OVER (PARTITION BY user_id ORDER BY x) IS NULL THEN NULL WHEN lag(sign(y)) OVER (PARTITION BY user_id ORDER BY x) <> sign(y) THEN 1.0 ELSE 0.0 END AS f FROM c WHERE y <> 0) GROUP BY user_id),
 m AS (SELECT user_id, avg(y) AS season_mean, sqrt(avg(y * y)) AS rms, max(abs(y)) AS max_abs, avg(y) FILTER (x >= 8) AS late_mean, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END) AS positive_fraction FROM c GROUP BY user_id) SELECT us.user_id, season_mean, rms, max_abs, late_mean, positive_fraction, CASE WHEN m.user_id IS NOT NULL THEN coalesce(t.f, 0) END AS sign_change_fraction FROM us LEFT JOIN m ON us.user_id = m.user_id LEFT JOIN t ON us.user_id = t.user_id""",
)
def symmetric_change(spark, d):
    return paired(spark, d, T.change_features(F.col("sh")))


@query("l: user_id, d: cv_absmean std_over_range mean_position_in_range range_asymmetry", f"WITH {EV}, g AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM ev GROUP BY user_id) SELECT user_id, CASE WHEN abs(m) > 1e-12 THEN s / abs(m) END AS cv_absmean, CASE WHEN hi - lo > 1e-12 THEN s / (hi - lo) END AS std_over_range, CASE WHEN hi - lo > 1e-12 THEN (m - lo) / (hi - lo) END AS mean_position_in_range, CASE WHEN hi - lo > 1e-12 THEN (hi + lo - 2 * m) / (hi - lo) END AS range_asymmetry FROM g")
def aggregate_geometry(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.select("user_id", *(c.alias(n) for n, c in T.aggregate_geometry("m", "s", "lo", "hi").items()))


@query(
    "l: user_id lag, d: r",
    f"WITH {PAIR}, lg AS (SELECT unnest(range(-2, 3)) AS lag), c AS (SELECT a.user_id, lag, CASE WHEN count(*) >= 3 AND var_pop(a.y) > 0 AND var_pop(b.y) > 0 THEN corr(a.y, b.y) END AS r FROM a JOIN lg ON true JOIN b ON a.user_id = b.user_id AND b.x = a.x + lag GROUP BY a.user_id, lag), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, lag) AS i FROM c WHERE r IS NOT NULL) SELECT us.user_id, lag, r FROM us LEFT JOIN k ON us.user_id = k.user_id AND i = 1",
)
def lag_correlation(spark, d):
    w = wide(spark, d).select("user_id", F.array(*A.values()).alias("a"), F.array(*B.values()).alias("b"))
    w = w.withColumn("best", T.lag_correlation(F.col("a"), F.col("b"), 2, 3))
    return w.select("user_id", "best.lag", "best.r")


IRR = ["n_observations", "n_days", "span_days", "mean", "weighted_mean", "std", "median", "min", "max", "range", "q05", "q25", "q75", "q95", "iqr", "rms", "cv", "initial", "final", "day_of_peak", "fraction_above_median", "fraction_below_q25", "skewness", "excess_kurtosis", "maximum_gap_days", "slope_day", "mean_absolute_velocity", "maximum_growth_velocity", "velocity_variability", "total_variation", "positive_variation", "direction_changes", "lag1_observation_autocorrelation", "observed_auc", "covered_days", "n_contiguous_intervals", "late_minus_early", "acceleration_proxy", "mad", "median_gap_days", "quadratic_curvature"]


@query(
    f"l: user_id, d: {' '.join(IRR)}",
    f"""WITH {EV}, daily AS (SELECT user_id, d, count(*) AS n, sum(w) AS w, sum(v * w) / sum(w) AS v FROM (SELECT user_id, d, v, coalesce(cloud, 0) AS w FROM ev WHERE v IS NOT NULL) WHERE w > 0 GROUP BY ALL),
 s AS (SELECT *, d - min(d) OVER u AS t, row_number() OVER o AS i, count(*) OVER u AS k, avg(v) OVER u AS m, stddev_pop(v) OVER u AS sd, d - lag(d) OVER o AS gap, v - lag(v) OVER o AS dy, lag(v) OVER o AS pv, quantile_cont(v, 0.5) OVER u AS q50, quantile_cont(v, 0.25) OVER u AS q25 FROM daily WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY d)),
 r AS (SELECT *, dy / greatest(gap, 1) AS rate FROM s), z AS (SELECT *, CASE WHEN lag(rate) OVER (PARTITION BY user_id ORDER BY d) IS NULL THEN NULL WHEN sign(rate) <> sign(lag(rate) OVER (PARTITION BY user_id ORDER BY d)) THEN 1 ELSE 0 END AS turn FROM r)
 SELECT user_id, sum(n) AS n_observations, count(*) AS n_days, max(t) AS span_days, avg(v) AS mean, sum(v * w) / sum(w) AS weighted_mean, stddev_pop(v) AS std, any_value(q50) AS median, min(v) AS min, max(v) AS max, max(v) - min(v) AS range, quantile_cont(v, 0.05) AS q05, any_value(q25) AS q25, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.75) - any_value(q25) AS iqr, sqrt(avg(v * v)) AS rms, stddev_pop(v) / (abs(avg(v)) + 1e-6) AS cv,
 (list(v ORDER BY d))[1] AS initial, (list(v ORDER BY d DESC))[1] AS final, (list(t ORDER BY v DESC, t))[1] AS day_of_peak, avg(CASE WHEN v > q50 THEN 1.0 ELSE 0 END) AS fraction_above_median, avg(CASE WHEN v < q25 THEN 1.0 ELSE 0 END) AS fraction_below_q25, CASE WHEN count(*) > 2 AND any_value(sd) > 1e-12 THEN avg(pow((v - m) / sd, 3)) END AS skewness, CASE WHEN count(*) > 2 AND any_value(sd) > 1e-12 THEN avg(pow((v - m) / sd, 4)) - 3 END AS excess_kurtosis,
 max(gap) AS maximum_gap_days, CASE WHEN count(*) >= 2 THEN regr_slope(v, t) END AS slope_day, avg(abs(rate)) AS mean_absolute_velocity, max(rate) AS maximum_growth_velocity, stddev_pop(rate) AS velocity_variability, sum(abs(dy)) AS total_variation, sum(greatest(dy, 0)) FILTER (dy IS NOT NULL) AS positive_variation, CASE WHEN count(*) >= 2 THEN coalesce(sum(turn), 0) END AS direction_changes,
 CASE WHEN count(*) >= 4 AND var_pop(pv) > 0 AND var_pop(v) FILTER (pv IS NOT NULL) > 0 THEN corr(v, pv) END AS lag1_observation_autocorrelation, CASE WHEN count(*) >= 2 THEN coalesce(sum((v + pv) * gap / 2.0) FILTER (gap <= 5), 0) END AS observed_auc, CASE WHEN count(*) >= 2 THEN coalesce(sum(gap) FILTER (gap <= 5), 0) END AS covered_days, CASE WHEN count(*) >= 2 THEN count(*) FILTER (gap <= 5) END AS n_contiguous_intervals,
 CASE WHEN count(*) >= 4 THEN avg(v) FILTER (i > k // 2) - avg(v) FILTER (i <= k // 2) END AS late_minus_early, CASE WHEN count(*) >= 4 THEN avg(rate) FILTER (i - 1 > (k - 1) // 2) - avg(rate) FILTER (i - 1 <= (k - 1) // 2) END AS acceleration_proxy, median(abs(v - q50)) AS mad, median(gap) AS median_gap_days, CASE WHEN count(*) >= 3 THEN (sum(c * c * v) - sum(c * c) * sum(v) / count(*) - sum(c * c * c) / sum(c * c) * sum(c * v)) / (sum(c * c * c * c) - pow(sum(c * c), 2) / count(*) - pow(sum(c * c * c), 2) / sum(c * c)) END AS quadratic_curvature FROM (SELECT *, t - avg(t) OVER (PARTITION BY user_id) AS c FROM z) z GROUP BY user_id""",
)
def irregular_descriptors(spark, d):
    return temporal.irregular(events(spark, d), ["user_id"], "ts", "v", "cloud", 5)


@query("l: user_id, d: a b", f"WITH {EV}, b AS (SELECT user_id, avg(v) AS a FROM ev GROUP BY user_id), c AS (SELECT user_id, max(v) AS b FROM ev WHERE event_type = 'view' GROUP BY user_id) SELECT user_id, a, b FROM b LEFT JOIN c USING (user_id)")
def merge_blocks(spark, d):
    e = events(spark, d)
    return checks.merge_blocks(e.groupBy("user_id").agg(F.avg("v").alias("a")), e.where("event_type = 'view'").groupBy("user_id").agg(F.max("v").alias("b")), on=["user_id"])


@query("l: user_id, d: a b", f"WITH {EV} SELECT user_id, avg(v) AS a, max(v) AS b FROM ev GROUP BY user_id")
def join_exact_coverage(spark, d):
    e = events(spark, d)
    return checks.join_exact(e.groupBy("user_id").agg(F.avg("v").alias("a")), e.groupBy("user_id").agg(F.max("v").alias("b"), F.min("v").alias("target")), ["user_id"], drop=["target"])
