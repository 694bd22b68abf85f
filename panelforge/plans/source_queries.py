"""Queries that write tables to the shared folder and scan them back, and queries of schema operators.

Stand-ins: CSV panels, yearly files, encodings, polygons and manifests made from the relational tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import cells, checks, contract
from panelforge.plans.registry import query, table
from panelforge.session import scratch
from panelforge.sources import readers, writers


def written(df, spark, name, format="csv", **options):
    """A table written to a new folder of the shared one, by the stage's own tasks."""
    path = scratch(spark, name)
    writer = df.write.options(**options)
    getattr(writer, format)(path)
    return path


@query("l: id, s: segment, m: balance", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def csv_panel(spark, d):
    """A panel written as CSV with a header and scanned by a schema."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return readers.read_panel(spark, written(c, spark, "panel", header=True), "id long, segment string, balance double")


@query("s: name status, l: observed", "SELECT name, CASE WHEN observed = 0 THEN 'ok' ELSE 'error' END AS status, observed FROM (SELECT count(*) - count(DISTINCT c_custkey) AS r, count(*) FILTER (c_custkey % 10 >= 3 AND c_custkey % 97 = 0) AS t FROM customer) CROSS JOIN LATERAL (VALUES ('null_keys', 0), ('repeated_keys', r), ('unknown_split', 0), ('train_without_target', t), ('predict_with_target', 0)) v(name, observed)")
def csv_contract(spark, d):
    """A split table with the unnamed empty columns of a spreadsheet, scanned and checked."""
    train = F.col("c_custkey") % 10 >= 3
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(train & (F.col("c_custkey") % 97 != 0), F.col("c_acctbal")).alias("y"), F.when(train, "train").otherwise("target").alias("part"), F.lit(None).cast("string").alias("Unnamed: 3"))
    back = readers.read_split(spark, written(c, spark, "split", header=True))
    return contract.split_contract(back.select(F.col("id").cast("long").alias("id"), F.col("y").cast("double").alias("y"), "part"), "id", "y", "part", "train", "target")


@query("s: status, l: n files", "SELECT o_orderstatus AS status, count(*) AS n, 1 AS files FROM orders GROUP BY 1")
def csv_files_with_provenance(spark, d):
    """A file a status, scanned as one table with the file of each row."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", F.col("o_orderstatus").alias("folder"))
    folder = scratch(spark, "files")
    o.repartition("folder").write.partitionBy("folder").option("header", True).csv(folder)
    both = readers.concatenate(spark, folder, "*.csv", recursive=True, schema="status string, o_orderkey long")
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"))


@query("l: files empty", "SELECT 7 AS files, 0 AS empty")
def file_discovery(spark, d):
    """Files of a pattern, their contents unread."""
    folder = written(table(spark, d, "customer").select("c_custkey").repartition(7, "c_custkey"), spark, "found", header=True)
    found = readers.discover(spark, folder, "*.csv")
    return found.agg(F.count("*").alias("files"), F.sum((F.col("length") == 0).cast("long")).alias("empty"))


@query("l: id, s: name", "SELECT c_custkey AS id, 'Año ' || c_mktsegment AS name FROM customer")
def encoding_fallback(spark, d):
    """Latin-1 text, told from UTF-8 by its broken characters."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Año "), "c_mktsegment").alias("name"))
    return readers.read_flexible(spark, written(c, spark, "latin", header=True, encoding="ISO-8859-1"), "id long, name string")


@query("s: area_key, l: n, m: total", "SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS area_key, count(*) AS n, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2) AND c_mktsegment ILIKE '%AUTO%' GROUP BY 1")
def yearly_detail(spark, d):
    """Yearly detail files: states and crops kept, an area key of five digits; the crop column has one of two names."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("n_regionkey").alias("state"), F.col("c_nationkey").alias("muni"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("crop_a"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("crop_b"), "c_acctbal")
    back = readers.read_panel(spark, written(c, spark, "yearly", header=True), "state int, muni int, crop_a string, crop_b string, c_acctbal double")
    rows = readers.read_yearly(back, [0, 2], "(?i)auto", ["crop_a", "crop_b"], "state", "muni")
    return rows.groupBy("area_key").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))


@query("s: area_key, l: year, m: total", "SELECT lpad(CAST(o_custkey % 7 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 13 AS VARCHAR), 3, '0') AS area_key, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders WHERE o_custkey % 7 IN (1, 3) AND o_orderpriority LIKE '%HIGH%' GROUP BY 1, 2")
def yearly_history(spark, d):
    """The history of several years in one folder a year."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("state"), (F.col("o_custkey") % 13).alias("muni"), F.col("o_orderpriority").alias("crop"), F.year("o_orderdate").alias("year"), "o_totalprice")
    path = scratch(spark, "history")
    o.write.partitionBy("year").option("header", True).csv(path)
    back = spark.read.option("header", True).schema("state int, muni int, crop string, o_totalprice double, year int").csv(path)
    return readers.read_yearly(back, [1, 3], "HIGH", ["crop"], "state", "muni").groupBy("area_key", "year").agg(F.sum("o_totalprice").alias("total"))


@query("s: variable, l: year month n", "SELECT o_orderstatus AS variable, year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL")
def raster_inventory(spark, d):
    """Variable, year and month from file names."""
    o = table(spark, d, "orders").select(F.concat(F.lit("/data/"), "o_orderstatus", F.date_format("o_orderdate", "'_'yyyy'_'MM'.tif'")).alias("path"))
    found = readers.inventory(o.unionByName(o.limit(3).select(F.lit("/data/notes.txt").alias("path"))), r"^(\w)_(\d{4})_(\d{2})\.tif$", [("variable", "string"), ("year", "int"), ("month", "int")])
    return found.groupBy("variable", "year", "month").agg(F.count("*").alias("n"))


def shapes(spark, d, where="true"):
    """GeoJSON features as text: a rectangle with a square hole, and for every second customer a triangle as a second polygon."""
    x, y, w = F.col("c_custkey") % 40, F.col("c_custkey") % 23, 3 + F.col("c_custkey") % 4
    box = lambda x0, y0, x1, y1: F.format_string("[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", *(v.cast("long") for v in (x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)))
    first = F.concat(F.lit("["), box(x, y, x + w, y + 3), F.lit(","), box(x + 1, y + 1, x + 2, y + 2), F.lit("]"))
    more = F.format_string("[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]", *(v.cast("long") for v in (x + 50, y, x + 52, y, x + 52, y + 2, x + 50, y)))
    several = F.col("c_custkey") % 2 == 0
    geometry = F.concat(F.lit('{"type":"'), F.when(several, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(several, F.concat(F.lit("["), first, F.lit(","), more, F.lit("]"))).otherwise(first), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"ID":"'), F.col("c_custkey").cast("string"), F.lit('"},"geometry":'), geometry, F.lit("}"))
    one = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))  # a document a line
    return written(table(spark, d, "customer").where(where).select(one.alias("value")), spark, "shapes", format="text")


@query("l: id n_polygons, d: area cx cy", "WITH s AS (SELECT c_custkey AS id, c_custkey % 40 AS x, c_custkey % 23 AS y, 3 + c_custkey % 4 AS w, c_custkey % 2 = 0 AS m FROM customer), a AS (SELECT *, 3.0 * w - 1 + CASE WHEN m THEN 2 ELSE 0 END AS area FROM s) SELECT id, CASE WHEN m THEN 2 ELSE 1 END AS n_polygons, area, (3.0 * w * (x + w / 2.0) - (x + 1.5) + CASE WHEN m THEN 2 * (x + 50 + 4 / 3.0) ELSE 0 END) / area AS cx, (3.0 * w * (y + 1.5) - (y + 1.5) + CASE WHEN m THEN 2 * (y + 2 / 3.0) ELSE 0 END) / area AS cy FROM a")
def parcel_polygons(spark, d):
    """Polygons and multipolygons with holes: area and centre of area."""
    p = readers.read_polygons(spark, shapes(spark, d), "ID", lines=True)
    x, y = cells.polygon_centroid(F.col("polygons"))
    return p.select(F.col("ID").cast("long").alias("id"), F.size("polygons").alias("n_polygons"), cells.polygon_area(F.col("polygons")).alias("area"), x.alias("cx"), y.alias("cy"))


@query("s: layer, l: n, d: area", "WITH a AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'north' ELSE 'south' END AS layer, 3.0 * (3 + c_custkey % 4) - 1 + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS area FROM customer) SELECT layer, count(*) AS n, sum(area) AS area FROM a GROUP BY layer")
def polygon_layers(spark, d):
    """Layers of one reference system as one table."""
    names = {"north": shapes(spark, d, "c_custkey % 3 = 0"), "south": shapes(spark, d, "c_custkey % 3 <> 0")}
    p = readers.read_layers(spark, names, "ID", dict.fromkeys(names, "EPSG:4326"), lines=True)
    return p.groupBy("layer").agg(F.count("*").alias("n"), F.sum(cells.polygon_area(F.col("polygons"))).alias("area"))


@query("l: id cell_x cell_y, d: area", "WITH s AS (SELECT c_custkey AS id, c_custkey % 40 AS x, c_custkey % 23 AS y, 3 + c_custkey % 4 AS w, c_custkey % 2 = 0 AS m FROM customer), u AS (SELECT id, x + a AS cx, y + b AS cy, CASE WHEN a = 1 AND b = 1 THEN 0.0 ELSE 1.0 END AS area FROM s, range(0, 6) t(a), range(0, 3) r(b) WHERE a < w UNION ALL SELECT id, x + 50 + a, y + b, CASE WHEN a = b THEN 0.5 ELSE 1.0 END FROM s, range(0, 2) t(a), range(0, 2) r(b) WHERE m AND b <= a) SELECT id, cx // 2 AS cell_x, cy // 2 AS cell_y, sum(area) AS area FROM u GROUP BY ALL HAVING sum(area) > 0")
def polygon_grid_cells(spark, d):
    """Exact areas of the grid cells that polygons of any shape cover."""
    p = readers.read_polygons(spark, shapes(spark, d), "ID", lines=True)
    return cells.polygon_cells(p, "ID", 2.0).select(F.col("ID").cast("long").alias("id"), F.col("bx").alias("cell_x"), F.col("by").alias("cell_y"), "area")


RECORDS = [{"column": "c_acctbal", "family": "account", "mode": "clean", "inputs": ["customer"]}, {"column": "c_mktsegment", "family": "market", "mode": "competition"}, {"column": "c_nationkey", "family": "place", "mode": "clean"}]


@query("s: projection, l: n_rows n_columns, m: total", "SELECT projection, (SELECT count(*) FROM customer) AS n_rows, n AS n_columns, CASE WHEN projection <> 'competition' THEN (SELECT sum(c_acctbal) FROM customer) END AS total FROM (VALUES ('all', 4), ('clean', 3), ('competition', 2), ('manifest', 3)) t(projection, n) WHERE projection <> 'manifest'")
def csv_projections(spark, d):
    """Three projections of a table as CSV, read back."""
    folder = scratch(spark, "projections")
    writers.write_projections(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"), folder, "c_custkey", RECORDS, "csv")
    out = None
    for name in ("all", "clean", "competition"):
        t = readers.read_panel(spark, f"{folder}/{name}")
        total = F.sum(F.col("c_acctbal").cast("double")) if "c_acctbal" in t.columns else F.lit(None).cast("double")
        one = t.agg(F.lit(name).alias("projection"), F.count("*").alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"), total.alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s: column_ family mode, l: inputs", "SELECT * FROM (VALUES ('c_acctbal', 'account', 'clean', 1), ('c_mktsegment', 'market', 'competition', 0), ('c_nationkey', 'place', 'clean', 0)) t(column_, family, mode, inputs)")
def provenance_manifest(spark, d):
    """The manifest that a sink writes beside its projections."""
    folder = scratch(spark, "manifested")
    writers.write_projections(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("x").alias("c_mktsegment")), folder, "id", RECORDS)
    back = spark.read.schema("column string, family string, mode string, inputs array<string>").json(f"{folder}/manifest")
    return back.select(F.col("column").alias("column_"), "family", "mode", F.size("inputs").alias("inputs"))


@query("s: status, l: n, m: total", "SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS total FROM orders GROUP BY 1")
def sharded_sink(spark, d):
    """A shard a value; a second run over one value replaces only its shard."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("v"))
    folder = scratch(spark, "shards")
    writers.write_shards(o, folder, "status")
    writers.write_shards(o.where("status = 'F'").withColumn("v", -F.col("v")), folder, "status")
    return spark.read.parquet(folder).groupBy("status").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("l: id, s: name", "SELECT c_custkey AS id, c_mktsegment AS name FROM customer")
def column_aliases(spark, d):
    """Columns by any of their known names."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ID Cliente"), F.col("c_mktsegment").alias("Segmento"))
    return checks.rename_known(c, {"id": ["id_cliente", "key"], "name": ["segment", "segmento"]}).select("id", "name")


@query("s: kept", "SELECT kept FROM (VALUES ('l_extendedprice'), ('l_discount')) t(kept) ORDER BY 1")
def select_by_name_and_type(spark, d):
    """Numeric columns with data by prefix and suffix."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag", F.lit(None).cast("double").alias("l_price"), F.col("l_tax").alias("t_price"))
    names = sorted(set(checks.numeric_with_data(li, suffix="price", prefix="l_")) | set(checks.numeric_with_data(li, suffix="discount")))
    return spark.createDataFrame([(n,) for n in names], "kept string")


@query("l: c_custkey, m: c_acctbal", "SELECT c_custkey, c_acctbal FROM customer")
def drop_all_null(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("double").alias("a"), F.lit(None).cast("string").alias("b"))
    return checks.drop_empty(c, keep=["c_custkey"])


@query("l: c_custkey, m: c_acctbal", "SELECT c_custkey, c_acctbal FROM customer")
def drop_null_and_constant(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("double").alias("a"), F.lit(7).alias("same"), F.when(F.col("c_custkey") > 0, "x").alias("b"))
    return checks.drop_empty(c, keep=["c_custkey"], constant=True)
