"""Scans: CSV panels, many files with provenance, polygons, inventories by file name."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.expressions import zero_pad

ENCODINGS = ("UTF-8", "ISO-8859-1")


def read_panel(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; a schema spares the pass that would infer one."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema else reader
    return reader.csv(path if isinstance(path, str) else list(path))


def read_flexible(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """UTF-8, with or without a byte-order mark, or else Latin-1: replacement characters in the text decide."""
    df = read_panel(spark, path, schema, ENCODINGS[0])
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    broken = df.where(F.concat_ws("", *(F.col(f"`{c}`") for c in texts)).contains("�")).limit(1).count() if texts else 0
    df = read_panel(spark, path, schema, ENCODINGS[1]) if broken or any("�" in c for c in df.columns) else df
    return df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns})


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split table without the unnamed empty columns that spreadsheets leave."""
    from panelforge.operators.checks import drop_empty

    df = read_panel(spark, path)
    unnamed = [c for c in df.columns if re.match(r"(Unnamed:|_c\d+$|$)", c)]
    return drop_empty(df, keep=[c for c in df.columns if c not in unnamed])


def concatenate(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False, source_column: str = "source_file", schema: str | None = None) -> DataFrame:
    """All files of a folder as one table with the name of the file of each row."""
    reader = spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    df = (reader.schema(schema) if schema else reader).csv(folder)
    if source_column in df.columns:
        raise ValueError(f"column exists: {source_column}")
    return df.withColumn(source_column, F.col("_metadata.file_name"))


def discover(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")


def inventory(files: DataFrame, pattern: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Fields of the file names by the groups of a pattern: (name, type)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.withColumn("name", name).where(F.col("name").rlike(pattern))
    return rows.select("path", "name", *(F.regexp_extract("name", pattern, i).try_cast(t).alias(f) for i, (f, t) in enumerate(fields, 1)))


def read_yearly(df: DataFrame, states: Sequence[int], crop_pattern: str, crop_columns: Sequence[str], state: str, municipality: str) -> DataFrame:
    """Rows of the states and crops, with a five-digit area key; the crop column may have any of several names."""
    named = [c for c in crop_columns if c in df.columns]
    if not named:
        raise KeyError(f"none of the crop columns: {list(crop_columns)}")
    crop = F.coalesce(*(F.col(f"`{c}`") for c in named))
    rows = df.withColumn("crop", crop).where(F.col(state).isin(list(states)) & F.col("crop").rlike(crop_pattern))
    return rows.withColumn("area_key", F.concat(zero_pad(state, 2), zero_pad(municipality, 3)))


def read_polygons(spark: SparkSession, path: str, key: str, lines: bool = False) -> DataFrame:
    """GeoJSON features: key, properties and polygons, an array of polygons, each an outer ring and its holes (rings of struct<x, y>).

    lines: each line is a document, so that large files are split.
    """
    doc = spark.read.option("multiLine", not lines).schema("features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>").json(path)
    f = doc.select(F.explode("features").alias("f"))
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    several = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", several).otherwise(F.array(single))
    points = F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return f.select(F.col("f.properties")[key].alias(key), F.col("f.properties").alias("properties"), points.alias("polygons"))


def read_layers(spark: SparkSession, paths: Mapping[str, str], key: str, crs: Mapping[str, str], lines: bool = False) -> DataFrame:
    """The polygons of several layers with the layer's name; layers in different reference systems are refused."""
    if len(set(crs[name] for name in paths)) > 1:
        raise ValueError(f"layers differ in their reference system: {dict(crs)}")
    out = None
    for name, path in paths.items():
        one = read_polygons(spark, path, key, lines).withColumn("layer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
