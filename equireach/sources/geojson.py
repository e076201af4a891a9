"""Boundaries and population grids from GeoJSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.operators.facilities import surrogate_key


#: A line that holds a feature, as writers of large files put them; the lines around them are the collection's.
_FEATURE = r'^\s*\{\s*"type"\s*:\s*"Feature"\s*,'
#: Lines looked at, and bytes of each, to tell whether features stand on lines.
HEAD_LINES, HEAD_BYTES = 20, 200


def _features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(index, f): the features of a file with their place in it.

    Files with a feature on each line, newline-delimited ones or collections, are read by several tasks; a feature line
    that is no whole feature is an error. Any other file is one record and read by one task.
    """
    feature = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    lines = spark.read.text(path)
    if not lines.select(F.substring("value", 1, HEAD_BYTES).alias("v")).limit(HEAD_LINES).where(F.col("v").rlike(_FEATURE)).take(1):
        raw = spark.read.option("multiLine", True).schema(f"features array<{feature}>").json(path)
        return raw.select(F.posexplode("features").alias("index", "f"))
    own = lines.where(F.col("value").rlike(_FEATURE)).select(F.regexp_replace("value", r",\s*$", "").alias("value"), F.monotonically_increasing_id().alias("at"))
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in own.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).orderBy("t").collect():  # one row a task
        starts.append((r["t"], before))
        before += r["n"]
    first = F.broadcast(spark.createDataFrame(starts, "t long, before long"))
    parsed = F.from_json("value", feature, {"mode": "FAILFAST"})
    return own.withColumn("t", task).join(first, "t").select((place + F.col("before")).cast("int").alias("index"), parsed.alias("f"))


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(name, rings) of each polygon or multipolygon; rings are arrays of struct(lng, lat)."""
    f = _features(spark, path, "name: string")
    pairs = "array<array<array<double>>>"
    one = F.from_json("f.geometry.coordinates", pairs)
    many = F.flatten(F.from_json("f.geometry.coordinates", f"array<{pairs}>"))
    raw = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    rings = F.transform(raw, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat"))))
    return f.select(F.col("f.properties.name").alias("name"), rings.alias("rings"))


def grid(spark: SparkSession, path: str) -> DataFrame:
    """(grid_id, lng, lat, pop, geometry): centroid, population (`sum`, 0 if missing or no number), geometry as text.

    A missing grid_id is the feature's place in the file.
    """
    f = _features(spark, path, "grid_id: string, sum: string")
    text = F.col("f.geometry.coordinates")
    point = F.from_json(text, "array<double>")
    ring = F.from_json(text, "array<array<array<double>>>")[0]
    is_point = F.col("f.geometry.type") == "Point"
    # the centroid of a ring by the shoelace formula
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))

    def total(of):
        return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + of(e))

    def cross(e):
        return e["ax"] * e["by"] - e["bx"] * e["ay"]

    area = F.when(total(cross) != 0, total(cross))
    lng = F.when(is_point, point[0]).otherwise(total(lambda e: (e["ax"] + e["bx"]) * cross(e)) / (3 * area))
    lat = F.when(is_point, point[1]).otherwise(total(lambda e: (e["ay"] + e["by"]) * cross(e)) / (3 * area))
    return f.select(F.coalesce(F.col("f.properties.grid_id"), F.col("index").cast("string")).alias("grid_id"), lng.alias("lng"), lat.alias("lat"), F.coalesce(F.col("f.properties.sum").try_cast("double"), F.lit(0.0)).alias("pop"), text.alias("geometry"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with grid_id = 0, 1, ... by a column of unique values, without a task that holds all rows."""
    return surrogate_key(df, "grid_id", [order])
