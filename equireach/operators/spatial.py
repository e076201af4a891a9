"""Points in polygons as a hash join: cells of a coarse grid are the key, ray casting decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of a cell's side.
CELL = 0.5


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring, an array of struct(lng, lat), by the parity of edges east of it."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a["lng"].alias("ax"), a["lat"].alias("ay"), b["lng"].alias("bx"), b["lat"].alias("by")))
    crossed = F.filter(edges, lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lng < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.when(e["by"] != e["ay"], e["by"] - e["ay"]) + e["ax"]))
    return F.size(crossed) % 2 == 1


def clip(points: DataFrame, regions: DataFrame, name: str = "name", rings: str = "rings", lng: str = "lng", lat: str = "lat", cell: float = CELL) -> DataFrame:
    """points with the name of each region that holds them; rings are arrays of arrays of struct(lng, lat), holes included.

    Points without coordinates are in no region; a point in several has a row for each.
    """
    flat = F.flatten(F.col(rings))
    xs, ys = F.transform(flat, lambda p: p["lng"]), F.transform(flat, lambda p: p["lat"])
    box = regions.select(F.col(name).alias("region"), F.col(rings).alias("_rings"), F.array_min(xs).alias("_w"), F.array_max(xs).alias("_e"), F.array_min(ys).alias("_s"), F.array_max(ys).alias("_n"))

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell).cast("int"), F.floor(F.col(high) / cell).cast("int")))

    tiles = box.where("_w IS NOT NULL").withColumn("_cx", cells("_w", "_e")).withColumn("_cy", cells("_s", "_n"))
    own = points.withColumns({"_px": F.floor(F.col(lng) / cell).cast("int"), "_py": F.floor(F.col(lat) / cell).cast("int")})
    met = own.join(tiles, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & F.col(lng).between(F.col("_w"), F.col("_e")) & F.col(lat).between(F.col("_s"), F.col("_n")))
    inside = F.aggregate(F.transform(F.col("_rings"), lambda r: in_ring(F.col(lng), F.col(lat), r).cast("int")), F.lit(0), lambda a, x: a + x) % 2 == 1
    return met.where(inside).select(*points.columns, "region")
