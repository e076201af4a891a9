"""Two-step catchment accessibility with Gaussian decay over origin-destination travel times.

All regions run as one job: a region is a column of keys, not a loop. Each step is an equi-join and an aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.functions.clean import divided, to_double
from equireach.functions.geo import haversine_km

#: Minutes within reach by grade, the limit of a supply ratio, beds where none are known.
THRESHOLDS = {"Level3": 60.0, "Level2": 45.0}
OTHER_THRESHOLD = 30.0
MOST_RATIO = 100.0
DEFAULT_BEDS = 5.0
NO_TIME = -1.0
SCALE = 10_000.0
JITTER = 0.001


def grade_level(grade: Column) -> Column:
    return F.when(grade.startswith("Level3"), 3).when(grade.startswith("Level2"), 2).otherwise(1)


def grade_threshold(grade: Column) -> Column:
    """Minutes within which a facility of a grade is reached."""
    out = F.lit(OTHER_THRESHOLD)
    for prefix, minutes in THRESHOLDS.items():
        out = F.when(grade.startswith(prefix), F.lit(minutes)).otherwise(out)
    return out


def gaussian_decay(minutes: Column, threshold: Column) -> Column:
    """1 at once, 0 from the threshold on and where there is no time."""
    edge = F.exp(F.lit(-0.5))
    share = (F.exp(-0.5 * F.pow(minutes / threshold, 2)) - edge) / (1 - edge)
    return F.when(minutes.isNull() | (minutes > threshold), 0.0).otherwise(F.greatest(share, F.lit(0.0)))


def beds_or_default(beds: Column) -> Column:
    return F.coalesce(to_double(beds), F.lit(DEFAULT_BEDS))


def potential_status(potential: Column) -> Column:
    """Why a population potential is not valid; null if it is. Zero is valid."""
    return F.when(potential.isNull(), "PW_INVALID_PW_SUM_NONE").when(potential < 0, "PW_INVALID_PW_SUM_NEGATIVE").when(F.isnan(potential) | (potential == float("inf")), "PW_INVALID_PW_SUM_INVALID")


def ratio_status(ratio: Column) -> Column:
    """Why a supply ratio is not valid; null if it is. The first reason holds, so an infinite ratio is too large."""
    nan = F.isnan(ratio)
    return (
        F.when(ratio.isNull(), "R_INVALID_R_VALUE_NONE")
        .when(~nan & (ratio < 0), "R_INVALID_R_VALUE_NEGATIVE")
        .when(~nan & (ratio == 0), "R_INVALID_R_VALUE_ZERO")
        .when(~nan & (ratio > MOST_RATIO), "R_INVALID_R_VALUE_TOO_LARGE")
        .when(nan, "R_INVALID_R_VALUE_INVALID")
    )


def near_pairs(origins: DataFrame, dests: DataFrame, reach_km: float | None = None, region: str = "region") -> DataFrame:
    """The pairs of points of a region: (origin_id, origin_lng, origin_lat) with (dest_id, dest_lng, dest_lat).

    With reach_km only pairs within that great-circle distance, so that none beyond it is routed: dests are put into
    every cell that lies within reach, a degree's length apart, and meet the origins of that cell alone. Cells are wider
    in longitude where the degree is shorter; points nearer to a pole than 5 degrees, or across the 180th meridian, are
    not met. Without it every origin of a region meets every dest, which large regions do not bear.
    """
    if reach_km is None:
        return origins.join(dests, region)
    side = reach_km / 110.5  # a degree of latitude is at least so many km

    def row(lat: Column) -> Column:
        return F.floor(lat / side).cast("int")

    def width(row_: Column) -> Column:  # of a cell in a row of cells, by the shortest degree in that row and those beside it
        far = F.least(F.greatest(F.abs((row_ - 1) * side), F.abs((row_ + 2) * side)), F.lit(85.0))
        return side / F.cos(F.radians(far))

    a = origins.withColumn("_y", row(F.col("origin_lat"))).withColumn("_x", F.floor(F.col("origin_lng") / width(F.col("_y"))).cast("int"))
    b = dests.withColumn("_y", F.explode(F.sequence(row(F.col("dest_lat")) - 1, row(F.col("dest_lat")) + 1)))
    at = F.floor(F.col("dest_lng") / width(F.col("_y"))).cast("int")
    b = b.withColumn("_x", F.explode(F.sequence(at - 1, at + 1)))
    met = a.join(b, [region, "_y", "_x"])
    return met.where(haversine_km(F.col("origin_lng"), F.col("origin_lat"), F.col("dest_lng"), F.col("dest_lat")) <= reach_km).drop("_x", "_y")


def supply_ratio(facilities: DataFrame, grids: DataFrame, od: DataFrame, region: Sequence[str] = (), scale: float = SCALE) -> DataFrame:
    """Step one: facilities with pop_potential, R and status.

    facilities (hospital_id, grade, beds), grids (grid_id, pop), od (hospital_id, grid_id, minutes; null: no path), all
    with the columns of region. The potential sums pop * decay over grids with pop > 0; R = beds / potential * scale, 0
    where the potential is 0 or the status is not SUCCESS.
    """
    keys = list(region)
    populated = grids.where(F.col("pop") > 0).select(*keys, "grid_id", "pop")
    own = facilities.withColumns({"threshold": grade_threshold(F.col("grade")), "beds": beds_or_default(F.col("beds"))})
    near = od.select(*keys, "hospital_id", "grid_id", "minutes").join(populated, [*keys, "grid_id"]).join(own.select(*keys, "hospital_id", "threshold"), [*keys, "hospital_id"])
    reached = near.groupBy(*keys, "hospital_id").agg(F.count(F.lit(1)).alias("pairs"), F.count("minutes").alias("paths"), F.sum(F.when(F.col("minutes").isNotNull(), F.col("pop") * gaussian_decay(F.col("minutes"), F.col("threshold")))).alias("pop_potential"))
    met = own.join(reached, [*keys, "hospital_id"], "left")
    raw = F.when(F.col("pop_potential") == 0, 0.0).otherwise(divided(F.col("beds"), F.col("pop_potential")) * scale)
    status = F.when(F.coalesce("pairs", F.lit(0)) == 0, "NO_VALID_GRIDS").when(F.col("paths") == 0, "NO_VALID_PATHS")
    status = F.coalesce(status, potential_status(F.col("pop_potential")), ratio_status(raw), F.lit("SUCCESS"))
    return met.withColumn("status", status).withColumn("R", F.when(F.col("status") == "SUCCESS", raw).otherwise(0.0)).drop("pairs", "paths")


def accessibility(grids: DataFrame, supplied: DataFrame, od: DataFrame, region: Sequence[str] = (), level3_only: bool = True) -> DataFrame:
    """Step two: grids with acc and the nearest time to each level (-1 where there is none).

    acc sums R * decay over facilities with R > 0 and a path; nearest times are not limited by the threshold. Grids that
    reach nothing have acc 0. level3_only leaves only facilities of level 3, and only their nearest time.
    """
    keys = list(region)
    ready = supplied.where(F.col("R") > 0).withColumn("level", grade_level(F.col("grade")))
    if level3_only:
        ready = ready.where("level = 3")
    near = od.where(F.col("minutes").isNotNull()).select(*keys, "hospital_id", "grid_id", "minutes").join(ready.select(*keys, "hospital_id", "R", "level", grade_threshold(F.col("grade")).alias("threshold")), [*keys, "hospital_id"])
    levels = (3,) if level3_only else (3, 2, 1)
    found = near.groupBy(*keys, "grid_id").agg(F.sum(F.col("R") * gaussian_decay(F.col("minutes"), F.col("threshold"))).alias("acc"), *(F.min(F.when(F.col("level") == n, F.col("minutes"))).alias(f"nearest_L{n}_time") for n in levels))
    acc = F.coalesce("acc", F.lit(0.0))
    bad = F.isnan(acc) | (acc < 0) | (acc == float("inf"))
    return grids.join(found, [*keys, "grid_id"], "left").withColumns({"acc": F.when(bad, 0.0).otherwise(acc)} | {f"nearest_L{n}_time": F.coalesce(f"nearest_L{n}_time", F.lit(NO_TIME)) for n in levels})


def two_step(facilities: DataFrame, grids: DataFrame, od_out: DataFrame, od_back: DataFrame | None = None, region: Sequence[str] = (), level3_only: bool = True, scale: float = SCALE) -> tuple[DataFrame, DataFrame]:
    """(facilities with their ratios, grids with accessibility); od_back holds the times from grid to facility if they differ."""
    chosen = facilities.where(grade_level(F.col("grade")) == 3) if level3_only else facilities
    supplied = supply_ratio(chosen, grids, od_out, region, scale)
    return supplied, accessibility(grids, supplied, od_back if od_back is not None else od_out, region, level3_only)


def jitter_offsets() -> list[tuple[int, float, float, float, float]]:
    """(order, start lng, start lat, end lng, end lat): the 25 pairs of offsets, start outer, none first."""
    moves = [(0.0, 0.0), (JITTER, 0.0), (-JITTER, 0.0), (0.0, JITTER), (0.0, -JITTER)]
    return [(5 * i + j, *a, *b) for i, a in enumerate(moves) for j, b in enumerate(moves)]


def first_cost(tries: DataFrame, keys: Sequence[str], order: str = "ordinal", cost: str = "cost") -> DataFrame:
    """(keys, minutes): the cost of the first try that has one; null if none has."""
    there = F.col(cost).isNotNull()
    return tries.groupBy(*keys).agg(F.min_by(F.when(there, F.col(cost)), F.when(there, F.col(order))).alias("minutes"))


def overlay(base: DataFrame, checkpoint: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the checkpoint's non-null values in place of its own, by key."""
    other = checkpoint.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(other, base[key] == other["_key"], "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def unfinished(items: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """The items whose key is not among those finished; a true 0 is finished."""
    return items.join(finished.select(key).distinct(), key, "left_anti")
