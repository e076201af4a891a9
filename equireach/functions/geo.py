"""Coordinates as used in China: BD-09, GCJ-02 and WGS-84, as column expressions.

The offset between GCJ-02 and WGS-84 is a published polynomial with sines; it has no closed inverse, so the way back
is a fixed-point iteration of bounded length, kept in the JVM as a fold over a sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the datum transformations.
X_PI = 3.14159265358979324 * 3000.0 / 180.0
PI = 3.1415926535897932384626
AXIS = 6378245.0
ECCENTRICITY = 0.00669342162296594323
LNG_BOUNDS = (73.66, 135.05)
LAT_BOUNDS = (3.86, 53.55)
#: Offsets (constant, x, y, x*y, sqrt|x|, squares of x and y), then (amplitude, wavelength in units of the argument) of the sines.
LAT_TERMS = {"one": -100.0, "x": 2.0, "y": 3.0, "xx": 0.0, "yy": 0.2, "xy": 0.1, "root": 0.2}
LNG_TERMS = {"one": 300.0, "x": 1.0, "y": 2.0, "xx": 0.1, "yy": 0.0, "xy": 0.1, "root": 0.1}
COMMON_WAVES = ((20.0, 6.0), (20.0, 2.0))
LAT_WAVES = ((20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30))
LNG_WAVES = ((20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30))


def out_of_china(lng: Column, lat: Column) -> Column:
    """Whether a point lies outside the bounding box, its edges included; true for null and NaN."""
    inside = (lng > LNG_BOUNDS[0]) & (lng < LNG_BOUNDS[1]) & (lat > LAT_BOUNDS[0]) & (lat < LAT_BOUNDS[1])
    return ~F.coalesce(inside, F.lit(False))


def _waves(argument: Column, waves: tuple[tuple[float, float], ...]) -> Column:
    total = F.lit(0.0)
    for amplitude, factor in waves:
        total = total + F.lit(amplitude) * F.sin(argument * F.lit(factor * PI))
    return total * F.lit(2.0 / 3.0)


def _offset(x: Column, y: Column, t: dict[str, float], own: Column, own_waves: tuple[tuple[float, float], ...]) -> Column:
    poly = F.lit(t["one"]) + t["x"] * x + t["y"] * y + t["xx"] * x * x + t["yy"] * y * y + t["xy"] * x * y + t["root"] * F.sqrt(F.abs(x))
    return poly + _waves(x, COMMON_WAVES) + _waves(own, own_waves)


def transform_lat(x: Column, y: Column) -> Column:
    """The polynomial for latitudes, of degrees east of 105 and north of 35."""
    return _offset(x, y, LAT_TERMS, y, LAT_WAVES)


def transform_lng(x: Column, y: Column) -> Column:
    """The polynomial for longitudes."""
    return _offset(x, y, LNG_TERMS, x, LNG_WAVES)


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def _shift(lng: Column, lat: Column) -> tuple[Column, Column]:
    """How far GCJ-02 lies from WGS-84 at a WGS-84 point, in degrees."""
    x, y, rad = lng - 105.0, lat - 35.0, lat / 180.0 * PI
    magic = 1 - ECCENTRICITY * F.sin(rad) * F.sin(rad)
    dlat = transform_lat(x, y) * 180.0 / ((AXIS * (1 - ECCENTRICITY)) / (magic * F.sqrt(magic)) * PI)
    dlng = transform_lng(x, y) * 180.0 / (AXIS / F.sqrt(magic) * F.cos(rad) * PI)
    return dlng, dlat


def wgs84_to_gcj02(lng: Column, lat: Column) -> Column:
    """struct(lng, lat); a point outside the box is itself."""
    out, (dlng, dlat) = out_of_china(lng, lat), _shift(lng, lat)
    return _point(F.when(out, lng).otherwise(lng + dlng), F.when(out, lat).otherwise(lat + dlat))


def bd09_to_gcj02(lng: Column, lat: Column) -> Column:
    """struct(lng, lat) by the closed form."""
    x, y = lng - 0.0065, lat - 0.006
    radius = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * X_PI)
    angle = F.atan2(y, x) - 0.000003 * F.cos(x * X_PI)
    return _point(radius * F.cos(angle), radius * F.sin(angle))


def gcj02_to_wgs84(lng: Column, lat: Column, turns: int = 30, within: float = 1e-6) -> Column:
    """struct(lng, lat, converged): the point whose image is the given one, by repeated correction.

    Each turn moves by the residual, until it is at most `within` degrees in both directions; after `turns` turns the
    last point stands with converged false. A point outside the box is itself, converged; null gives null coordinates.
    """

    def step(state: Column, _: Column) -> Column:
        dlng, dlat = _shift(state["lng"], state["lat"])
        rest_lng, rest_lat = lng - state["lng"] - dlng, lat - state["lat"] - dlat
        done = state["converged"] | ((F.abs(rest_lng) <= within) & (F.abs(rest_lat) <= within))
        return F.struct(F.when(done, state["lng"]).otherwise(state["lng"] + rest_lng).alias("lng"), F.when(done, state["lat"]).otherwise(state["lat"] + rest_lat).alias("lat"), F.coalesce(done, F.lit(False)).alias("converged"))

    start = F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"), out_of_china(lng, lat).alias("converged"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, step)


def bd09_to_wgs84(lng: Column, lat: Column) -> Column:
    """struct(lng, lat, converged)."""
    middle = bd09_to_gcj02(lng, lat)
    return gcj02_to_wgs84(middle["lng"], middle["lat"])


def haversine_km(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lng_b - lng_a) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def transform_point(lng: float, lat: float) -> tuple[float, float]:
    """wgs84_to_gcj02 of one point on the driver, for tests and single lookups."""
    if not (LNG_BOUNDS[0] < lng < LNG_BOUNDS[1] and LAT_BOUNDS[0] < lat < LAT_BOUNDS[1]):
        return lng, lat

    def waves(a: float, ws: tuple[tuple[float, float], ...]) -> float:
        return sum(m * math.sin(a * f * PI) for m, f in ws) * 2 / 3

    def offset(x: float, y: float, t: dict[str, float], own: float, ws: tuple[tuple[float, float], ...]) -> float:
        return t["one"] + t["x"] * x + t["y"] * y + t["xx"] * x * x + t["yy"] * y * y + t["xy"] * x * y + t["root"] * math.sqrt(abs(x)) + waves(x, COMMON_WAVES) + waves(own, ws)

    x, y, rad = lng - 105.0, lat - 35.0, lat / 180 * PI
    magic = 1 - ECCENTRICITY * math.sin(rad) ** 2
    return (lng + offset(x, y, LNG_TERMS, x, LNG_WAVES) * 180 / (AXIS / math.sqrt(magic) * math.cos(rad) * PI), lat + offset(x, y, LAT_TERMS, y, LAT_WAVES) * 180 / (AXIS * (1 - ECCENTRICITY) / (magic * math.sqrt(magic)) * PI))
