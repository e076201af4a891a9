"""Outside services behind an interface: travel times and geocoding. A table stands in for either.

A service is called from mapInPandas, one session for each task; what it could not answer is null, never an error.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equireach.functions.geo import haversine_km
from equireach.operators.catchment import first_cost, jitter_offsets

PAIR = ("region", "origin_id", "dest_id")


class TravelTimes(ABC):
    """Minutes between the pairs of a frame (region, origin_id, origin_lng, origin_lat, dest_id, dest_lng, dest_lat)."""

    @abstractmethod
    def minutes(self, pairs: DataFrame) -> DataFrame:
        """(region, origin_id, dest_id, minutes); null where there is no path."""


class TableTimes(TravelTimes):
    """Times from an origin-destination table."""

    def __init__(self, od: DataFrame):
        self.od = od.select(*PAIR, "minutes")

    def minutes(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(*PAIR).join(self.od, list(PAIR), "left")


class DistanceTimes(TravelTimes):
    """Times from great-circle distance at a steady speed."""

    def __init__(self, km_per_hour: float = 40.0):
        self.speed = km_per_hour

    def minutes(self, pairs: DataFrame) -> DataFrame:
        km = haversine_km(F.col("origin_lng"), F.col("origin_lat"), F.col("dest_lng"), F.col("dest_lat"))
        return pairs.select(*PAIR, (km / self.speed * 60).alias("minutes"))


class ServiceTimes(TravelTimes):
    """Times from a routing service: the first of 25 jittered pairs of points that it finds a path for.

    ask(lng, lat, lng, lat) returns minutes or None and may raise; it is sent to the executors. A pair of points that has
    no time because a call failed is asked for again, `retries` times at most, after `pause` seconds.
    """

    def __init__(self, ask: Callable[[float, float, float, float], float | None], retries: int = 1, pause: float = 0.1):
        self.ask, self.retries, self.pause = ask, retries, pause

    def minutes(self, pairs: DataFrame) -> DataFrame:
        ask, moves, retries, pause = self.ask, jitter_offsets(), self.retries, self.pause

        def one(a: float, b: float, c: float, d: float) -> float | None:
            for turn in range(retries + 1):
                failed = False
                for _, dx, dy, ex, ey in moves:
                    try:
                        if (cost := ask(a + dx, b + dy, c + ex, d + ey)) is not None:
                            return float(cost)
                    except (OSError, ValueError):  # the next pair of points may have a path
                        failed = True
                if not failed:
                    break
                if turn < retries:
                    time.sleep(pause)
            return None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                cost = [one(*x) for x in f[["origin_lng", "origin_lat", "dest_lng", "dest_lat"]].itertuples(index=False)]
                yield f[list(PAIR)].assign(minutes=pd.Series(cost, dtype="Float64", index=f.index))

        kinds = {c: t for c, t in pairs.dtypes}
        return pairs.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in PAIR), "minutes double"]))


def http_router(url: str, timeout: float = 0.5) -> Callable[[float, float, float, float], float | None]:
    """A routing service that takes two points as GeoJSON and answers with a feature whose weight is the cost."""

    def ask(a: float, b: float, c: float, d: float) -> float | None:
        import requests

        points = [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": p}} for p in ([a, b], [c, d])]
        answer = requests.post(url, json={"type": "FeatureCollection", "features": points}, timeout=timeout).json()
        features = answer.get("features") if isinstance(answer, dict) else None
        weight = features[0].get("properties", {}).get("weight") if features else None
        return None if weight in (None, "no path found") else float(weight)

    return ask


def jittered_costs(tries: DataFrame) -> DataFrame:
    """The table form of the same rule: tries (region, origin_id, dest_id, ordinal, cost)."""
    return first_cost(tries, PAIR)


def geocode(df: DataFrame, ask: Callable[[str], tuple | None], address: str = "addr") -> DataFrame:
    """df with lng_bd08, lat_bd08, confidence and comprehension; nulls where ask(address) gives None or fails."""
    fields = ("lng_bd08", "lat_bd08", "confidence", "comprehension")

    def one(text: object) -> tuple:
        try:
            return ask(str(text)) or (None,) * 4
        except (OSError, ValueError):
            return (None,) * 4

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(x) for x in f[address]]
            yield f.assign(**{n: pd.Series([g[i] for g in got], dtype="Float64", index=f.index) for i, n in enumerate(fields)})

    kept = df.drop(*fields)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), *(f"{n} double" for n in fields)])
    return kept.mapInPandas(run, schema)


def http_geocoder(url: str, key: str, timeout: float = 10.0) -> Callable[[str], tuple | None]:
    """A geocoding service that answers status 0 and a result with location, confidence and comprehension."""

    def ask(text: str) -> tuple | None:
        import requests

        answer = requests.get(url, params={"address": text, "output": "json", "ak": key}, timeout=timeout).json()
        if answer.get("status") != 0:
            return None
        result = answer["result"]
        return result["location"]["lng"], result["location"]["lat"], result["confidence"], result["comprehension"]

    return ask
