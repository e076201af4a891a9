"""Facility tables: metadata, construction years, years of operation, keys, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equireach.functions.clean import any_equals, existing
from equireach.functions.geo import bd09_to_wgs84
from equireach.functions.text import UNKNOWN_YEAR, format_time
from equireach.operators.runs import prefix_sums

# Years of the tables, names of their columns.
YEARS = tuple(range(2014, 2026))
ASSIGNED_YEARS = tuple(range(2014, 2025))
ADDRESSES = ("addr_x", "addr_y", "addr_x_base", "addr_y_base")
ASSIGNED = ("name", "grade", "type", "province", "region", "area", "addr", "construction_time", "3A_year", "beds", "lng", "lat", "lng_bd08", "lat_bd08", "confidence", "comprehension")

#: A sample's border lies in one of 2**SAMPLE_BITS cells of hashes.
SAMPLE_BITS = 16


def merge_metadata(base: DataFrame, supplemental: DataFrame, key: str = "name", keep: Sequence[str] | None = None) -> DataFrame:
    """supplemental with base's columns, left join by key; null keys match each other and several matches all stay.

    Of base, the columns in keep that it has; those that both have get the suffix _base. Without an addr column, the
    first of ADDRESSES that exists becomes it, whatever its rows hold.
    """
    wanted = existing(base, keep if keep is not None else ["name", "construction_time", *map(str, YEARS), "addr", "addr_x", "addr_y"])
    clash = set(supplemental.columns)
    right = base.select(F.col(f"`{key}`").alias("_key"), *(F.col(f"`{c}`").alias(f"{c}_base" if c in clash else c) for c in wanted if c != key))
    out = supplemental.join(right, supplemental[key].eqNullSafe(right["_key"]), "left").drop("_key")
    found = existing(out, ADDRESSES)
    return out if "addr" in out.columns or not found else out.withColumn("addr", F.col(f"`{found[0]}`"))


def clean_construction_years(df: DataFrame, column: str = "construction_time", years: Sequence[int] = YEARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows with the year read, those with an unknown year or bed count, the rest)."""
    out = df.withColumn(column, format_time(F.col(f"`{column}`")))
    unknown = any_equals(out, [column, *map(str, years)], UNKNOWN_YEAR)
    return out, out.where(unknown), out.where(~unknown)


def assign_to_years(df: DataFrame, years: Sequence[int] = ASSIGNED_YEARS, drop_unknown: bool = False) -> DataFrame:
    """One row for each facility and year in which it works: built by then, of its grade by then if a year is given, with
    beds. An unknown construction year passes unless drop_unknown. Columns: year and those of ASSIGNED that exist."""
    there = [y for y in years if str(y) in df.columns]
    ids = [c for c in df.columns if c not in set(map(str, YEARS))]
    beds = df.select(*(F.col(f"`{c}`") for c in ids), *(F.col(f"`{y}`").try_cast("double").alias(f"y{y}") for y in there))
    long = beds.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"y{y}") for y in there], "_year", "beds").withColumn("year", F.substring("_year", 2, 4).cast("int")).drop("_year")
    built = F.col("construction_time").try_cast("int")
    graded = F.col("`3A_year`").try_cast("double") if "3A_year" in df.columns else F.lit(None).cast("double")
    working = (built <= F.col("year")) & (graded.isNull() | F.isnan(graded) | (graded <= F.col("year"))) & (F.col("beds") > 0)
    if drop_unknown:
        working = working & (built != UNKNOWN_YEAR)
    return long.where(working).select("year", *(F.col(f"`{c}`") for c in existing(long, ASSIGNED)))


def to_wgs84(df: DataFrame, lng: str = "lng_bd08", lat: str = "lat_bd08") -> DataFrame:
    """df with lng and lat in WGS-84 from BD-09 columns; null where these are, or are no numbers."""
    point = bd09_to_wgs84(F.col(lng).try_cast("double"), F.col(lat).try_cast("double"))
    return df.withColumn("_p", point).withColumns({"lng": F.col("_p.lng"), "lat": F.col("_p.lat")}).drop("_p")


def surrogate_key(df: DataFrame, name: str, order: Sequence[str], buckets: int = 64) -> DataFrame:
    """df with name = 0, 1, ... in the order of columns that together are unique; nulls come first. Rows are dealt to buckets
    of the first column's values, a string's by its first bytes, and numbered there. Without an order, rows are dealt by
    their hash."""
    if order:
        first = F.col(f"`{order[0]}`")
        if dict(df.dtypes)[order[0]] == "string":  # as numbers, the first six bytes are in the strings' order
            first = F.conv(F.rpad(F.substring(F.hex(F.encode(first, "UTF-8")), 1, 12), 12, "0"), 16, 10)
        dealt = df.withColumn("_first", F.coalesce(first.cast("double"), F.lit(float("-inf"))))
        numbered = prefix_sums(dealt, [], ["_first", *order], {"_nth": F.lit(1.0)}, buckets)
        return numbered.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_nth_to") - 1).cast("long").alias(name))
    bucket = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(buckets))
    dealt = df.withColumn("_b", bucket)
    before = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_b").alias("_of"), (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_before"))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*(F.col(f"`{c}`") for c in df.columns))) - 1)
    return local.join(before, F.col("_b") == F.col("_of")).withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_of", "_before", "_r")


def with_key(df: DataFrame, name: str = "hospital_id", order: Sequence[str] = ()) -> DataFrame:
    """df with a unique key: its own column if that is there and unique, else a new one."""
    if name in df.columns:
        if not df.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").take(1):
            return df
        df = df.drop(name)
    return surrogate_key(df, name, order)


def deterministic_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """round(n * fraction) rows, those with the smallest hash of their key, then the smallest key; all rows if that is none.

    Rows are counted by the upper bits of their hash, 2**SAMPLE_BITS counts at most. Whole cells below the border are
    taken as they are; only the border's cell is ranked. Of rows that repeat a key at the border any one goes first.
    """
    hashed = df.withColumn("_h", F.xxhash64(key))
    cell = F.shiftright("_h", 64 - SAMPLE_BITS)
    counts = sorted((r["c"], r["n"]) for r in hashed.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = round(sum(n for _, n in counts) * fraction)
    if left < 1:
        return df
    for border, n in counts:  # noqa: B007
        if left <= n:
            break
        left -= n
    ranked = hashed.where(cell == border).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", key))).where(F.col("_r") <= left)
    return hashed.where(cell < border).drop("_h").unionByName(ranked.drop("_h", "_r"))
