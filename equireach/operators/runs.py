"""Prefix sums over sorted rows that no single task has to hold.

Rows alike in all sorting columns are counted into one run first, on the map side, so a value that a quarter of all
rows share costs one row. Runs are dealt to buckets of consecutive first values; each bucket adds up its own, and a
table of bucket totals, one row for each group and bucket, gives what stands before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One row for each group and combination of columns, `copies` of it."""
    return df.select(*(F.col(f"`{k}`") for k in keys), *(c.alias(n) for n, c in columns.items())).groupBy(*(F.col(f"`{k}`") for k in keys), *columns).agg(F.count(F.lit(1)).alias("copies"))


def _dealt(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """df with the _bucket of each row's value: its place, by binary search, among approximate quantiles of all rows,
    which a subquery of the same plan finds."""
    if buckets <= 1:
        return df.withColumn("_bucket", F.lit(0))
    # a value that needs every column leaves the subquery the same shuffle as the rest of the plan, which is then done once
    value = F.when(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) != 0, F.col(order))
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 20 * buckets))).alias("cuts")).scalar()
    steps = [1 << k for k in reversed(range((buckets - 1).bit_length()))]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(order), at + step).otherwise(at))
    # never null, so that no test for null goes below the shuffle and makes it another one
    return df.withColumn("_cuts", cuts).withColumn("_bucket", F.coalesce(place, F.lit(0))).drop("_cuts")


def default_buckets(df: DataFrame) -> int:
    """As many as the session's shuffle partitions: groups of any size then sort in that many tasks together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(runs: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """runs with, for each sum s over a run's copies: s_to (up to its end), s_all (of the group); and `previous`, the
    first ordering column of the run before. The first ordering column is a number. Null keys are a group. A group is
    split over `buckets` tasks, default_buckets() unless given."""
    key = [F.col(f"`{k}`") for k in keys]
    buckets = default_buckets(runs) if buckets is None else buckets
    dealt = _dealt(runs, order[0], buckets).withColumns({f"_{s}": c for s, c in sums.items()})
    totals = dealt.groupBy(*key, "_bucket").agg(*(F.sum(f"_{s}").alias(f"_{s}_in") for s in sums), F.max(order[0]).alias("_last"))
    group = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    along = group.orderBy("_bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)),
        F.col("_bucket").alias("_of"),
        *(F.coalesce(F.sum(f"_{s}_in").over(before), F.lit(0.0)).alias(f"_{s}_before") for s in sums),
        *(F.sum(f"_{s}_in").over(group).alias(f"{s}_all") for s in sums),
        F.max("_last").over(before).alias("_previous_bucket"),
    )
    within = Window.partitionBy(*key, "_bucket").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({f"_{s}_to": F.sum(f"_{s}").over(running) for s in sums} | {"_lag": F.lag(order[0]).over(within)})
    on = F.col("_bucket") == F.col("_of")
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_key_{i}"))
    met = local.join(totals, on)
    return met.select(*(F.col(f"`{c}`") for c in runs.columns), F.coalesce("_lag", "_previous_bucket").alias("previous"), *((F.col(f"_{s}_to") + F.col(f"_{s}_before")).alias(f"{s}_to") for s in sums), *(F.col(f"{s}_all") for s in sums))
