"""Weighted distribution statistics: quantiles of two kinds, spread, Gini, Theil, mean log deviation, ratios.

One pass counts equal rows into runs, one sorted pass takes prefix sums, one aggregation reads off every statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.functions.clean import divided, to_double
from equireach.operators.runs import collapse, prefix_sums

STATISTICS = ("min", "max", "grid_num", "pop_num", "pop_mean", "pop_25%", "pop_median", "pop_75%", "pop_std", "pop_gini", "pop_theil", "pop_MLD", "p90_p10", "p80_p20")


def _sums(runs: DataFrame, keys: Sequence[str], buckets: int | None) -> DataFrame:
    part = F.coalesce(F.col("w") * F.col("copies"), F.lit(0.0))
    return prefix_sums(runs, keys, ["x", "w"], {"w": part, "xw": F.coalesce(F.col("x") * part, F.lit(0.0)), "pos": F.when(F.col("x") > 0, part).otherwise(0.0)}, buckets)


def _numbers(value: str, weight: str) -> dict[str, Column]:
    """x and w of a row, both null where the row is not valid."""
    x, w = to_double(F.col(f"`{value}`")), to_double(F.col(f"`{weight}`"))
    valid = x.isNotNull() & (w > 0)
    return {"x": F.when(valid, x), "w": F.when(valid, w)}


def sorted_runs(df: DataFrame, value: str, weight: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Runs (x, w, copies) of valid rows with prefix sums of w, x*w and, over x > 0, of w; one run with null x and w
    stands for a group's invalid rows, so that a group of those alone stays. Rows with a null key go."""
    keyed = df
    for k in keys:
        keyed = keyed.where(F.col(f"`{k}`").isNotNull())
    return _sums(collapse(keyed, keys, _numbers(value, weight)), keys, buckets)


def _first(value: Column, along: Column, where: Column) -> Column:
    """value in the first row, by along, for which where holds."""
    return F.min_by(F.when(where, value), F.when(where, along))


def interpolated(q: float) -> Column:
    """The percentile that interpolates between values over running weight; the smallest value below the first weight."""
    target, before = F.col("w_all") * F.lit(q / 100.0), F.col("w_to") - F.col("w") * F.col("copies")
    between = F.col("previous") + (F.col("x") - F.col("previous")) * (target - before) / F.col("w")
    value = F.when(F.col("previous").isNotNull() & (before > 0) & (target <= before + F.col("w")), between).otherwise(F.col("x"))
    return _first(value, F.col("w_to"), F.col("x").isNotNull() & (F.col("w_to") >= target))


def step(q: float, positive: bool = False) -> Column:
    """The first value at which the share of weight reaches q; positive: among values above 0."""
    to, total = ("pos_to", "pos_all") if positive else ("w_to", "w_all")
    there = F.col("x") > 0 if positive else F.col("x").isNotNull()
    return F.min(F.when(there & (F.col(to) / F.when(F.col(total) > 0, F.col(total)) >= q), F.col("x")))


def ratio(high: float, low: float) -> Column:
    """step(high) / step(low) among values above 0; null where the lower is."""
    return divided(step(high, True), step(low, True))


def mean() -> Column:
    return divided(F.sum(F.col("x") * F.col("w") * F.col("copies")), F.sum(F.col("w") * F.col("copies")))


def deviation() -> Column:
    """The weighted standard deviation with the sample correction for reliability weights; null for one row."""
    centre = F.col("xw_all") / F.when(F.col("w_all") > 0, F.col("w_all"))
    part = F.col("w") * F.col("copies")
    rest = F.sum(part) - divided(F.sum(F.col("w") * part), F.sum(part))
    return F.sqrt(F.when(rest > 0, F.sum(part * F.pow(F.col("x") - centre, 2)) / rest))


def gini() -> Column:
    """1 - 2 * sum(running x*w, itself included, times w) / (sum x*w * sum w): no correction, so below 0 for equal values."""
    n, one = F.col("copies"), F.col("x") * F.col("w")
    before = F.col("xw_to") - one * n
    area = F.sum(F.col("w") * (before * n + one * n * (n + 1) / 2))
    total, weight = F.sum(one * n), F.sum(F.col("w") * n)
    return F.when((weight > 0) & (total > 0), 1 - 2 * area / (total * weight))


def _positive(c: Column) -> Column:
    return F.sum(F.when(F.col("x") > 0, c * F.col("w") * F.col("copies")))


def _log_mean() -> Column:
    m = divided(_positive(F.col("x")), _positive(F.lit(1.0)))
    return F.ln(F.when(m > 0, m))


def _ln() -> Column:
    return F.ln(F.when(F.col("x") > 0, F.col("x")))


def theil() -> Column:
    """Over values above 0: sum w (x/m) ln(x/m) / sum w, m their mean."""
    return divided(_positive(F.col("x") * _ln()), _positive(F.col("x"))) - _log_mean()


def mean_log_deviation() -> Column:
    """Over values above 0: sum w ln(m/x) / sum w."""
    return _log_mean() - divided(_positive(_ln()), _positive(F.lit(1.0)))


def statistic_columns() -> list[Column]:
    n = F.col("copies")
    return [
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), n)), F.lit(0)).cast("long").alias("grid_num"),
        F.coalesce(F.sum(F.col("w") * n), F.lit(0.0)).cast("long").alias("pop_num"),
        mean().alias("pop_mean"),
        interpolated(25).alias("pop_25%"),
        interpolated(50).alias("pop_median"),
        interpolated(75).alias("pop_75%"),
        deviation().alias("pop_std"),
        gini().alias("pop_gini"),
        theil().alias("pop_theil"),
        mean_log_deviation().alias("pop_MLD"),
        ratio(0.9, 0.1).alias("p90_p10"),
        ratio(0.8, 0.2).alias("p80_p20"),
    ]


def weighted_stats(df: DataFrame, value: str = "acc", weight: str = "pop", keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """STATISTICS of value by weight, one row for each group of keys (one in all without keys).

    Values that are not finite numbers, and weights not above 0, do not count; a group left without rows has counts 0
    and nulls. pop_num is the whole part of the weight. buckets spreads each group's sorting over so many tasks, as many
    as the session has shuffle partitions unless given.
    """
    runs = sorted_runs(df, value, weight, keys, buckets)
    return (runs.groupBy(*(F.col(f"`{k}`") for k in keys)) if keys else runs.groupBy()).agg(*statistic_columns())


def stats_at_levels(df: DataFrame, levels: dict[str, Sequence[str]], value: str = "acc", weight: str = "pop", buckets: int | None = None) -> DataFrame:
    """weighted_stats at several grouping levels in one plan: (level, the keys of all levels, STATISTICS).

    Keys that a level does not group by are null in its rows; rows with a null in one of a level's keys do not count at
    that level. df is read once: equal rows are counted at the finest level, and coarser levels add up these counts.
    """
    names = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    finest = collapse(df, names, _numbers(value, weight))
    there = {level: F.lit(True) for level in levels}
    for level, keys in levels.items():
        for k in keys:
            there[level] = there[level] & F.col(f"`{k}`").isNotNull()
    at = F.explode(F.filter(F.array(*(F.when(there[level], F.lit(level)) for level in levels)), lambda x: x.isNotNull()))
    by_level = finest.withColumn("level", at).withColumns({k: F.when(F.col("level").isin([level for level, keys in levels.items() if k in keys]), F.col(f"`{k}`")) for k in names})
    by = ["level", *names]
    columns = [F.col(f"`{k}`") for k in by]
    runs = by_level.groupBy(*columns, "x", "w").agg(F.sum("copies").alias("copies"))
    return _sums(runs, by, buckets).groupBy(*columns).agg(*statistic_columns())
