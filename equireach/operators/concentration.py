"""Concentration index and curve by rank, and weighted density estimates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.functions.clean import divided, valid_rows
from equireach.operators.runs import collapse, prefix_sums


@dataclass(frozen=True)
class AnalysisSpec:
    """What a series of indices is about."""

    name: str
    rank_var: str
    y_var: str = "acc"
    w_var: str = "pop"
    valid_rank_rule: str = "gt0"
    xlabel: str = ""
    xlim: tuple[float, float] | None = None


def ranked_runs(df: DataFrame, rank: str, y: str, w: str, keys: Sequence[str] = (), rule: str = "gt0", buckets: int | None = None) -> DataFrame:
    """Runs of valid rows in rank order (rank, then y, then w) with prefix sums of w and of w*y."""
    keyed = valid_rows(df, rank, y, w, rule)
    for k in keys:
        keyed = keyed.where(F.col(f"`{k}`").isNotNull())
    runs = collapse(keyed, keys, {"rank": F.col(f"`{rank}`"), "y": F.col(f"`{y}`"), "w": F.col(f"`{w}`")})
    part = F.col("w") * F.col("copies")
    return prefix_sums(runs, keys, ["rank", "y", "w"], {"w": part, "yw": F.col("y") * part}, buckets)


def index_column() -> Column:
    """2 * sum w (y - m)(r - 1/2) / (W m), r the middle of a row's share of weight; null for fewer than two rows or m = 0."""
    n, w, total = F.col("copies"), F.col("w"), F.col("w_all")
    centred = F.col("y") - F.col("yw_all") / total
    before = F.col("w_to") - w * n
    ranks = n * (before / total - 0.5) + w / total * n * n / 2
    m = F.max(F.col("yw_all") / total)
    return F.when((F.sum(n) >= 2) & (m != 0), 2 * F.sum(w * centred * ranks / total) / m)


def concentration_index(df: DataFrame, rank: str, y: str, w: str, keys: Sequence[str] = (), rule: str = "gt0", buckets: int | None = None) -> DataFrame:
    """(keys, n, pop, mean_y, ci) for each group."""
    runs = ranked_runs(df, rank, y, w, keys, rule, buckets)
    grouped = runs.groupBy(*(F.col(f"`{k}`") for k in keys)) if keys else runs.groupBy()
    return grouped.agg(F.sum("copies").cast("long").alias("n"), F.max("w_all").alias("pop"), F.max(divided(F.col("yw_all"), F.col("w_all"))).alias("mean_y"), index_column().alias("ci"))


def ci_series(df: DataFrame, years: Sequence[int], spec: AnalysisSpec, year: str = "year", buckets: int | None = None) -> DataFrame:
    """One row for each year asked for, with nulls where the data have no index for it."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(int(y),) for y in years], f"`{year}` int")
    found = concentration_index(df, spec.rank_var, spec.y_var, spec.w_var, [year], spec.valid_rank_rule, buckets)
    return asked.join(found, year, "left").select(year, F.lit(spec.name).alias("name"), "n", "pop", "mean_y", "ci")


def concentration_curve(df: DataFrame, rank: str, y: str, w: str, keys: Sequence[str] = (), rule: str = "gt0", buckets: int | None = None) -> DataFrame:
    """(keys, rank, y, w, copies, cum_pop, cum_y): running shares in rank order, at the end of each run of equal rows.

    A group whose weights or weighted values do not add up to more than 0 has no curve; no point at the origin is added.
    """
    runs = ranked_runs(df, rank, y, w, keys, rule, buckets).where("w_all > 0 AND yw_all > 0")
    return runs.select(*(F.col(f"`{k}`") for k in keys), "rank", "y", "w", "copies", (F.col("w_to") / F.col("w_all")).alias("cum_pop"), (F.col("yw_to") / F.col("yw_all")).alias("cum_y"))


def ci_trend(series: DataFrame, labelled: Sequence[int] = (2014, 2023), year: str = "year") -> DataFrame:
    """The years that have an index, in order, and whether a figure labels them."""
    return series.where("ci IS NOT NULL").withColumn("labelled", F.col(year).isin(list(labelled))).orderBy(year)


def weighted_kde(df: DataFrame, x: str, w: str, points: int = 200, cut: float = 3.0, adjust: float = 5.0, clip: tuple[float | None, float | None] = (0.0, None), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, grid_x, density): a Gaussian density estimate at `points` evenly spaced values.

    Scott's factor of the effective size (sum w)^2 / sum w^2, times adjust; variance with divisor W - sum w^2 / W; the
    grid reaches cut bandwidths beyond the data, within clip. Rows need finite x and w > 0. Each row meets the grid of
    its group, whose size is a parameter; equal values are counted together before. A group without spread has no rows.
    """
    runs = collapse(valid_rows(df.withColumn("_zero", F.lit(0.0)), "_zero", x, w, "ge0"), keys, {"x": F.col(f"`{x}`"), "w": F.col(f"`{w}`")})
    key = [F.col(f"`{k}`") for k in keys]
    data = runs.groupBy(*key, "x").agg(F.sum(F.col("w") * F.col("copies")).alias("w"), F.sum(F.col("w") * F.col("w") * F.col("copies")).alias("ww"))
    sums = data.groupBy(*key).agg(F.sum("w").alias("all_w"), F.sum("ww").alias("all_ww"), F.sum(F.col("x") * F.col("w")).alias("all_xw"), F.min("x").alias("low"), F.max("x").alias("high"))
    named = sums.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), "all_w", "all_ww", "all_xw", "low", "high")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(f"`{k}`") == F.col(f"_k{i}"))
    spread = data.join(F.broadcast(named) if not keys else named, on).groupBy(*key).agg(*(F.max(c).alias(c) for c in ("all_w", "all_ww", "low", "high")), F.sum(F.col("w") * F.pow(F.col("x") - F.col("all_xw") / F.col("all_w"), 2)).alias("squares"))
    factor = F.pow(F.col("all_w") * F.col("all_w") / F.col("all_ww"), -0.2) * adjust
    band = spread.withColumn("rest", F.col("all_w") - F.col("all_ww") / F.col("all_w")).where("rest > 0 AND squares > 0").withColumn("h", factor * F.sqrt(F.col("squares") / F.col("rest")))
    low, high = F.col("low") - cut * F.col("h"), F.col("high") + cut * F.col("h")
    low = F.greatest(low, F.lit(float(clip[0]))) if clip[0] is not None else low
    high = F.least(high, F.lit(float(clip[1])) if clip[1] is not None else F.col("high"))
    grid = band.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), "all_w", "h", low.alias("a"), high.alias("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("grid_x", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1))
    kernel = F.exp(-0.5 * F.pow((F.col("grid_x") - F.col("x")) / F.col("h"), 2)) / (F.col("h") * (2 * 3.141592653589793) ** 0.5)
    met = data.join(F.broadcast(grid) if not keys else grid, on)
    return met.groupBy(*key, "i", "grid_x").agg((F.sum(F.col("w") * kernel / F.col("all_w"))).alias("density"))
