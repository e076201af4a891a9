"""The published workflows from files to files. Each reads its inputs once and writes tables; figures' data are tables too."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.functions.clean import to_double
from equireach.functions.text import fmt_num, star_from_p
from equireach.operators import catchment, concentration, decomposition, facilities, panel, regression, spatial, weighted
from equireach.sources import geojson, providers, sinks, yearly

LEVELS = {"national": (), "province": ("省级",), "city": ("地级",), "county": ("县级码",)}


def accessibility_stats(spark: SparkSession, folder: str, out: str, years: Sequence[int], levels: dict[str, Sequence[str]] | None = None, value: str = "acc", weight: str = "pop") -> dict[str, DataFrame]:
    """Statistics by year at each level, out/<level>; a year without a file, or without the level's columns, is left out.

    Files are read once for all levels. The result, a row for each year and group, is staged at out/stage.
    """
    levels = levels or LEVELS
    rows = yearly.load_years(spark, folder, years)
    if rows is None:
        return {}
    known = {name: ["year", *keys] for name, keys in levels.items() if set(keys) <= set(rows.columns)}
    path = f"{out.rstrip('/')}/stage"
    weighted.stats_at_levels(rows, known, value, weight).write.mode("overwrite").parquet(path)
    whole, made = spark.read.parquet(path), {}
    for name, keys in known.items():
        own = [F.col(f"`{k}`") for k in keys]
        made[name] = whole.where(F.col("level") == name).select(*own, *(F.col(f"`{c}`") for c in weighted.STATISTICS)).orderBy(*own).withColumnRenamed("year", "Year")
        sinks.write_csv(made[name], f"{out}/{name}", single=len(keys) == 1)
    return made


def concentration_analysis(spark: SparkSession, folder: str, out: str, years: Sequence[int], spec: concentration.AnalysisSpec, adjust: float = 5.0) -> dict[str, DataFrame]:
    """Index by year, its trend, curves of the first and last year, densities of the rank variable; one scan, kept."""
    rows = yearly.load_years(spark, folder, years)
    if rows is None:
        raise FileNotFoundError(f"no grid files in {folder}")
    numeric = rows.withColumns({c: to_double(F.col(c)) for c in (spec.rank_var, spec.y_var, spec.w_var) if c in rows.columns}).cache()
    ends = numeric.where(F.col("year").isin(min(years), max(years)))
    series = concentration.ci_series(numeric, years, spec)
    made = {
        "ci": series,
        "trend": concentration.ci_trend(series),
        "curve": concentration.concentration_curve(ends, spec.rank_var, spec.y_var, spec.w_var, ["year"], spec.valid_rank_rule),
        "density": concentration.weighted_kde(ends.where(F.col(spec.rank_var) > 0), spec.rank_var, spec.w_var, adjust=adjust, keys=["year"]),
    }
    for name, df in made.items():
        sinks.write_csv(df, f"{out}/{spec.name}/{name}", single=name != "curve")
    numeric.unpersist()
    return made


def city_panel(spark: SparkSession, cities: str, gdp: str, flow: str, density: str, provincial: str, city: str, county: str, out: str, first: int = 2014, last: int = 2024, county_key: str = "县级") -> DataFrame:
    """The regression panel of cities as CSV; density may be CSV or a small spreadsheet."""

    def numbers(path: str, text: Sequence[str]) -> DataFrame:
        df = yearly.load_excel(spark, path) if path.endswith((".xlsx", ".xls")) else yearly.csv(spark, path)
        return df.select(*(F.col(f"`{c}`") if c in text else F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns))

    made = panel.regression_panel(yearly.load_cities(spark, cities, first, last), numbers(gdp, ["城市"]), numbers(flow, ["城市"]), numbers(density, ["城市"]), numbers(provincial, ["省级"]), numbers(city, ["地级"]), numbers(county, [county_key]), county_key)
    sinks.write_csv(made, out, single=True)
    return made


def formatted_effects(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(City size, one column a metric): effects with four decimals and stars."""
    text = F.concat(fmt_num(F.col("effect")), star_from_p(F.col("p")))
    wide = table.withColumn("text", text).groupBy("level").pivot("metric", list(metrics)).agg(F.first("text"))
    return wide.withColumnRenamed("level", "City size")


def expansion_models(spark: SparkSession, panel_csv: str, out: str) -> dict[str, regression.Fit]:
    """All models of a panel: VIF, coefficients and covariance of the interacted accessibility model, effect tables,
    marginal effects for a figure, and a text table of every model."""
    df = yearly.csv(spark, panel_csv)
    numeric = df.select(*(F.col(f"`{c}`") if c in panel.KEYS else F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns))
    ready = regression.prepared(regression.load_city_panel(numeric)).cache()
    fits = regression.model_set(ready)
    small = lambda rows, schema, name: sinks.write_csv(spark.createDataFrame(rows, schema), f"{out}/{name}", single=True)
    sinks.write_csv(regression.vif(ready, ["acc_2014", *regression.CONTROLS, "city_SEE", "city_CIE"]), f"{out}/vif_acc", single=True)
    main = fits["acc_delta_3"]
    sinks.write_csv(main.frame(spark), f"{out}/model_acc3_params", single=True)
    small([(t, *map(float, row)) for t, row in zip(main.terms, main.cov, strict=True)], "term string, " + ", ".join(f"`{t}` double" for t in main.terms), "model_acc3_cov")
    small([(float(main.df_resid),)], "df_resid double", "model_acc3_df")
    for name, variable, family in (("see_total_effects", "city_SEE", "see_cie"), ("cie_total_effects", "city_CIE", "see_cie"), ("total_expansion_effects", "city_TotalExpansion", "total")):
        chosen = {m: fits[f"{y}_delta_{family}_3"] for m, y in (("gini", "gini"), ("theil", "theil"), ("mld", "MLD"))}
        sinks.write_csv(formatted_effects(regression.effect_table(spark, chosen, variable), list(chosen)), f"{out}/{name}", single=True)
    small(regression.marginal_effects(main), EFFECTS, "marginal_effects")
    texts = [f.text(n) for n, f in fits.items()] + [regression.side_by_side({n: f for n, f in fits.items() if n.rsplit("_", 1)[0] == family}) for family in dict.fromkeys(n.rsplit("_", 1)[0] for n in fits)]
    spark.createDataFrame([(x,) for x in texts], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/models")
    ready.unpersist()
    return fits


def decompose(spark: SparkSession, config: str, root: str, out: str, method: str = "banzhaf_rescaled") -> DataFrame:
    """All tasks of a JSON file with paths relative to root; rows by task and indicator, and the bars of their figures."""
    tasks = json.loads("\n".join(r["value"] for r in spark.read.text(config).collect()))
    rows = decomposition.run_tasks(spark, tasks, lambda p: yearly.csv(spark, f"{root}/{p}"), method=method).cache()
    sinks.write_by(rows, f"{out}/by_indicator", ["task", "indicator"])
    sinks.write_csv(rows, f"{out}/all", single=True)
    sinks.write_csv(decomposition.waterfall(rows), f"{out}/waterfall", single=True)
    return rows


CELLS = "grid_id string, lng double, lat double, pop double, geometry string, acc double, nearest_L3_time double, {}crs string, region string"


def accessibility_dataset(spark: SparkSession, boundaries: str, grids: dict[str, str], hospitals: str, times: providers.TravelTimes, out: str, level3_only: bool = True, scale: float = catchment.SCALE, reach_km: float | None = None) -> DataFrame:
    """Accessibility of every grid cell of every region, one folder a region. grids: a GeoJSON file for each region.

    Hospitals need lng, lat, beds and grade and belong to the region whose polygon holds them; a region without any has
    accessibility 0. Regions that have output are left as they are, whatever the inputs say now; the others run as one
    job. Where that fails, halves of them run, down to single regions; one that fails alone is logged and left out.
    Returns what is stored of all regions, with no rows if there are none.

    Supply ratios are staged at out.s1 by region and by a hash of the region's inputs and these settings, and used again
    by a later run with the same; delete out.s1 when travel times change. reach_km: see catchment.near_pairs.
    """
    raw = yearly.csv(spark, hospitals, line_breaks=True)
    if missing := {"lng", "lat", "beds", "grade"} - set(raw.columns):
        raise ValueError(f"hospitals lack {sorted(missing)}")
    outlines = geojson.boundaries(spark, boundaries).withColumnRenamed("name", "region")
    keyed = facilities.with_key(raw.withColumns({c: F.col(c).try_cast("double") for c in ("lng", "lat")}), "hospital_id")
    own = spatial.clip(keyed, outlines, name="region").select("region", F.col("hospital_id").cast("string").alias("hospital_id"), "lng", "lat", "beds", "grade")
    if level3_only:
        own = own.where(F.col("grade").startswith("Level3"))

    def attempt(names: list[str]) -> None:
        try:
            _run_regions(spark, names, grids, own, times, out, level3_only, scale, reach_km)
        except (PySparkException, OSError, ValueError) as e:
            if len(names) == 1:
                logging.getLogger(__name__).warning("region %s failed: %s", names[0], e)
                return
            attempt(names[: len(names) // 2])
            attempt(names[len(names) // 2 :])

    if names := sorted(r["region"] for r in sinks.pending(outlines.select("region"), spark, out).distinct().collect() if r["region"] in grids):
        attempt(names)
    schema = CELLS.format("" if level3_only else "nearest_L2_time double, nearest_L1_time double, ")
    return spark.read.schema(schema).parquet(out) if yearly.exists(spark, out) else spark.createDataFrame([], schema)


def _run_regions(spark: SparkSession, names: list[str], grids: dict[str, str], own: DataFrame, times: providers.TravelTimes, out: str, level3_only: bool, scale: float, reach_km: float | None) -> None:
    """Both steps for the named regions, and their output."""
    cells = reduce(DataFrame.unionByName, (geojson.grid(spark, grids[n]).withColumn("region", F.lit(n)) for n in names))
    own = own.where(F.col("region").isin(names))

    def hashed(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy("region").agg(F.sum(F.xxhash64(*columns, F.lit(f"{level3_only} {scale} {reach_km}")).cast("decimal(38,0)")).alias("h"))

    both = hashed(own, "hospital_id", "lng", "lat", "beds", "grade").unionAll(hashed(cells, "grid_id", "lng", "lat", "pop"))
    inputs = {r["region"]: format(int(r["h"]) % (1 << 64), "x") for r in both.groupBy("region").agg(F.sum("h").alias("h")).collect()}
    keep = spark.createDataFrame(list(inputs.items()), "region string, inputs string")
    path, schema = f"{out.rstrip('/')}.s1", "hospital_id string, grade string, R double, region string, inputs string"
    done = spark.read.schema(schema).parquet(path).join(F.broadcast(keep), ["region", "inputs"]) if yearly.exists(spark, path) else spark.createDataFrame([], schema)
    todo = sorted(set(inputs) - {r["region"] for r in done.select("region").distinct().collect()})
    if todo:
        a = own.where(F.col("region").isin(todo)).select("region", F.col("hospital_id").alias("origin_id"), F.col("lng").alias("origin_lng"), F.col("lat").alias("origin_lat"))
        b = cells.where(F.col("region").isin(todo) & (F.col("pop") > 0)).select("region", F.col("grid_id").alias("dest_id"), F.col("lng").alias("dest_lng"), F.col("lat").alias("dest_lat"))
        there = times.minutes(catchment.near_pairs(a, b, reach_km)).select("region", F.col("origin_id").alias("hospital_id"), F.col("dest_id").alias("grid_id"), "minutes")
        supplied = catchment.supply_ratio(own.where(F.col("region").isin(todo)).select("region", "hospital_id", "beds", "grade"), cells, there, ["region"], scale)
        supplied = supplied.join(F.broadcast(keep), "region").select("hospital_id", "grade", "R", "region", "inputs")
        supplied.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region", "inputs").parquet(path)
    if yearly.exists(spark, path):
        done = spark.read.schema(schema).parquet(path).join(F.broadcast(keep), ["region", "inputs"])
    ready = own.join(done.where("R > 0").select("region", "hospital_id"), ["region", "hospital_id"])
    c = cells.select("region", F.col("grid_id").alias("origin_id"), F.col("lng").alias("origin_lng"), F.col("lat").alias("origin_lat"))
    d = ready.select("region", F.col("hospital_id").alias("dest_id"), F.col("lng").alias("dest_lng"), F.col("lat").alias("dest_lat"))
    back = times.minutes(catchment.near_pairs(c, d, reach_km)).select("region", F.col("dest_id").alias("hospital_id"), F.col("origin_id").alias("grid_id"), "minutes")
    sinks.write_geometry(catchment.accessibility(cells, done.select("region", "hospital_id", "grade", "R"), back, ["region"], level3_only), out, by=["region"])


def stored_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Marginal effects from the stored coefficients, covariance and degrees of freedom of a model (see expansion_models)."""
    params = {r["term"]: float(r["coef"]) for r in yearly.csv(spark, f"{folder}/model_acc3_params").collect()}
    rows = {r["term"]: r for r in yearly.csv(spark, f"{folder}/model_acc3_cov").collect()}
    cov = np.array([[float(rows[a][b]) for b in params] for a in params])
    df_resid = int(float(yearly.csv(spark, f"{folder}/model_acc3_df").first()["df_resid"]))
    fit = regression.Fit(tuple(params), np.array(list(params.values())), cov, df_resid, 0, float("nan"))
    return spark.createDataFrame(regression.marginal_effects(fit), EFFECTS)


EFFECTS = "variable string, level string, effect double, se double, low double, high double, p double"
