"""The city panel: expansion measures summed over years, controls joined, baselines with fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equireach.functions.clean import divided, recode

#: Levels that are merged, municipalities that stand for a province, columns of the panel.
CITY_LEVELS = {"Type I Large City": "Large City", "Type II Large City": "Large City", "Medium-sized City": "Medium/Small City", "Small City": "Medium/Small City"}
MUNICIPALITIES = ("北京市", "上海市", "天津市", "重庆市")
BASELINES = {"pop_median": "acc_2014", "pop_gini": "gini_2014", "pop_theil": "theil_2014", "pop_MLD": "MLD_2014", "p90_p10": "p90_p10_2014", "p80_p20": "p80_p20_2014"}
KEYS = ("省级", "地级", "city_level")
SUMMED = ("new_hosp_beds", "expanded_beds", "acc_delta", "gini_delta", "theil_delta", "MLD_delta", "p90_p10_delta", "p80_p20_delta")


class DuplicateKey(ValueError):
    """A table has several rows where one is expected."""


def _unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    if df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise DuplicateKey(f"{what}: several rows for one {', '.join(keys)}")
    return df


def city_expansion(yearly: DataFrame, keys: Sequence[str] = KEYS, population: str = "city_pop", summed: Sequence[str] = SUMMED, new: str = "new_hosp_beds", grown: str = "expanded_beds") -> DataFrame:
    """Mean population and sums per key (0 where all are null; rows with a null key go), with city_SEE, city_CIE, Dominance."""
    rows = yearly
    for k in keys:
        rows = rows.where(F.col(f"`{k}`").isNotNull())
    out = rows.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.avg(population).alias("city_pop"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in summed))
    return dominance(out, new, grown)


def dominance(df: DataFrame, new: str = "new_hosp_beds", grown: str = "expanded_beds", population: str = "city_pop") -> DataFrame:
    """city_SEE and city_CIE, beds for each 10,000 people (null without people), and their difference where one is there."""
    out = df.withColumns({"city_SEE": divided(F.col(new), F.col(population)) * 10000, "city_CIE": divided(F.col(grown), F.col(population)) * 10000})
    zero = F.lit(0.0)
    return out.withColumn("Dominance", F.when(F.col("city_SEE").isNotNull() | F.col("city_CIE").isNotNull(), F.coalesce("city_SEE", zero) - F.coalesce("city_CIE", zero)))


def yearly_cities(yearly: DataFrame) -> DataFrame:
    """Yearly rows with merged city levels; levels that are not merged pass through."""
    return yearly.withColumn("city_level", recode(F.col("city_level"), CITY_LEVELS))


def pivot_growth(df: DataFrame, key: str, year: str, value: str, first: int = 2014, last: int = 2023, name: str = "GDP") -> DataFrame:
    """(key, name_first, name_growth, name_growth_pct) from the values of two years; several rows of a year are an error."""
    rows = df.where(F.col(f"`{year}`").isin(first, last)).where(F.col(f"`{key}`").isNotNull())
    _unique(rows, [key, year], name)
    two = rows.groupBy(F.col(f"`{key}`")).pivot(year, [first, last]).agg(F.first(F.col(f"`{value}`")))
    grown = F.col(f"`{last}`") - F.col(f"`{first}`")
    return two.select(F.col(f"`{key}`"), F.col(f"`{first}`").alias(f"{name}_{first}"), grown.alias(f"{name}_growth"), divided(grown, F.col(f"`{first}`")).alias(f"{name}_growth_pct"))


def population_flow(df: DataFrame, key: str = "城市", year: str = "年份", net: str = "人口净流入(万人)", registered: str = "户籍人口数(万人)", resident: str = "常住人口数(万人)", first: int = 2014, last: int = 2023) -> DataFrame:
    """(key, Ppo_NetIn, Ppo_NetIn_rate, ResPop_2014, ResPop_growth, ResPop_growth_rate) in one aggregation.

    Mean net inflow, its sum over the registered population's, and the resident population of the first year present, null
    if it is null there, with its growth to the last.
    """
    y, res = F.col(f"`{year}`"), F.col(f"`{resident}`")
    rows = df.where(y.between(first, last) & F.col(f"`{key}`").isNotNull())
    _unique(rows, [key, year], "population flow")
    out = rows.groupBy(F.col(f"`{key}`")).agg(F.avg(F.col(f"`{net}`")).alias("Ppo_NetIn"), F.coalesce(F.sum(F.col(f"`{net}`")), F.lit(0.0)).alias("_net"), F.coalesce(F.sum(F.col(f"`{registered}`")), F.lit(0.0)).alias("_reg"), F.min_by(res, y).alias("ResPop_2014"), F.max_by(res, y).alias("_last"))
    growth = F.col("_last") - F.col("ResPop_2014")
    return out.select(F.col(f"`{key}`"), "Ppo_NetIn", divided(F.col("_net"), F.col("_reg")).alias("Ppo_NetIn_rate"), "ResPop_2014", growth.alias("ResPop_growth"), divided(growth, F.col("ResPop_2014")).alias("ResPop_growth_rate"))


def mean_density(df: DataFrame, key: str = "城市", year: str = "年份", value: str = "人口密度(人／平方公里)", first: int = 2014, last: int = 2023) -> DataFrame:
    rows = df.where(F.col(f"`{year}`").between(first, last) & F.col(f"`{key}`").isNotNull())
    return rows.groupBy(F.col(f"`{key}`")).agg(F.avg(F.col(f"`{value}`")).alias("pop_density_mean"))


def left_lookup(df: DataFrame, table: DataFrame, key: str, other: str) -> DataFrame:
    """df with table's columns by key, without table's key; null keys match nothing."""
    right = table.withColumnRenamed(other, "_key")
    return df.join(right, df[key] == right["_key"], "left").drop("_key")


def first_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(F.col(f"`{key}`")).orderBy(*order))).where("_r = 1").drop("_r")


def fill_from(df: DataFrame, table: DataFrame, key: str, other: str, columns: Sequence[str], when_null: str, only: Sequence[str] | None = None) -> DataFrame:
    """Where when_null is null (and key is among only), all the columns come from table's row of that key, null if none."""
    right = table.select(F.col(f"`{other}`").alias("_key"), *(F.col(f"`{c}`").alias(f"_{c}") for c in columns))
    mask = F.col(when_null).isNull()
    if only is not None:
        mask = mask & F.col(f"`{key}`").isin(list(only))
    met = df.withColumn("_mask", mask).join(right, df[key] == right["_key"], "left")
    return met.select(*(F.when(F.coalesce("_mask", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def baseline(stats: DataFrame, key: str, year: int = 2014, order: Sequence[str] | None = None) -> DataFrame:
    """A year's baselines by key under their panel names; with order, the first row of each key."""
    rows = stats.where(F.col("Year") == year)
    if order:
        rows = first_by(rows, key, order)
    return rows.select(F.col(f"`{key}`"), *(F.col(old).alias(new) for old, new in BASELINES.items()))


def regression_panel(yearly: DataFrame, gdp: DataFrame, flow: DataFrame, density: DataFrame, provincial: DataFrame, city: DataFrame, county: DataFrame, county_key: str = "县级", county_order: Sequence[str] | None = None) -> DataFrame:
    """The panel of cities: expansion, controls, 2014 baselines from the city, else the municipality's province, else the county."""
    out = city_expansion(yearly_cities(yearly))
    out = left_lookup(out, pivot_growth(gdp, "城市", "year", "GDP_per"), "地级", "城市")
    out = left_lookup(out, population_flow(flow), "地级", "城市")
    out = left_lookup(out, mean_density(density), "地级", "城市")
    out = left_lookup(out, baseline(city, "地级").withColumnRenamed("地级", "_city"), "地级", "_city")
    columns = list(BASELINES.values())
    out = fill_from(out, baseline(provincial, "省级"), "地级", "省级", columns, "acc_2014", MUNICIPALITIES)
    return fill_from(out, baseline(county, county_key, order=county_order or [county_key, *BASELINES]), "地级", county_key, columns, "acc_2014")
