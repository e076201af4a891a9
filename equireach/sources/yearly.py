"""Tables that come as one CSV file a year."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of files and columns.
#: Names a year's grid file may have, in order of preference.
GRID_NAMES = ("national_{year}.csv", "national_{year}_sample.csv")
CITY_NAMES = ("city_SEE_CIE_{year}.csv",)
CITY_COLUMNS = ("省级", "地级", "city_level", "city_pop", "new_hosp_beds", "expanded_beds", "acc_delta", "gini_delta", "theil_delta", "MLD_delta", "p90_p10_delta", "p80_p20_delta")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, schema: str | None = None, line_breaks: bool = False) -> DataFrame:
    """A CSV file with a header and, perhaps, a byte order mark. Without a schema all columns are text.

    Large files are read by several tasks, so a row is a line. line_breaks: quoted values may hold line breaks, and each
    file is read by one task; for tables with free text, such as facilities'.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def yearly_path(spark: SparkSession, folder: str, year: int | str, names: Iterable[str] = GRID_NAMES) -> str | None:
    """The first of a year's candidates that exists."""
    return next((p for n in names if exists(spark, p := f"{folder.rstrip('/')}/{n.format(year=year)}")), None)


def load_year(spark: SparkSession, folder: str, year: int, schema: str | None = None) -> DataFrame:
    """A year's grid file with its year; FileNotFoundError if there is none."""
    path = yearly_path(spark, folder, year)
    if path is None:
        raise FileNotFoundError(f"no grid file for {year} in {folder}")
    return csv(spark, path, schema).withColumn("year", F.lit(int(year)))


def load_years(spark: SparkSession, folder: str, years: Iterable[int | str], schema: str | None = None, need: str | None = None, names: Iterable[str] = GRID_NAMES) -> DataFrame | None:
    """All years that have a file (and the column `need`) in one frame; None if no year has."""
    frames = []
    for year in years:
        path = yearly_path(spark, folder, year, names)
        if path is not None:
            df = csv(spark, path, schema).withColumn("year", F.lit(int(year)))
            if need is None or need in df.columns:
                frames.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def load_cities(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """Yearly city tables from first to last, the panel's columns only; FileNotFoundError if no year has one."""
    found = load_years(spark, folder, range(first, last + 1), names=CITY_NAMES)
    if found is None:
        raise FileNotFoundError(f"no yearly city tables in {folder}")
    text = CITY_COLUMNS[:3]
    return found.select("year", *(F.col(f"`{c}`") if c in text else F.col(c).try_cast("double").alias(c) for c in CITY_COLUMNS))


def load_stats(spark: SparkSession, path: str, values: Iterable[str], year: str = "Year") -> DataFrame:
    """The year column and the named values of a statistics table, and nothing else of it."""
    return csv(spark, path).select(year, *(F.col(f"`{v}`").try_cast("double").alias(v) for v in values))


def load_excel(spark: SparkSession, path: str) -> DataFrame:
    """A small spreadsheet through pandas; needs openpyxl, else give the table as CSV or Parquet."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))
