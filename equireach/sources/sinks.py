"""Writing results: CSV, one folder a year, split files, geometry tables, stage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.sources.yearly import exists


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share for files in passing: spark.checkpoint.dir, else the warehouse."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (own or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def write_csv(df: DataFrame, path: str, single: bool = False, bom: bool = False) -> None:
    """A folder of CSV files with headers; single: one file, for small results, made by one task after the others have
    done their work. bom: the files begin with a byte order mark, as spreadsheet programs want it."""
    header = [("\ufeff" if bom and i == 0 else "") + c for i, c in enumerate(df.columns)]
    out = df.toDF(*header)
    if single:
        order = [F.col(f"`{c}`") for c in header]  # a shuffle to one task keeps no order
        out = out.withColumn("_at", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("_at").select(*order)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_by(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A folder for each value of columns, such as a year, or task and indicator; rewriting replaces only what df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*columns).csv(path)


def write_split(parts: dict[str, DataFrame], path: str) -> None:
    """Each part to a folder of its own."""
    for name, df in parts.items():
        write_csv(df, f"{path.rstrip('/')}/{name}")


def write_geometry(df: DataFrame, path: str, crs: str | None = None, by: Sequence[str] = ()) -> None:
    """Parquet with the coordinate system as a column, EPSG:4326 unless one is given; geometry stays text. by: a folder for
    each value of these columns; those that df lacks stay as they are."""
    out = df.withColumn("crs", F.lit(crs or "EPSG:4326")).write.mode("overwrite")
    (out.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else out).parquet(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read back, unless an earlier run left it complete; path must name the inputs."""
    spark: SparkSession = df.sparkSession
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pending(regions: DataFrame, spark: SparkSession, path: str, name: str = "region") -> DataFrame:
    """The regions that have no output at path yet."""
    if not exists(spark, path):
        return regions
    kind = regions.schema[name].dataType.simpleString()
    done = spark.read.schema(f"`{name}` {kind}").parquet(path).select(name).distinct()
    return regions.join(done, name, "left_anti")
