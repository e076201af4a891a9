import pytest
from pyspark.sql import functions as F

import __spark_entry__
from equireach.functions import text
from equireach.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLE_SQL) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["acc_stats_national", "ci_by_year", "concentration_curve", "s2_accessibility", "population_flow", "split_coef_star", "acc_stats_at_levels", "bd09_to_wgs84", "yearly_files", "grid_features", "marginal_effects", "model_set"])
def test_against_sql(spark, name):
    import duckdb

    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)

    def rows(df):
        return sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df[columns].itertuples(index=False))

    assert str(rows(got)) == str(rows(want)) or rows(got) == pytest.approx(rows(want))


def test_axis_label_against_sql(spark, tmp_path):
    """Halves, what is missing or infinite, and more digits than a double's shortest form has."""
    import duckdb

    prices = [5000.0, 15000.0, 25000.0, 35000.0, 105000.0, 365000.0, -5000.0, -25000.0, 24999.99, 25000.01, 0.0, -0.0, -1.0, None, float("nan"), float("inf"), float("-inf"), 1e20, 2.0**80, -(2.0**100) - 2.0**60, 1e27, 2.0**120, 1e38, -1e48]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(path)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
        want = dict(db.sql(catalogue.ORACLE_SQL["axis_label"]).fetchall())
    assert [want[k] for k in (0, 2, 5, 6, 13, 15)] == ["0", "2", "36", "-0", None, "inf"]
    assert {r.o_orderkey: r.label for r in catalogue.QUERIES["axis_label"](spark, str(tmp_path)).collect()} == want


def test_axis_label_has_every_digit(spark):
    """As Python prints whole doubles, of every size; DuckDB's printf does not beyond 2^150."""
    values = [x * 10000 for k in range(50, 1005, 5) for x in (2.0**k, -(2.0**k) * 1.1, 2.0**k * (2 - 2.0**-52))] + [9999999999999998.0, 1e22, 1.7976931348623157e308]
    df = spark.createDataFrame([(x, f"{x / 10000:.0f}") for x in values], "x double, label string")
    assert df.select(text.ten_thousands(F.col("x")).alias("got"), "label").where("NOT got <=> label").collect() == []
