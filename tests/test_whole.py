"""The catalogue's queries over whole tables, against SQL or a fixture."""

import duckdb
import pytest

from equireach.functions import geo
from equireach.plans import catalogue

SF = "/root/testdata/sf0.001"


def both(spark, name):
    """(rows of the query, rows of its SQL), sorted, columns by name."""
    with duckdb.connect() as db:
        for t in ("supplier", "customer", "nation", "orders"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = db.sql(catalogue.ORACLE_SQL[name])
        columns = sorted(found.columns)
        want = found.select(*(f'"{c}"' for c in columns)).fetchall()
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=repr), sorted(want, key=repr)


def test_metadata_join_takes_every_customer(spark):
    got, want = both(spark, "metadata_left_join_nullsafe")
    assert got == want
    met = {r["2014_base"] for r in catalogue.metadata_left_join_nullsafe(spark, SF).collect()}
    assert {101, 109} <= met


def test_inverse_takes_every_customer(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["c_custkey"]: r for r in catalogue.QUERIES["gcj02_to_wgs84"](spark, sf).collect()}
    points = {r["c_custkey"]: (r["lng"], r["lat"]) for r in catalogue._points(spark, sf).collect()}
    assert set(got) == set(points)

    def inside(p):
        return 73.66 < p[0] < 135.05 and 3.86 < p[1] < 53.55

    outside = edge = 0
    for k, p in points.items():
        image, back = geo.transform_point(*p), (got[k]["lng"], got[k]["lat"])
        if not inside(image):
            outside += not inside(p)
            assert got[k]["converged"] and back == pytest.approx(image, abs=1e-6)
        elif inside(p):
            edge += not (74 <= p[0] <= 134 and 4.5 <= p[1] <= 53)
            assert got[k]["converged"] and back == pytest.approx(p, abs=3e-6)
        elif got[k]["converged"] and inside(back):
            assert geo.transform_point(*back) == pytest.approx(image, abs=3e-6)
    assert outside > 100 and edge > 10


def test_fallback_finds_every_province(spark):
    got, want = both(spark, "fallback_join_muni")
    assert got == [tuple(float(x) if hasattr(x, "as_tuple") else x for x in r) for r in want]
    rows = [r for r in catalogue.fallback_join_muni(spark, SF).collect() if r["c_custkey"] % 3]
    assert {r["acc_2014"] for r in rows if r["city"] == "r11"} == {22.0} and {r["acc_2014"] for r in rows if r["city"] == "none"} == {None}


def test_union_takes_every_year(spark):
    got, want = both(spark, "union_years")
    assert got == want and len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()
