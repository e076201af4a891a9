import math

import golden
import numpy as np
import pytest
from pyspark.sql import functions as F

from equireach.functions import clean, distributions, geo, text
from equireach.operators import catchment, decomposition, facilities, panel, regression, spatial
from equireach.sources import geojson, providers, sinks, yearly


def test_decay_and_thresholds(spark):
    df = spark.createDataFrame([(0.0, "Level3A"), (30.0, "Level3"), (60.0, "Level3"), (61.0, "Level3"), (None, "Level2"), (10.0, "x")], "t double, g string")
    got = [r[0] for r in df.select(catchment.gaussian_decay(F.col("t"), catchment.grade_threshold(F.col("g")))).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(0.70137, abs=1e-5) and got[2] == pytest.approx(0) and got[3] == 0 and got[4] == 0 and 0 < got[5] < 1


def test_catchment_conserves_beds(spark):
    fac = spark.createDataFrame([(1, "Level3", "10"), (2, "Level3", None), (3, "Level3", "-4"), (4, "Level3", "x"), (5, "Level1", "7"), (6, "Level3", "1")], "hospital_id long, grade string, beds string")
    grd = spark.createDataFrame([(1, 5000.0), (2, 20000.0), (3, 0.0), (4, -1.0)], "grid_id long, pop double")
    od = spark.createDataFrame([(h, g, 10.0 * (h % 5) + g) for h in (1, 2, 3, 4, 5) for g in (1, 2, 3)] + [(6, 1, None)], "hospital_id long, grid_id long, minutes double")
    supplied, grids = catchment.two_step(fac, grd, od, level3_only=False)
    status = {r["hospital_id"]: r["status"] for r in supplied.collect()}
    assert status[3].endswith("NEGATIVE") and status[6] == "NO_VALID_PATHS" and status[1] == "SUCCESS"
    total = grids.where("pop > 0").agg(F.sum(F.col("pop") * F.col("acc"))).first()[0]
    beds = supplied.where("status = 'SUCCESS'").agg(F.sum("beds")).first()[0]
    assert total == pytest.approx(catchment.SCALE * beds)
    row = {r["grid_id"]: r for r in grids.collect()}
    assert row[4]["acc"] == 0 and row[4]["nearest_L3_time"] == -1.0 and row[3]["acc"] > 0 and row[1]["nearest_L1_time"] == 1.0
    only = catchment.two_step(fac, grd, od)[1]
    assert "nearest_L1_time" not in only.columns
    nowhere = catchment.two_step(fac.where("grade = 'Level1'"), grd, od)[1]
    assert {r["acc"] for r in nowhere.collect()} == {0.0}


def test_ratio_limits(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (101.0,), (float("inf"),), (float("nan"),), (3.0,)], "r double")
    got = [r[0] for r in df.select(catchment.ratio_status(F.col("r"))).collect()]
    assert [g and g.rsplit("_", 1)[1] for g in got] == ["NONE", "NEGATIVE", "ZERO", "LARGE", "LARGE", "INVALID", None]


def test_jitter_takes_the_first_try():
    moves = catchment.jitter_offsets()
    assert len(set(moves)) == 25 and moves[0][1:] == (0.0, 0.0, 0.0, 0.0) and moves[1][1:3] == (0.0, 0.0)


def test_providers(spark):
    pairs = spark.createDataFrame([("a", 1, 120.0, 30.0, 2, 120.1, 30.0), ("a", 3, 0.0, 0.0, 4, 1.0, 1.0)], "region string, origin_id long, origin_lng double, origin_lat double, dest_id long, dest_lng double, dest_lat double")

    def ask(a, b, c, d):
        if a == 0.0:
            raise OSError("no path")
        return None if a == 120.0 or a < 100 else 7.0

    got = {r["origin_id"]: r["minutes"] for r in providers.ServiceTimes(ask).minutes(pairs).collect()}
    assert got == {1: 7.0, 3: None}
    km = providers.DistanceTimes(60).minutes(pairs).where("origin_id = 1").first()["minutes"]
    assert km == pytest.approx(9.63, abs=0.05)
    table = providers.TableTimes(spark.createDataFrame([("a", 1, 2, 5.0)], "region string, origin_id long, dest_id long, minutes double"))
    assert {r["minutes"] for r in table.minutes(pairs).collect()} == {5.0, None}
    places = spark.createDataFrame([("x",), (None,)], "addr string")
    got = providers.geocode(places, lambda a: (1.0, 2.0, 3, 4) if a == "x" else None).collect()
    assert got[0]["lng_bd08"] == 1.0 and got[1]["confidence"] is None


def test_coordinates_go_there_and_back(spark):
    points = [(116.4 + i, 39.9 - i) for i in range(0, 12)] + [(0.0, 0.0), (73.66, 30.0), (None, 1.0)]
    df = spark.createDataFrame(points, "lng double, lat double").withColumn("g", geo.wgs84_to_gcj02(F.col("lng"), F.col("lat"))).withColumn("w", geo.gcj02_to_wgs84(F.col("g.lng"), F.col("g.lat")))
    for r in df.collect():
        if r["lng"] is not None:
            assert r["w"]["lng"] == pytest.approx(r["lng"], abs=2e-6) and r["w"]["lat"] == pytest.approx(r["lat"], abs=2e-6) and r["w"]["converged"]
            assert r["g"]["lng"] == pytest.approx(geo.transform_point(r["lng"], r["lat"])[0], abs=1e-12)
        else:
            assert r["w"]["lng"] is None


def test_years_in_text(spark):
    given = {"1998年5月": 1998, "2001": 2001, "2003.0": 2003, "2005/1": 2005, "2007-03": 2007, "2010-05年": 2010, " 1999 ": 1999, "-1": -1, "98年": -1, "abc": -1, "": -1, "20101": -1}
    df = spark.createDataFrame([*given.items(), (None, -1)], "t string, y int")
    assert df.where(text.format_time(F.col("t")) != F.col("y")).count() == 0


def test_stars(spark):
    df = spark.createDataFrame([("-0.1234***",), ("0.5",), ("",), ("***",)], "s string")
    got = df.select(text.coefficient_of(F.col("s")), text.stars_of(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(-0.1234, "***"), (0.5, ""), (None, ""), (None, "***")]


def test_facilities(spark):
    base = spark.createDataFrame([("a", "1999", 1, "r1"), ("a", "2000", 2, "r2"), (None, "2001", 3, "r3")], "name string, construction_time string, `2014` int, addr_x string")
    sup = spark.createDataFrame([("a", 9), (None, 8), ("z", 7)], "name string, `2014` int")
    merged = facilities.merge_metadata(base, sup)
    assert merged.count() == 4 and merged.where("name IS NULL").first()["addr"] == "r3" and "2014_base" in merged.columns
    _, review, complete = facilities.clean_construction_years(base.withColumn("2015", F.lit(-1)))
    assert review.count() == 3 and complete.count() == 0
    wide = spark.createDataFrame([("a", 2015, None, 5.0, -1.0, 3.0), ("b", -1, 2016.0, 5.0, 5.0, 0.0)], "name string, construction_time int, `3A_year` double, `2014` double, `2015` double, `2016` double")
    got = {(r["name"], r["year"]) for r in facilities.assign_to_years(wide).collect()}
    assert got == {("a", 2016)}
    assert facilities.with_key(sup.withColumn("hospital_id", F.lit(1)), order=["name"]).select("hospital_id").distinct().count() == 3
    keyed = facilities.surrogate_key(sup, "k", ())
    assert sorted(r["k"] for r in keyed.collect()) == [0, 1, 2]
    assert facilities.deterministic_sample(spark.range(100), "id", 0.05).count() == 5 and facilities.deterministic_sample(spark.range(3), "id", 0.05).count() == 3


def test_points_in_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    regions = spark.createDataFrame([("r", [ring, hole])], "name string, rings array<array<struct<lng: double, lat: double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 5.0), (4, None, 1.0), (5, 3.9, 3.9)], "id int, lng double, lat double")
    assert {r["id"] for r in spatial.clip(points, regions).collect()} == {1, 5}


def test_geojson(spark, tmp_path):
    square = "[[[0,0],[2,0],[2,2],[0,2],[0,0]]]"
    (tmp_path / "b.json").write_text(f'{{"type":"FeatureCollection","features":[{{"properties":{{"name":"r"}},"geometry":{{"type":"Polygon","coordinates":{square}}}}}, {{"properties":{{"sum":"x"}},"geometry":{{"type":"MultiPolygon","coordinates":[{square}]}}}}]}}')
    (tmp_path / "g.json").write_text(f'{{"features":[{{"properties":{{"grid_id":"g7","sum":3.5}},"geometry":{{"type":"Polygon","coordinates":{square}}}}},{{"properties":{{"sum":"x"}},"geometry":{{"type":"Point","coordinates":[5,6]}}}}]}}')
    b = geojson.boundaries(spark, str(tmp_path / "b.json")).collect()
    assert [len(r["rings"]) for r in b] == [1, 1] and b[0]["rings"][0][1]["lng"] == 2.0
    g = [tuple(r)[:4] for r in geojson.grid(spark, str(tmp_path / "g.json")).collect()]
    assert g == [("g7", 1.0, 1.0, 3.5), ("1", 5.0, 6.0, 0.0)]


def test_yearly_files(spark, tmp_path):
    (tmp_path / "national_2014.csv").write_text("﻿acc,pop,省级\n1,2,a\n", encoding="utf-8")
    (tmp_path / "national_2014_sample.csv").write_text("acc,pop\n9,9\n")
    (tmp_path / "national_2015_sample.csv").write_text("acc,pop\n3,4\n")
    d = str(tmp_path)
    assert yearly.load_year(spark, d, 2014).first()["acc"] == "1"
    with pytest.raises(FileNotFoundError):
        yearly.load_year(spark, d, 2016)
    assert yearly.load_years(spark, d, ["2014", 2015, 2016]).count() == 2 and yearly.load_years(spark, d, [2014, 2015], need="省级").count() == 1
    assert yearly.load_years(spark, d, [2020]) is None
    with pytest.raises(FileNotFoundError):
        yearly.load_cities(spark, d, 2014, 2015)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2014, 1), (2015, 2)], "year int, v int")
    sinks.write_by(df, str(tmp_path / "y"), ["year"])
    assert {p.name for p in (tmp_path / "y").iterdir() if p.is_dir()} == {"year=2014", "year=2015"}
    out = sinks.stage(df, str(tmp_path / "s"))
    assert sinks.stage(df.limit(0), str(tmp_path / "s")).count() == out.count() == 2
    assert sinks.pending(df.select("v"), spark, str(tmp_path / "s"), "v").count() == 0 and sinks.pending(df, spark, str(tmp_path / "none")).count() == 2


def test_golden_decomposition(spark, tmp_path):
    golden.write(tmp_path)
    got = decomposition.run_tasks(spark, golden.TASKS, lambda p: yearly.csv(spark, str(tmp_path / p))).collect()
    want = yearly.csv(spark, str(tmp_path / "results.csv")).collect()
    found = {(r["task"], r["indicator"], r["factor"]): r for r in got}
    assert len(found) == len(want) == 20
    for r in want:
        mine = found[r["task"], r["indicator"], r["factor"]]
        assert mine["Contribution_abs"] == pytest.approx(float(r["Contribution_abs"]), rel=1e-11) and mine["Contribution_pct"] == pytest.approx(float(r["Contribution_pct"]), rel=1e-11)


def test_decomposition_needs_all_scenarios(spark):
    df = spark.createDataFrame([("2014", 1.0), ("2024", 2.0)], "Year string, v double")
    with pytest.raises(ValueError, match="A001"):
        decomposition.scenario_values(df, df, ["v"])
    rows = spark.createDataFrame([("2014", 1.0), *((label, 1.0 + i) for i, label in enumerate(decomposition.SCENARIOS)), ("2024", 9.0)], "Year string, v double")
    values = decomposition.scenario_values(rows, rows, ["v"])
    r = decomposition.contributions(values, "shapley").first()
    assert r["Road"] + r["Population"] + r["Bed"] == pytest.approx(8.0)
    bars = {b["factor"]: b for b in decomposition.waterfall(decomposition.contribution_rows(decomposition.contributions(values), "t")).collect()}
    assert bars["Road"]["end"] == pytest.approx(9.0) and bars["2024"]["start"] == 0


def _yearly(spark):
    rows = [("p", "c", "Type I Large City", 2.0, 4.0, None, 1.0), ("p", "c", "Type II Large City", 4.0, 2.0, None, None), ("p", None, "Small City", 1.0, 1.0, 1.0, 1.0), ("q", "北京市", "Super City", 0.0, 1.0, 1.0, 1.0), ("q", "d", "Small City", 10.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "`省级` string, `地级` string, city_level string, city_pop double, new_hosp_beds double, expanded_beds double, acc_delta double")
    return df.withColumns({c: F.lit(0.5) for c in panel.SUMMED[3:]})


def test_panel(spark):
    keys = [("c", 2014, 10.0), ("c", 2023, 15.0)]
    gdp = spark.createDataFrame(keys, "`城市` string, year int, GDP_per double")
    flow = spark.createDataFrame([("c", 2015, 1.0, 10.0, None), ("c", 2016, 3.0, 10.0, 8.0)], "`城市` string, `年份` int, `人口净流入(万人)` double, `户籍人口数(万人)` double, `常住人口数(万人)` double")
    density = spark.createDataFrame([("c", 2014, 1.0), ("c", 2020, 3.0), ("c", 2030, 99.0)], "`城市` string, `年份` int, `人口密度(人／平方公里)` double")
    columns = ", ".join(f"{c} double" for c in panel.BASELINES)

    def table(name, rows):
        return spark.createDataFrame([(2014, k, *[v] * 6) for k, v in rows], f"Year int, `{name}` string, {columns}")

    out = panel.regression_panel(_yearly(spark), gdp, flow, density, table("省级", [("北京市", 5.0), ("d", 99.0)]), table("地级", [("c", 1.0)]), table("县级", [("d", 3.0), ("d", 4.0)]))
    got = {r["地级"]: r for r in out.collect()}
    assert set(got) == {"c", "北京市", "d"}
    c = got["c"]
    assert c["city_level"] == "Large City" and c["city_pop"] == 3.0 and c["expanded_beds"] == 0.0 and c["city_SEE"] == 20000 and c["Dominance"] == 20000
    assert c["GDP_growth_pct"] == 0.5 and c["Ppo_NetIn"] == 2.0 and c["Ppo_NetIn_rate"] == 0.2 and c["ResPop_2014"] is None and c["pop_density_mean"] == 2.0
    assert got["北京市"]["acc_2014"] == 5.0 and got["北京市"]["city_SEE"] is None and got["d"]["acc_2014"] == 3.0 and c["acc_2014"] == 1.0
    with pytest.raises(panel.DuplicateKey):
        panel.pivot_growth(gdp.unionAll(gdp), "城市", "year", "GDP_per")


def test_distributions():
    assert distributions.normal_p(1.959963984540054) == pytest.approx(0.05) and distributions.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert distributions.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8) and distributions.t_quantile(0.025, 3) == pytest.approx(-3.182446305, abs=1e-8)


def _model_frame(spark, n=240, empty=None):
    random = np.random.default_rng(3)
    names = [*regression.SCALED[:2], *regression.SCALED[3:], *regression.OUTCOMES]
    levels = [x for x in regression.LEVELS if x != empty]
    rows = [(levels[i % len(levels)], *map(float, random.normal(size=len(names)))) for i in range(n)]
    return spark.createDataFrame(rows, "city_level string, " + ", ".join(f"{x} double" for x in names))


def test_hc1_against_numpy(spark):
    df = regression.load_city_panel(_model_frame(spark))
    terms = regression.design(["acc_2014"], "city_level_4", interacted=("city_SEE",))
    fit = regression.ols_hc1(df, "acc_delta", terms)
    d = df.toPandas()
    dummies = [(d["city_level_4"] == x).astype(float) for x in regression.LEVELS if x != regression.REFERENCE]
    x = np.column_stack([np.ones(len(d)), d["acc_2014"], *dummies, d["city_SEE"], *(d["city_SEE"] * z for z in dummies)])
    y = d["acc_delta"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    inv, e = np.linalg.inv(x.T @ x), y - x @ beta
    cov = len(y) / (len(y) - x.shape[1]) * inv @ (x.T * e**2) @ x @ inv
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov) and fit.df_resid == len(y) - x.shape[1]
    effect, p = regression.total_effect(fit, "city_SEE", "Large City")
    assert effect == pytest.approx(beta[5] + beta[8]) and 0 <= p <= 1
    assert regression.total_effect(fit, "city_CIE", "Large City") == (None, None) and regression.total_effect(fit, "city_SEE", "none")[1] is None
    low, high = regression.marginal_effects(fit, ("city_SEE",))[0][4:6]
    assert low < high
    with pytest.raises(KeyError):
        fit.combined({"nothing": 1.0})


def test_models_with_an_empty_level(spark):
    df = regression.prepared(regression.load_city_panel(_model_frame(spark, 120, "Megacity")))
    fit = regression.ols_hc1(df, "acc_delta", regression.design(["acc_2014"], "city_level_4"))
    assert fit.rank == 4 and len(fit.terms) == 5 and np.isfinite(fit.beta).all()
    m = df.agg(F.avg("city_SEE"), F.stddev_samp("city_SEE")).first()
    assert m[0] == pytest.approx(0, abs=1e-9) and m[1] == pytest.approx(1)
    flat = regression.zscore(spark.createDataFrame([(1.0,), (1.0,)], "a double"), ["a", "b"])
    assert [r["a"] for r in flat.collect()] == [1.0, 1.0]


def test_vif(spark):
    d = _model_frame(spark)
    names = ["acc_2014", "GDP_2014", "city_SEE"]
    got = {r["variable"]: r["VIF"] for r in regression.vif(d, [*names, "absent"]).collect()}
    x = d.select(names).toPandas().to_numpy()
    for i, n in enumerate(names):
        other = np.column_stack([np.ones(len(x)), np.delete(x, i, 1)])
        rest = x[:, i] - other @ np.linalg.lstsq(other, x[:, i], rcond=None)[0]
        assert got[n] == pytest.approx(((x[:, i] - x[:, i].mean()) ** 2).sum() / (rest**2).sum())


def test_clean(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "s string")
    assert [r[0] for r in df.select(clean.to_double(F.col("s"))).collect()] == [1.5, None, None, None, None]
    with pytest.raises(ValueError, match="rule"):
        clean.valid_rows(df, "s", "s", "s", "other")
    assert math.isclose(geo.X_PI, math.pi * 3000 / 180)
