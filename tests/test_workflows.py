import json

import golden
import numpy as np
import pytest

from equireach import cli
from equireach.operators import regression
from equireach.operators.concentration import AnalysisSpec
from equireach.plans import workflows
from equireach.sources import providers, yearly


@pytest.fixture
def grid_files(tmp_path):
    r = np.random.default_rng(0)
    for y in (2014, 2015):
        lines = ["acc,pop,GDP_per,省级,地级,县级码"] + [f"{a:.3f},{p},{g},p{i % 2},c{i % 4},{i % 8}" for i, (a, p, g) in enumerate(zip(r.random(60), r.integers(0, 5, 60), r.integers(1, 9, 60), strict=True))]
        (tmp_path / f"national_{y}.csv").write_text("\n".join(lines), encoding="utf-8-sig")
    return tmp_path


def test_stats_and_concentration(spark, grid_files):
    cli.main(["stats", "--input", str(grid_files), "--output", str(grid_files / "stats"), "--years", "2014-2016"])
    got = {n: yearly.csv(spark, str(grid_files / "stats" / n)) for n in workflows.LEVELS}
    assert [got[n].count() for n in workflows.LEVELS] == [2, 4, 8, 16] and "pop_gini" in got["city"].columns
    made = workflows.concentration_analysis(spark, str(grid_files), str(grid_files / "ci"), [2014, 2015, 2016], AnalysisSpec("gdp", "GDP_per"))
    rows = {r["year"]: r["ci"] for r in yearly.csv(spark, str(grid_files / "ci/gdp/ci")).collect()}
    assert set(rows) == {"2014", "2015", "2016"} and rows["2016"] is None and set(made) == {"ci", "trend", "curve", "density"}
    with pytest.raises(FileNotFoundError):
        workflows.concentration_analysis(spark, str(grid_files), "x", [1999], AnalysisSpec("gdp", "GDP_per"))


def test_models(spark, tmp_path):
    r = np.random.default_rng(1)
    names = [c for c in regression.SCALED if c != "city_TotalExpansion"] + [y for y in regression.OUTCOMES]
    lines = ["地级,city_level," + ",".join(names)] + [f"c{i},{regression.LEVELS[i % 4]}," + ",".join(f"{x:.5f}" for x in r.normal(size=len(names))) for i in range(200)]
    (tmp_path / "panel.csv").write_text("\n".join(lines), encoding="utf-8")
    fits = workflows.expansion_models(spark, str(tmp_path / "panel.csv"), str(tmp_path / "out"))
    assert len(fits) == 21
    effects = yearly.csv(spark, str(tmp_path / "out/see_total_effects")).collect()
    assert {e["City size"] for e in effects} == set(regression.LEVELS) and all(e["gini"] for e in effects)
    assert yearly.csv(spark, str(tmp_path / "out/marginal_effects")).count() == 8
    text = next((tmp_path / "out/models").glob("part*")).read_text()
    assert len(text.split("R2=")) == 22 and text.count("city_SEE:level[Megacity]") > 4
    one = regression.ols_hc1(regression.prepared(regression.load_city_panel(spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "panel.csv")))), *regression.model_designs(names)["gini_delta_see_cie_3"])
    many = fits["gini_delta_see_cie_3"]
    assert many.terms == one.terms and many.n == one.n == 200 and np.allclose(many.beta, one.beta) and np.allclose(many.cov, one.cov) and many.r2 == pytest.approx(one.r2)
    again = {(r["variable"], r["level"]): r for r in workflows.stored_effects(spark, str(tmp_path / "out")).collect()}
    for r in regression.marginal_effects(fits["acc_delta_3"]):
        assert tuple(again[r[0], r[1]])[2:] == pytest.approx(r[2:], rel=1e-6)


def test_decompose(spark, tmp_path):
    golden.write(tmp_path)
    rows = workflows.decompose(spark, str(tmp_path / "tasks.json"), str(tmp_path), str(tmp_path / "out"))
    assert rows.count() == 20 and (tmp_path / "out/by_indicator/task=accessibility/indicator=pop_median").is_dir()


def test_accessibility_dataset(spark, tmp_path):
    def square(w, s, e, n):
        return [[[w, s], [e, s], [e, n], [w, n], [w, s]]]

    def features(items):
        return json.dumps({"features": [{"properties": p, "geometry": {"type": "Polygon", "coordinates": c}} for p, c in items]})

    (tmp_path / "b.json").write_text(features([({"name": "a"}, square(0, 0, 1, 1)), ({"name": "b"}, square(5, 5, 6, 6))]))
    (tmp_path / "ga.json").write_text(features([({"sum": 1000}, square(0, 0, 0.2, 0.2)), ({"sum": 0}, square(0.2, 0.2, 0.4, 0.4))]))
    (tmp_path / "gb.json").write_text(features([({"sum": 10}, square(5, 5, 5.2, 5.2))]))
    (tmp_path / "h.csv").write_text("lng,lat,beds,grade\n0.1,0.2,5,Level3A\n0.5,0.5,,Level2\n9,9,1,Level3\n")
    grids = {"a": str(tmp_path / "ga.json"), "b": str(tmp_path / "gb.json")}
    out = workflows.accessibility_dataset(spark, str(tmp_path / "b.json"), grids, str(tmp_path / "h.csv"), providers.DistanceTimes(60), str(tmp_path / "out"))
    got = {(r["region"], r["grid_id"]): r for r in out.collect()}
    assert got["a", "0"]["acc"] > 0 and got["a", "1"]["acc"] > 0 and got["b", "0"]["acc"] == 0 and got["b", "0"]["nearest_L3_time"] == -1
    assert got["a", "0"]["acc"] * 1000 == pytest.approx(50_000) and got["a", "0"]["crs"] == "EPSG:4326"
    again = workflows.accessibility_dataset(spark, str(tmp_path / "b.json"), grids, str(tmp_path / "h.csv"), providers.DistanceTimes(60), str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values())) and again.schema == out.schema
    (tmp_path / "bad.csv").write_text("lng,lat\n1,1\n")
    with pytest.raises(ValueError, match="beds"):
        workflows.accessibility_dataset(spark, str(tmp_path / "b.json"), grids, str(tmp_path / "bad.csv"), providers.DistanceTimes(), str(tmp_path / "o2"))


def stored(folder):
    return {p.parent.name: p.read_bytes() for p in folder.glob("region=*/part*")}


def test_accessibility_dataset_goes_on(spark, tmp_path):
    def square(w, s):
        return {"type": "Polygon", "coordinates": [[[w, s], [w + 1, s], [w + 1, s + 1], [w, s + 1], [w, s]]]}

    def collection(items):
        lines = [json.dumps({"type": "Feature", "properties": p, "geometry": g}) for p, g in items]
        return '{"type": "FeatureCollection",\n"features": [\n' + ",\n".join(lines) + "\n]}\n"

    def run(names, out="out", **kw):
        return workflows.accessibility_dataset(spark, str(tmp_path / "bounds.json"), {n: str(tmp_path / f"{n}.json") for n in names}, str(tmp_path / "h.csv"), providers.DistanceTimes(60), str(tmp_path / out), **kw)

    (tmp_path / "bounds.json").write_text(collection([({"name": n}, square(i, 0)) for i, n in enumerate("abc")]))
    for i, n in enumerate("ab"):
        (tmp_path / f"{n}.json").write_text(collection([({"sum": 1000 * (k + 1)}, {"type": "Point", "coordinates": [i + 0.1 * (k + 1), 0.5]}) for k in range(3)]))
    (tmp_path / "h.csv").write_text("lng,lat,beds,grade\n0.15,0.5,5,Level3A\n1.2,0.5,8,Level3\n")
    run("a")
    first = stored(tmp_path / "out")
    out = run("ab")
    both = stored(tmp_path / "out")
    assert set(first) == {"region=a"} and {k: both[k] for k in first} == first
    got = {(r["region"], r["grid_id"]): r["acc"] for r in out.collect()}
    assert len(got) == 6 and all(x > 0 for x in got.values())
    for n, beds in (("a", 5), ("b", 8)):  # supplied beds come back, weighed by population
        assert sum(got[n, str(k)] * 1000 * (k + 1) for k in range(3)) == pytest.approx(beds * 10_000)
    # other inputs: what is stored stays, a new output has its own ratios
    (tmp_path / "h.csv").write_text("lng,lat,beds,grade\n0.15,0.5,50,Level3A\n1.2,0.5,8,Level3\n")
    run("ab")
    assert stored(tmp_path / "out") == both
    (tmp_path / "out2.s1").symlink_to(tmp_path / "out.s1")
    fresh = {(r["region"], r["grid_id"]): r["acc"] for r in run("ab", "out2").collect()}
    assert all(fresh["a", str(k)] == pytest.approx(10 * got["a", str(k)]) and fresh["b", str(k)] == pytest.approx(got["b", str(k)]) for k in range(3))
    # a region that fails leaves the others alone; within reach the result is the same
    assert {r["region"] for r in run("abc", "out3").select("region").distinct().collect()} == {"a", "b"}
    near = {(r["region"], r["grid_id"]): r["acc"] for r in run("ab", "out4", reach_km=70.0).collect()}
    assert near == pytest.approx(fresh)


def test_facility_commands(spark, tmp_path):
    (tmp_path / "h.csv").write_text("name,construction_time,2014,2015,lng_bd08,lat_bd08\na,1999年,5,-1,116.4,39.9\nb,x,5,6,,\n", encoding="utf-8")
    cli.main(["clean-years", "--input", str(tmp_path / "h.csv"), "--output", str(tmp_path / "c")])
    assert yearly.csv(spark, str(tmp_path / "c/review")).count() == 2
    cli.main(["convert", "--input", str(tmp_path / "h.csv"), "--output", str(tmp_path / "w")])
    got = {r["name"]: r for r in yearly.csv(spark, str(tmp_path / "w")).collect()}
    assert 116.3 < float(got["a"]["lng"]) < 116.4 and got["b"]["lng"] is None
    cli.main(["assign-years", "--input", str(tmp_path / "c/all"), "--output", str(tmp_path / "y")])
    assert (tmp_path / "y/year=2014").is_dir()
