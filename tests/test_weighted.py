import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equireach.operators import concentration, weighted


def stats(spark, rows, keys=(), **kw):
    return weighted.weighted_stats(spark.createDataFrame(rows, "k string, acc double, pop double"), keys=list(keys), **kw)


def twin(x, w):
    """The same statistics in numpy, row by row."""
    order = np.lexsort((w, x))
    x, w = np.array(x, float)[order], np.array(w, float)[order]
    cw, total = np.cumsum(w), w.sum()
    mean = (x * w).sum() / total
    out = {"pop_mean": mean, **{n: np.interp(q * total, cw, x) for n, q in (("pop_25%", 0.25), ("pop_median", 0.5), ("pop_75%", 0.75))}}
    out["pop_gini"] = 1 - 2 * (np.cumsum(x * w) * w).sum() / ((x * w).sum() * total) if (x * w).sum() > 0 else None
    rest = total - (w * w).sum() / total
    out["pop_std"] = math.sqrt((w * (x - mean) ** 2).sum() / rest) if rest > 1e-9 else None
    p = x > 0
    if p.any():
        a, b = x[p], w[p]
        m = (a * b).sum() / b.sum()
        out["pop_theil"], out["pop_MLD"] = (b * a / m * np.log(a / m)).sum() / b.sum(), (b * np.log(m / a)).sum() / b.sum()
        share = np.cumsum(b) / b.sum()
        out["p90_p10"] = a[np.searchsorted(share, 0.9)] / a[np.searchsorted(share, 0.1)]
    return out


def test_worked_values(spark):
    r = stats(spark, [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 4.0, 3.0)]).first()
    assert r["pop_gini"] == pytest.approx(1 - 124 / 102) and r["pop_std"] ** 2 == pytest.approx(2.409091, abs=1e-6)
    assert r["pop_25%"] == pytest.approx(1.25) and r["p90_p10"] == pytest.approx(4.0) and r["pop_num"] == 6 and r["grid_num"] == 3


def test_invalid_rows_and_groups(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 1.0), ("a", nan, 1.0), ("a", inf, 1.0), ("a", None, 1.0), ("a", 5.0, 0.0), ("a", 5.0, -1.0), ("b", None, 2.0), (None, 1.0, 1.0)]
    got = {r["k"]: r for r in stats(spark, rows, ["k"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["grid_num"] == 1 and got["a"]["pop_std"] is None and got["a"]["pop_median"] == 1.0
    assert got["b"]["grid_num"] == 0 and got["b"]["pop_num"] == 0 and got["b"]["pop_gini"] is None and got["b"]["min"] is None


def test_empty_and_equal(spark):
    r = stats(spark, []).first()
    assert r["grid_num"] == 0 and r["pop_mean"] is None
    r = stats(spark, [("a", 3.0, 1.0)] * 4).first()
    assert r["pop_gini"] == pytest.approx(1 - 2 * (1 + 2 + 3 + 4) / 16) and r["pop_theil"] == pytest.approx(0, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 4)), min_size=2, max_size=40), st.sampled_from([1, 3]))
def test_against_numpy(spark, rows, buckets):
    got = stats(spark, [("a", float(x), float(w)) for x, w in rows], buckets=buckets).first()
    for name, value in twin(*zip(*rows, strict=True)).items():
        assert (got[name] is None) if value is None else got[name] == pytest.approx(value, abs=1e-9), name


def ci_twin(r, y, w):
    order = np.lexsort((w, y, r))
    y, w = np.array(y, float)[order], np.array(w, float)[order]
    mean = (w * y).sum() / w.sum()
    rank = (np.cumsum(w) - 0.5 * w) / w.sum()
    return 2 * (w * (y - mean) * (rank - 0.5)).sum() / w.sum() / mean


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(1, 5), st.integers(1, 4)), min_size=2, max_size=30))
def test_concentration_index(spark, rows):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "gdp double, acc double, pop double")
    got = concentration.concentration_index(df, "gdp", "acc", "pop", buckets=2).first()["ci"]
    assert got == pytest.approx(ci_twin(*zip(*rows, strict=True)), abs=1e-9)


def test_index_edges(spark):
    df = spark.createDataFrame([(2020, 1.0, 2.0, 1.0), (2021, 1.0, 2.0, 1.0), (2021, 2.0, 2.0, 3.0), (2021, 0.0, 9.0, 1.0), (2022, None, 1.0, 1.0)], "year int, gdp double, acc double, pop double")
    got = {r["year"]: r["ci"] for r in concentration.ci_series(df, [2020, 2021, 2022, 2023], concentration.AnalysisSpec("x", "gdp")).collect()}
    assert got[2021] == pytest.approx(0) and got[2020] is None and got[2022] is None and got[2023] is None
    assert concentration.concentration_index(df, "missing", "acc", "pop").first()["ci"] is None
    curve = concentration.concentration_curve(df, "gdp", "acc", "pop", ["year"]).where("year = 2021").orderBy("cum_pop").collect()
    assert [round(r["cum_pop"], 6) for r in curve] == [0.25, 1.0]
