"""The queries over the driver's tables, and their SQL.

Tables play the parts of the domain: an order's price is the accessibility of a cell and its quantity the population,
customers are cells and suppliers facilities in the catchment, quantities between them the minutes. What the tables
cannot hold (free text, coordinates, polygons, scenarios) is derived from their keys by the same rule on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.functions import clean, geo, text
from equireach.operators import catchment, concentration, decomposition, facilities, panel, regression, spatial, weighted
from equireach.sources import geojson, sinks, yearly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS decimals; -0.0 is 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), DIGITS) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _r(x: str, name: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0 AS {name}"


# ---- weighted distribution statistics ------------------------------------------------------------------------------

_CELLS_SQL = """
    cells AS (
        SELECT o_orderkey, any_value(o_orderpriority) AS priority, any_value(o_custkey) AS custkey, CAST(year(any_value(o_orderdate)) AS INT) AS year,
               any_value(o_totalprice) AS acc, sum(l_quantity) AS pop
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
    )"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with line items: priority, custkey, year, acc, pop."""
    quantity = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("pop"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("acc"))
    return orders.join(quantity, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _stats_sql(source: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""

    def interpolated(q: float, name: str) -> str:
        t = f"{q} * tw"
        return f"round(arg_min(CASE WHEN prev IS NOT NULL AND {t} <= cw THEN prev + (acc - prev) * ({t} - (cw - pop)) / pop ELSE acc END, cw) FILTER (WHERE cw >= {t}), {DIGITS}) + 0.0 AS \"{name}\""

    def step(q: float) -> str:
        return f"min(acc) FILTER (WHERE acc > 0 AND cp / tp >= {q})"

    positive = "sum({}) FILTER (WHERE acc > 0)"
    xw, w = positive.format("acc * pop"), positive.format("pop")
    return f"""WITH {_CELLS_SQL}, src AS ({source}), run AS (
        SELECT *, sum(pop) OVER (ORDERED) AS cw, sum(acc * pop) OVER (ORDERED) AS cxw, sum(CASE WHEN acc > 0 THEN pop ELSE 0 END) OVER (ORDERED) AS cp,
               lag(acc) OVER ({part} ORDER BY acc, pop) AS prev, sum(pop) OVER ({part}) AS tw, sum(CASE WHEN acc > 0 THEN pop ELSE 0 END) OVER ({part}) AS tp,
               sum(acc * pop) OVER ({part}) / sum(pop) OVER ({part}) AS mu
        FROM src WHERE acc IS NOT NULL AND pop > 0)
        SELECT {lead}min(acc) AS min, max(acc) AS max, count(*) AS grid_num, CAST(trunc(sum(pop)) AS BIGINT) AS pop_num,
            {_r('sum(acc * pop) / sum(pop)', 'pop_mean')}, {interpolated(0.25, 'pop_25%')}, {interpolated(0.5, 'pop_median')}, {interpolated(0.75, 'pop_75%')},
            {_r('sqrt(sum(pop * (acc - mu) * (acc - mu)) / nullif(sum(pop) - sum(pop * pop) / sum(pop), 0))', 'pop_std')},
            {_r('1 - 2 * sum(cxw * pop) / (sum(acc * pop) * sum(pop))', 'pop_gini')},
            {_r(f"{positive.format('acc * pop * ln(acc)')} / {xw} - ln({xw} / {w})", 'pop_theil')},
            {_r(f"ln({xw} / {w}) - {positive.format('pop * ln(acc)')} / {w}", '"pop_MLD"')},
            {_r(f'{step(0.9)} / {step(0.1)}', 'p90_p10')}, {_r(f'{step(0.8)} / {step(0.2)}', 'p80_p20')}
        FROM run {group}""".replace("ORDERED", f"{part} ORDER BY acc, pop ROWS UNBOUNDED PRECEDING")


_SEGMENTS = "SELECT c_mktsegment, acc, pop FROM cells JOIN customer ON c_custkey = custkey"
_NATIONS = "SELECT n_name, acc, pop FROM cells JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey"


def _with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).join(_table(spark, sf_dir, "customer"), F.col("custkey") == F.col("c_custkey"))


@query(_stats_sql("SELECT priority, acc, pop FROM cells", "priority"))
def acc_stats_by_priority(spark, sf_dir):
    return _rounded(weighted.weighted_stats(cells(spark, sf_dir), keys=["priority"]))


@query(_stats_sql("SELECT acc, pop FROM cells"))
def acc_stats_national(spark, sf_dir):
    return _rounded(weighted.weighted_stats(cells(spark, sf_dir), buckets=8))


@query(_stats_sql("SELECT year, acc, pop FROM cells", "year"))
def acc_stats_by_year(spark, sf_dir):
    return _rounded(weighted.weighted_stats(cells(spark, sf_dir), keys=["year"], buckets=4))


@query(_stats_sql(_SEGMENTS, "c_mktsegment"))
def acc_stats_by_segment(spark, sf_dir):
    return _rounded(weighted.weighted_stats(_with_customer(spark, sf_dir), keys=["c_mktsegment"]))


@query(_stats_sql(_NATIONS, "n_name"))
def acc_stats_by_nation(spark, sf_dir):
    df = _with_customer(spark, sf_dir).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _rounded(weighted.weighted_stats(df, keys=["n_name"]))


_PLAIN = f"WITH {_CELLS_SQL}, run AS (SELECT priority, acc, pop, sum(pop) OVER w AS cw, sum(acc * pop) OVER w AS cxw, lag(acc) OVER (PARTITION BY priority ORDER BY acc, pop) AS prev, sum(pop) OVER (PARTITION BY priority) AS tw, sum(acc * pop) OVER (PARTITION BY priority) / sum(pop) OVER (PARTITION BY priority) AS mu FROM cells WHERE pop > 0 WINDOW w AS (PARTITION BY priority ORDER BY acc, pop ROWS UNBOUNDED PRECEDING))"


def _one_statistic(spark, sf_dir, **columns: Column) -> DataFrame:
    runs = weighted.sorted_runs(cells(spark, sf_dir), "acc", "pop", ["priority"])
    return _rounded(runs.groupBy("priority").agg(*(c.alias(n) for n, c in columns.items())))


@query(_PLAIN + f" SELECT priority, {', '.join(_r(f'arg_min(CASE WHEN prev IS NOT NULL AND {q / 100} * tw <= cw THEN prev + (acc - prev) * ({q / 100} * tw - (cw - pop)) / pop ELSE acc END, cw) FILTER (WHERE cw >= {q / 100} * tw)', f'p{q}') for q in (5, 50, 95))} FROM run GROUP BY priority")
def weighted_percentile_interp(spark, sf_dir):
    return _one_statistic(spark, sf_dir, p5=weighted.interpolated(5), p50=weighted.interpolated(50), p95=weighted.interpolated(95))


@query(_PLAIN + f" SELECT priority, {', '.join(_r(f'min(acc) FILTER (WHERE cw / tw >= {q / 100})', f'q{q}') for q in (10, 50, 90))} FROM run GROUP BY priority")
def weighted_quantile_step(spark, sf_dir):
    return _one_statistic(spark, sf_dir, q10=weighted.step(0.1), q50=weighted.step(0.5), q90=weighted.step(0.9))


@query(_PLAIN + f" SELECT priority, {_r('min(acc) FILTER (WHERE cw / tw >= 0.9) / min(acc) FILTER (WHERE cw / tw >= 0.1)', 'p90_p10')}, {_r('min(acc) FILTER (WHERE cw / tw >= 0.8) / min(acc) FILTER (WHERE cw / tw >= 0.2)', 'p80_p20')} FROM run GROUP BY priority")
def p_ratios(spark, sf_dir):
    return _one_statistic(spark, sf_dir, p90_p10=weighted.ratio(0.9, 0.1), p80_p20=weighted.ratio(0.8, 0.2))


@query(_PLAIN + f" SELECT priority, {_r('1 - 2 * sum(cxw * pop) / (sum(acc * pop) * sum(pop))', 'gini')}, {_r('sum(acc * pop * ln(acc)) / sum(acc * pop) - ln(sum(acc * pop) / sum(pop))', 'theil')}, {_r('ln(sum(acc * pop) / sum(pop)) - sum(pop * ln(acc)) / sum(pop)', 'mld')}, {_r('sqrt(sum(pop * (acc - mu) * (acc - mu)) / (sum(pop) - sum(pop * pop) / sum(pop)))', 'wstd')} FROM run GROUP BY priority")
def inequality_indices(spark, sf_dir):
    return _one_statistic(spark, sf_dir, gini=weighted.gini(), theil=weighted.theil(), mld=weighted.mean_log_deviation(), wstd=weighted.deviation())


# ---- concentration ---------------------------------------------------------------------------------------------------

_RANKED = "SELECT year, c_acctbal AS rank, acc AS y, pop AS w FROM cells JOIN customer ON c_custkey = custkey"


def _ci_sql(rule: str) -> str:
    return f"""WITH {_CELLS_SQL}, src AS ({_RANKED} WHERE c_acctbal {rule} 0 AND pop > 0), run AS (
        SELECT *, (sum(w) OVER (PARTITION BY year ORDER BY rank, y, w ROWS UNBOUNDED PRECEDING) - 0.5 * w) / sum(w) OVER (PARTITION BY year) AS r,
               sum(w) OVER (PARTITION BY year) AS tw, sum(w * y) OVER (PARTITION BY year) / sum(w) OVER (PARTITION BY year) AS mu FROM src)
        SELECT year, count(*) AS n, {_r('max(tw)', 'pop')}, {_r('max(mu)', 'mean_y')}, {_r('2 * sum(w * (y - mu) * (r - 0.5)) / max(tw) / max(mu)', 'ci')} FROM run GROUP BY year"""


@query(_ci_sql(">"))
def ci_by_year(spark, sf_dir):
    return _rounded(concentration.concentration_index(_with_customer(spark, sf_dir), "c_acctbal", "acc", "pop", ["year"], buckets=4))


@query(_ci_sql(">="))
def ci_ge0_rule(spark, sf_dir):
    return _rounded(concentration.concentration_index(_with_customer(spark, sf_dir), "c_acctbal", "acc", "pop", ["year"], "ge0"))


@query(f"""WITH years(year) AS (SELECT CAST(unnest(range(1994, 2003)) AS INT)), found AS ({_ci_sql('>')})
    SELECT year, 'orders' AS name, n, pop, mean_y, ci FROM years LEFT JOIN found USING (year)""")
def ci_series(spark, sf_dir):
    spec = concentration.AnalysisSpec("orders", "c_acctbal")
    return _rounded(concentration.ci_series(_with_customer(spark, sf_dir), range(1994, 2003), spec))


@query(f"SELECT year, ci, year IN (1995, 2001) AS labelled FROM ({_ci_sql('>')}) WHERE ci IS NOT NULL")
def ci_trend(spark, sf_dir):
    spec = concentration.AnalysisSpec("orders", "c_acctbal")
    series = concentration.ci_series(_with_customer(spark, sf_dir), range(1994, 2003), spec)
    return _rounded(concentration.ci_trend(series, (1995, 2001)).select("year", "ci", "labelled"))


@query(f"""WITH {_CELLS_SQL}, src AS ({_RANKED} WHERE c_acctbal > 0 AND pop > 0), run AS (
    SELECT rank, y, w, year, sum(w) OVER o / sum(w) OVER p AS cum_pop, sum(w * y) OVER o / sum(w * y) OVER p AS cum_y
    FROM src WINDOW o AS (PARTITION BY year ORDER BY rank, y, w ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY year))
    SELECT year, rank, y, w, count(*) AS copies, {_r('max(cum_pop)', 'cum_pop')}, {_r('max(cum_y)', 'cum_y')} FROM run GROUP BY year, rank, y, w""")
def concentration_curve(spark, sf_dir):
    return _rounded(concentration.concentration_curve(_with_customer(spark, sf_dir), "c_acctbal", "acc", "pop", ["year"], buckets=2))


@query(f"""WITH {_CELLS_SQL}, src AS (SELECT acc AS x, pop AS w FROM cells WHERE pop > 0),
    s AS (SELECT sum(w) AS tw, sum(w * w) AS tww, sum(w * x) / sum(w) AS mu, min(x) AS lo, max(x) AS hi FROM src),
    v AS (SELECT any_value(tw) AS tw, any_value(lo) AS lo, any_value(hi) AS hi, 5.0 * pow(any_value(tw) * any_value(tw) / any_value(tww), -0.2) * sqrt(sum(w * (x - mu) * (x - mu)) / (any_value(tw) - any_value(tww) / any_value(tw))) AS h FROM src, s),
    g AS (SELECT i, greatest(lo - 3 * h, 0) + (least(hi + 3 * h, hi) - greatest(lo - 3 * h, 0)) * i / 199 AS grid_x, h, v.tw AS tw FROM v, range(0, 200) r(i))
    SELECT CAST(i AS INT) AS i, {_r('grid_x', 'grid_x')}, {_r('1000000 * sum(w * exp(-0.5 * pow((grid_x - x) / h, 2)) / (h * sqrt(2 * pi())) / g.tw)', 'density')} FROM g, src GROUP BY i, grid_x""")
def kde_grid(spark, sf_dir):
    found = concentration.weighted_kde(cells(spark, sf_dir), "acc", "pop")
    return _rounded(found.withColumn("density", F.col("density") * 1000000))


# ---- catchment -------------------------------------------------------------------------------------------------------

_OD_SQL = """
    od AS (SELECT l_suppkey AS hospital_id, o_custkey AS grid_id, min(l_quantity) AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    fac AS (SELECT s_suppkey AS hospital_id, s_acctbal AS beds, CASE s_suppkey % 3 WHEN 0 THEN 'Level3A' WHEN 1 THEN 'Level2B' ELSE 'Level1' END AS grade FROM supplier),
    grd AS (SELECT c_custkey AS grid_id, c_acctbal AS pop FROM customer)"""
_LEVEL = "CASE WHEN grade LIKE 'Level3%' THEN 3 WHEN grade LIKE 'Level2%' THEN 2 ELSE 1 END"
_REACH = "CASE WHEN grade LIKE 'Level3%' THEN 60.0 WHEN grade LIKE 'Level2%' THEN 45.0 ELSE 30.0 END"
_DECAY = f"CASE WHEN minutes > {_REACH} THEN 0 ELSE greatest(0, (exp(-0.5 * pow(minutes / ({_REACH}), 2)) - exp(-0.5)) / (1 - exp(-0.5))) END"


def _s1_sql(where: str = "") -> str:
    return f"""{_OD_SQL}, pw AS (SELECT hospital_id, sum(pop * {_DECAY}) AS pw, count(*) AS pairs FROM od JOIN grd USING (grid_id) JOIN fac USING (hospital_id) WHERE pop > 0 GROUP BY hospital_id),
    raw AS (SELECT fac.*, {_REACH} AS threshold, pw, pairs, CASE WHEN pw = 0 THEN 0 ELSE beds / pw * 10000 END AS r FROM fac LEFT JOIN pw USING (hospital_id) {where}),
    s1 AS (SELECT hospital_id, grade, beds, threshold, pw AS pop_potential, CASE WHEN pairs IS NULL THEN 'NO_VALID_GRIDS' WHEN pw < 0 THEN 'PW_INVALID_PW_SUM_NEGATIVE' WHEN r < 0 THEN 'R_INVALID_R_VALUE_NEGATIVE' WHEN r = 0 THEN 'R_INVALID_R_VALUE_ZERO' WHEN r > 100 THEN 'R_INVALID_R_VALUE_TOO_LARGE' ELSE 'SUCCESS' END AS status, r FROM raw)"""


def _od(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("hospital_id"), F.col("o_custkey").alias("grid_id")).agg(F.min("l_quantity").alias("minutes"))


def _facilities(spark, sf_dir) -> DataFrame:
    grade = F.when(F.col("s_suppkey") % 3 == 0, "Level3A").when(F.col("s_suppkey") % 3 == 1, "Level2B").otherwise("Level1")
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hospital_id"), F.col("s_acctbal").alias("beds"), grade.alias("grade"))


def _grids(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid_id"), F.col("c_acctbal").alias("pop"))


@query(f"WITH {_OD_SQL} SELECT hospital_id, grid_id, {_LEVEL} AS level, {_REACH} AS threshold, {_r(_DECAY, 'decay')} FROM od JOIN fac USING (hospital_id)")
def gaussian_decay(spark, sf_dir):
    df = _od(spark, sf_dir).join(_facilities(spark, sf_dir), "hospital_id")
    threshold = catchment.grade_threshold(F.col("grade"))
    return _rounded(df.select("hospital_id", "grid_id", catchment.grade_level(F.col("grade")).alias("level"), threshold.alias("threshold"), catchment.gaussian_decay(F.col("minutes"), threshold).alias("decay")))


def _s1(spark, sf_dir) -> DataFrame:
    return catchment.supply_ratio(_facilities(spark, sf_dir), _grids(spark, sf_dir), _od(spark, sf_dir))


@query(f"WITH {_s1_sql()} SELECT hospital_id, grade, beds, threshold, {_r('pop_potential', 'pop_potential')}, status, {_r(chr(67) + 'ASE WHEN status = ' + repr('SUCCESS') + ' THEN r ELSE 0 END', '\"R\"')} FROM s1")
def s1_supply_ratio(spark, sf_dir):
    return _rounded(_s1(spark, sf_dir))


@query(f"WITH {_s1_sql()} SELECT status, count(*) AS n FROM s1 GROUP BY status")
def s1_status(spark, sf_dir):
    return _s1(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _s2_sql(levels: tuple[int, ...], where: str = "") -> str:
    nearest = ", ".join(f"coalesce(min(minutes) FILTER (WHERE {_LEVEL} = {n}), -1.0) AS \"nearest_L{n}_time\"" for n in levels)
    names = ", ".join(f"coalesce(\"nearest_L{n}_time\", -1.0) AS \"nearest_L{n}_time\"" for n in levels)
    return f"""WITH {_s1_sql(where)}, s2 AS (SELECT grid_id, sum(r * {_DECAY}) AS acc, {nearest} FROM od JOIN s1 USING (hospital_id) WHERE status = 'SUCCESS' GROUP BY grid_id)
        SELECT grd.grid_id, pop, round(coalesce(acc, 0), {DIGITS}) + 0.0 AS acc, {names} FROM grd LEFT JOIN s2 USING (grid_id)"""


@query(_s2_sql((3, 2, 1)))
def s2_accessibility(spark, sf_dir):
    return _rounded(catchment.two_step(_facilities(spark, sf_dir), _grids(spark, sf_dir), _od(spark, sf_dir), level3_only=False)[1])


@query(_s2_sql((3,), "WHERE grade LIKE 'Level3%'"))
def level3_only(spark, sf_dir):
    return _rounded(catchment.two_step(_facilities(spark, sf_dir), _grids(spark, sf_dir), _od(spark, sf_dir))[1])


@query("""WITH pairs AS (SELECT DISTINCT l_suppkey AS origin_id, l_partkey AS dest_id FROM lineitem), t AS (
    SELECT origin_id, dest_id, o AS ordinal, CASE WHEN (origin_id * 7 + dest_id * 3 + o * 11) % 29 = 0 THEN CAST((origin_id + dest_id + o) % 90 AS DOUBLE) END AS cost FROM pairs, range(0, 25) r(o))
    SELECT origin_id, dest_id, arg_min(cost, ordinal) FILTER (WHERE cost IS NOT NULL) AS minutes FROM t GROUP BY origin_id, dest_id""")
def travel_time_jitter(spark, sf_dir):
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("origin_id"), F.col("l_partkey").alias("dest_id")).distinct()
    tries = pairs.withColumn("ordinal", F.explode(F.array(*(F.lit(o) for o, *_ in catchment.jitter_offsets()))))
    cost = F.when((F.col("origin_id") * 7 + F.col("dest_id") * 3 + F.col("ordinal") * 11) % 29 == 0, ((F.col("origin_id") + F.col("dest_id") + F.col("ordinal")) % 90).cast("double"))
    return catchment.first_cost(tries.withColumn("cost", cost), ["origin_id", "dest_id"])


@query("""WITH c AS (SELECT c_custkey AS grid_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS acc FROM customer), k AS (SELECT c_custkey AS grid_id, 1.5 AS acc FROM customer WHERE c_custkey % 2 = 0)
    SELECT grid_id, coalesce(k.acc, c.acc) AS acc FROM c LEFT JOIN k USING (grid_id)""")
def checkpoint_overlay(spark, sf_dir):
    base = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("acc"))
    done = _table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("grid_id"), F.lit(1.5).alias("acc"))
    return catchment.overlay(base, done, "grid_id", ["acc"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_unfinished(spark, sf_dir):
    items = _table(spark, sf_dir, "customer").select("c_custkey")
    return catchment.unfinished(items, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 1000) / 100.0 AS lng, (c_custkey * 91 % 1000) / 100.0 AS lat FROM customer), e(region, ax, ay, bx, b_y) AS (VALUES
    ('triangle', 1.003, 1.007, 8.011, 2.013), ('triangle', 8.011, 2.013, 3.017, 7.019), ('triangle', 3.017, 7.019, 1.003, 1.007),
    ('frame', 2.001, 2.001, 9.003, 2.001), ('frame', 9.003, 2.001, 9.003, 9.007), ('frame', 9.003, 9.007, 2.001, 9.007), ('frame', 2.001, 9.007, 2.001, 2.001),
    ('frame', 4.001, 4.001, 6.003, 4.001), ('frame', 6.003, 4.001, 6.003, 6.007), ('frame', 6.003, 6.007, 4.001, 6.007), ('frame', 4.001, 6.007, 4.001, 4.001))
    SELECT c_custkey, lng, lat, region FROM p, e GROUP BY ALL HAVING sum(CASE WHEN (ay > lat) <> (b_y > lat) AND lng < (bx - ax) * (lat - ay) / (b_y - ay) + ax THEN 1 ELSE 0 END) % 2 = 1""")
def point_in_region(spark, sf_dir):
    points = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 1000 / 100.0).alias("lng"), (F.col("c_custkey") * 91 % 1000 / 100.0).alias("lat"))

    def square(w, s, e, n):
        return [(w, s), (e, s), (e, n), (w, n), (w, s)]

    rings = [("triangle", [[(1.003, 1.007), (8.011, 2.013), (3.017, 7.019), (1.003, 1.007)]]), ("frame", [square(2.001, 2.001, 9.003, 9.007), square(4.001, 4.001, 6.003, 6.007)])]
    regions = spark.createDataFrame(rings, "name string, rings array<array<struct<lng: double, lat: double>>>")
    return spatial.clip(points, regions, cell=2.0)


# ---- facilities and scalar functions ---------------------------------------------------------------------------------

_TIMES_SQL = "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN '19' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '年5月' WHEN 1 THEN '2001' WHEN 2 THEN '2003.0' WHEN 3 THEN ' 20' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || '/1 ' WHEN 4 THEN '98年' WHEN 5 THEN 'abc' WHEN 6 THEN '20101' END"


def _times() -> Column:
    k, two = F.col("o_orderkey") % 8, lambda m: F.lpad((F.col("o_orderkey") % m).cast("string"), 2, "0")
    return F.when(k == 0, F.concat(F.lit("19"), two(100), F.lit("年5月"))).when(k == 1, "2001").when(k == 2, "2003.0").when(k == 3, F.concat(F.lit(" 20"), two(30), F.lit("/1 "))).when(k == 4, "98年").when(k == 5, "abc").when(k == 6, "20101")


_YEAR_SQL = f"coalesce(try_cast(nullif(regexp_extract(trim({_TIMES_SQL}), '^([0-9]{{4}})(?:年|[-./]|$)', 1), '') AS INT), -1)"


@query(f"SELECT o_orderkey, {_YEAR_SQL} AS year FROM orders")
def format_time(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.format_time(_times()).alias("year"))


@query(f"""WITH t AS (SELECT o_orderkey, {_YEAR_SQL} AS construction_time, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 10 END AS "2014" FROM orders)
    SELECT o_orderkey, construction_time, "2014", CASE WHEN construction_time = -1 OR "2014" = -1 THEN 'review' ELSE 'complete' END AS part FROM t""")
def clean_split(spark, sf_dir):
    raw = _table(spark, sf_dir, "orders").select("o_orderkey", _times().alias("construction_time"), F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(10).alias("2014"))
    _, review, complete = facilities.clean_construction_years(raw)
    return review.withColumn("part", F.lit("review")).unionByName(complete.withColumn("part", F.lit("complete")))


_LNG, _LAT = "(70 + (c_custkey * 7919 % 70000) / 1000.0)", "(2 + (c_custkey * 104729 % 53000) / 1000.0)"


def _points(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select("c_custkey", (70 + (k * 7919 % 70000) / 1000.0).alias("lng"), (2 + (k * 104729 % 53000) / 1000.0).alias("lat"))


def _flat(df: DataFrame, point: Column, digits: int = 6) -> DataFrame:
    return df.withColumn("p", point).select("c_custkey", F.round("p.lng", digits).alias("lng"), F.round("p.lat", digits).alias("lat"))


_X_PI = "(pi() * 3000.0 / 180.0)"


@query(f"""WITH p AS (SELECT c_custkey, {_LNG} - 0.0065 AS x, {_LAT} - 0.006 AS y FROM customer), q AS (
    SELECT c_custkey, sqrt(x * x + y * y) - 0.00002 * sin(y * {_X_PI}) AS z, atan2(y, x) - 0.000003 * cos(x * {_X_PI}) AS t FROM p)
    SELECT c_custkey, round(z * cos(t), 6) AS lng, round(z * sin(t), 6) AS lat FROM q""")
def bd09_to_gcj02(spark, sf_dir):
    return _flat(_points(spark, sf_dir), geo.bd09_to_gcj02(F.col("lng"), F.col("lat")))


_WAVE = "(20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3"
_GCJ_SQL = f"""
    terms AS (SELECT *, lng - 105 AS x, lat - 35 AS y, 1 - 0.00669342162296594323 * pow(sin(lat / 180 * pi()), 2) AS magic FROM src),
    shifts AS (SELECT *, (-100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + {_WAVE} + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3)
            * 180 / ((6378245.0 * (1 - 0.00669342162296594323)) / (magic * sqrt(magic)) * pi()) AS dlat,
        (300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + {_WAVE} + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3)
            * 180 / (6378245.0 / sqrt(magic) * cos(lat / 180 * pi()) * pi()) AS dlng, lng > 73.66 AND lng < 135.05 AND lat > 3.86 AND lat < 53.55 AS inside FROM terms)"""


@query(f"WITH src AS (SELECT c_custkey, {_LNG} AS lng, {_LAT} AS lat FROM customer), {_GCJ_SQL} SELECT c_custkey, round(CASE WHEN inside THEN lng + dlng ELSE lng END, 6) AS lng, round(CASE WHEN inside THEN lat + dlat ELSE lat END, 6) AS lat FROM shifts")
def wgs84_to_gcj02(spark, sf_dir):
    return _flat(_points(spark, sf_dir), geo.wgs84_to_gcj02(F.col("lng"), F.col("lat")))


def _shift_sql(points: str) -> str:
    """points with dlng and dlat, the transform's shift at (lng, lat)."""
    terms = f"SELECT *, lng - 105 AS x, lat - 35 AS y, 1 - 0.00669342162296594323 * pow(sin(lat / 180 * pi()), 2) AS magic FROM ({points})"
    return f"""SELECT *, (-100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + {_WAVE} + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3)
            * 180 / ((6378245.0 * (1 - 0.00669342162296594323)) / (magic * sqrt(magic)) * pi()) AS dlat,
        (300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + {_WAVE} + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3)
            * 180 / (6378245.0 / sqrt(magic) * cos(lat / 180 * pi()) * pi()) AS dlng FROM ({terms})"""


_INSIDE = "lng > 73.66 AND lng < 135.05 AND lat > 3.86 AND lat < 53.55"


def _inverse_sql(images: str) -> str:
    """The inverse of images (c_custkey, lng, lat): 30 turns of correction by the residual."""
    state = "SELECT c_custkey, turn, g_lng, g_lat, converged, lng, lat FROM it WHERE turn < 30"
    done = "(converged OR (abs(g_lng - lng - dlng) <= 1e-6 AND abs(g_lat - lat - dlat) <= 1e-6))"
    return f"""WITH RECURSIVE it AS (SELECT c_custkey, 0 AS turn, lng AS g_lng, lat AS g_lat, NOT ({_INSIDE}) AS converged, lng, lat FROM ({images})
        UNION ALL SELECT c_custkey, turn + 1, g_lng, g_lat, {done}, CASE WHEN {done} THEN lng ELSE g_lng - dlng END, CASE WHEN {done} THEN lat ELSE g_lat - dlat END FROM ({_shift_sql(state)}))
        SELECT c_custkey, round(lng, 6) AS lng, round(lat, 6) AS lat, converged FROM it WHERE turn = 30"""


_IMAGE_SQL = f"SELECT c_custkey, CASE WHEN {_INSIDE} THEN lng + dlng ELSE lng END AS lng, CASE WHEN {_INSIDE} THEN lat + dlat ELSE lat END AS lat FROM ({_shift_sql(f'SELECT c_custkey, {_LNG} AS lng, {_LAT} AS lat FROM customer')})"
_GCJ_OF_BD_SQL = f"""SELECT c_custkey, z * cos(t) AS lng, z * sin(t) AS lat FROM (SELECT c_custkey, sqrt(x * x + y * y) - 0.00002 * sin(y * {_X_PI}) AS z, atan2(y, x) - 0.000003 * cos(x * {_X_PI}) AS t
    FROM (SELECT c_custkey, {_LNG} - 0.0065 AS x, {_LAT} - 0.006 AS y FROM customer))"""


@query(_inverse_sql(_IMAGE_SQL))
def gcj02_to_wgs84(spark, sf_dir):
    """There and back for every customer, with converged. Near the box's edge an image may lie outside, where the inverse
    is the image itself."""
    there = _points(spark, sf_dir).withColumn("g", geo.wgs84_to_gcj02(F.col("lng"), F.col("lat"))).withColumn("p", geo.gcj02_to_wgs84(F.col("g.lng"), F.col("g.lat")))
    return there.select("c_custkey", F.round("p.lng", DIGITS).alias("lng"), F.round("p.lat", DIGITS).alias("lat"), "p.converged")


@query(_inverse_sql(_GCJ_OF_BD_SQL))
def bd09_to_wgs84(spark, sf_dir):
    p = geo.bd09_to_wgs84(F.col("lng"), F.col("lat"))
    return _points(spark, sf_dir).withColumn("p", p).select("c_custkey", F.round("p.lng", DIGITS).alias("lng"), F.round("p.lat", DIGITS).alias("lat"), "p.converged")


@query(f"WITH w AS ({_inverse_sql(_GCJ_OF_BD_SQL)}) SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN lng END AS lng, CASE WHEN c_custkey % 7 <> 0 THEN lat END AS lat FROM w")
def to_wgs84_columns(spark, sf_dir):
    """The columns of a facility table, as text, every seventh not a number."""

    def text_of(c: str) -> Column:
        return F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col(c).cast("string")).alias(f"{c}_bd08")

    out = facilities.to_wgs84(_points(spark, sf_dir).select("c_custkey", text_of("lng"), text_of("lat")))
    return out.select("c_custkey", F.round("lng", DIGITS).alias("lng"), F.round("lat", DIGITS).alias("lat"))


@query(f"SELECT c_custkey, NOT ({_LNG} > 73.66 AND {_LNG} < 135.05 AND {_LAT} > 3.86 AND {_LAT} < 53.55) AS outside FROM customer")
def out_of_china(spark, sf_dir):
    return _points(spark, sf_dir).select("c_custkey", geo.out_of_china(F.col("lng"), F.col("lat")).alias("outside"))


@query("""WITH h AS (SELECT s_name AS name, s_suppkey % 30 + 1995 AS ct, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 2010 + s_suppkey % 10 END AS g, s_suppkey FROM supplier), t AS (
    SELECT h.*, y, CASE WHEN (s_suppkey + y) % 5 = 0 THEN -1.0 ELSE (s_suppkey + y) % 7 * 10.0 END AS beds FROM h, range(2014, 2025) r(y))
    SELECT CAST(y AS INT) AS year, name, CAST(ct AS INT) AS construction_time, CAST(g AS INT) AS "3A_year", beds FROM t WHERE ct <= y AND (g IS NULL OR g <= y) AND beds > 0""")
def valid_time_unpivot(spark, sf_dir):
    k = F.col("s_suppkey")
    wide = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (k % 30 + 1995).cast("int").alias("construction_time"), F.when(k % 4 != 0, 2010 + k % 10).cast("int").alias("3A_year"), *(F.when((k + y) % 5 == 0, -1.0).otherwise((k + y) % 7 * 10.0).alias(str(y)) for y in facilities.ASSIGNED_YEARS))
    return facilities.assign_to_years(wide)


@query("""WITH sup AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'n' || (s_suppkey % 40) END AS name, s_suppkey AS "2014" FROM supplier),
    base AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'n' || (c_custkey % 50) END AS name, c_custkey AS "2014", c_name AS addr_x FROM customer)
    SELECT sup.name, sup."2014", base."2014" AS "2014_base", addr_x, addr_x AS addr FROM sup LEFT JOIN base ON sup.name IS NOT DISTINCT FROM base.name""")
def metadata_left_join_nullsafe(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    sup = _table(spark, sf_dir, "supplier").select(F.when(s % 10 != 0, F.concat(F.lit("n"), (s % 40).cast("string"))).alias("name"), s.alias("2014"))
    base = _table(spark, sf_dir, "customer").select(F.when(c % 50 != 0, F.concat(F.lit("n"), (c % 50).cast("string"))).alias("name"), c.alias("2014"), F.col("c_name").alias("addr_x"))
    return facilities.merge_metadata(base, sup)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS key FROM customer")
def surrogate_key(spark, sf_dir):
    return facilities.surrogate_key(_table(spark, sf_dir, "customer").select("c_custkey"), "key", ["c_custkey"])


@query()
def deterministic_sample(spark, sf_dir):
    return facilities.deterministic_sample(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.05)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS priority FROM orders WHERE year(o_orderdate) IN (1996, 1998)")
def recode_isin(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1996, 1998))
    return df.select("o_orderkey", clean.recode(F.col("o_orderpriority"), {"1-URGENT": "high", "2-HIGH": "high"}).alias("priority"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_totalprice FROM orders WHERE o_orderdate IS NOT NULL")
def union_years(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    years = sorted(r["y"] for r in orders.select(F.year("o_orderdate").alias("y")).where("y IS NOT NULL").distinct().collect())
    parts = [orders.where(F.year("o_orderdate") == y).select("o_orderkey", F.lit(y).alias("year"), "o_totalprice") for y in years]
    return reduce(DataFrame.unionByName, parts) if parts else orders.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice").limit(0)


@query("""SELECT c_custkey, try_cast(CASE WHEN c_custkey % 5 = 0 THEN 'n/a' WHEN c_custkey % 5 = 1 THEN NULL ELSE CAST(c_custkey AS VARCHAR) || '.5' END AS DOUBLE) AS number FROM customer""")
def numeric_coercion(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, None).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return _table(spark, sf_dir, "customer").select("c_custkey", clean.to_double(raw).alias("number"))


# ---- panel -----------------------------------------------------------------------------------------------------------

_CITY_SQL = "SELECT c_mktsegment AS seg, n_name, o_totalprice, o_custkey, CAST(year(o_orderdate) AS INT) AS year FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def _cities(spark, sf_dir) -> DataFrame:
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("seg"), "n_name", "o_totalprice", "o_custkey", F.year("o_orderdate").alias("year"))


@query(f"""WITH y AS ({_CITY_SQL}), g AS (SELECT n_name, seg, avg(o_custkey) AS city_pop, sum(o_totalprice) AS new_hosp_beds, coalesce(sum(CASE WHEN year = 1997 THEN o_totalprice END), 0) AS expanded_beds FROM y GROUP BY n_name, seg)
    SELECT n_name, seg, {_r('city_pop', 'city_pop')}, round(new_hosp_beds, 4) AS new_hosp_beds, round(expanded_beds, 4) AS expanded_beds, round(new_hosp_beds / city_pop * 10000, 2) AS "city_SEE", round(expanded_beds / city_pop * 10000, 2) AS "city_CIE", round((new_hosp_beds - expanded_beds) / city_pop * 10000, 2) AS "Dominance" FROM g""")
def panel_sum_mean(spark, sf_dir):
    df = _cities(spark, sf_dir).select("n_name", "seg", F.col("o_custkey").alias("city_pop"), F.col("o_totalprice").alias("new_hosp_beds"), F.when(F.col("year") == 1997, F.col("o_totalprice")).alias("expanded_beds"))
    out = panel.city_expansion(df, ["n_name", "seg"], summed=("new_hosp_beds", "expanded_beds"))
    return out.select("n_name", "seg", F.round("city_pop", DIGITS).alias("city_pop"), *(F.round(c, 4).alias(c) for c in ("new_hosp_beds", "expanded_beds")), *(F.round(c, 2).alias(c) for c in ("city_SEE", "city_CIE", "Dominance")))


_BY_YEAR_SQL = f"y AS (SELECT n_name, year, sum(o_totalprice) AS v, count(*) AS n FROM ({_CITY_SQL}) GROUP BY n_name, year)"


def _by_year(spark, sf_dir) -> DataFrame:
    return _cities(spark, sf_dir).groupBy("n_name", "year").agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BY_YEAR_SQL}, p AS (SELECT n_name, max(v) FILTER (WHERE year = 1996) AS a, max(v) FILTER (WHERE year = 1999) AS b FROM y WHERE year IN (1996, 1999) GROUP BY n_name)
    SELECT n_name, round(a, 4) AS "GDP_1996", round(b - a, 4) AS "GDP_growth", {_r('(b - a) / a', '"GDP_growth_pct"')} FROM p""")
def pivot_growth(spark, sf_dir):
    out = panel.pivot_growth(_by_year(spark, sf_dir), "n_name", "year", "v", 1996, 1999)
    return out.select("n_name", F.round("GDP_1996", 4).alias("GDP_1996"), F.round("GDP_growth", 4).alias("GDP_growth"), F.round("GDP_growth_pct", DIGITS).alias("GDP_growth_pct"))


@query(f"""WITH {_BY_YEAR_SQL}, g AS (SELECT n_name, avg(v) AS m, sum(v) AS s, sum(n) AS r, arg_min(v, year) AS a, arg_max(v, year) AS b FROM y WHERE year BETWEEN 1996 AND 1999 GROUP BY n_name)
    SELECT n_name, round(m, 4) AS "Ppo_NetIn", round(s / r, 4) AS "Ppo_NetIn_rate", round(a, 4) AS "ResPop_2014", round(b - a, 4) AS "ResPop_growth", {_r('(b - a) / a', '"ResPop_growth_rate"')} FROM g""")
def population_flow(spark, sf_dir):
    df = _by_year(spark, sf_dir)
    out = panel.population_flow(df.withColumn("res", F.col("v")), "n_name", "year", "v", "n", "res", 1996, 1999)
    return out.select("n_name", *(F.round(c, 4).alias(c) for c in ("Ppo_NetIn", "Ppo_NetIn_rate", "ResPop_2014", "ResPop_growth")), F.round("ResPop_growth_rate", DIGITS).alias("ResPop_growth_rate"))


@query(f"WITH {_BY_YEAR_SQL} SELECT n_name, round(avg(v), 4) AS pop_density_mean FROM y WHERE year BETWEEN 1996 AND 1999 GROUP BY n_name")
def mean_density(spark, sf_dir):
    out = panel.mean_density(_by_year(spark, sf_dir), "n_name", "year", "v", 1996, 1999)
    return out.select("n_name", F.round("pop_density_mean", 4).alias("pop_density_mean"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 24 = 5 THEN 'none' ELSE 'r' || (c_custkey % 12) END AS city, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS acc_2014, 1.0 AS gini_2014 FROM customer),
    p AS (SELECT 'r' || n_nationkey AS prov, n_nationkey * 2.0 AS acc_2014, n_nationkey * 3.0 AS gini_2014 FROM nation)
    SELECT c_custkey, city, CASE WHEN m THEN p.acc_2014 ELSE c.acc_2014 END AS acc_2014, CASE WHEN m THEN p.gini_2014 ELSE c.gini_2014 END AS gini_2014
    FROM (SELECT *, acc_2014 IS NULL AND city IN ('r1', 'r5', 'r7', 'r11', 'none') AS m FROM c) c LEFT JOIN p ON prov = city""")
def fallback_join_muni(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    cities = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 24 == 5, "none").otherwise(F.concat(F.lit("r"), (k % 12).cast("string"))).alias("city"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("acc_2014"), F.lit(1.0).alias("gini_2014"))
    table = _table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), n.cast("string")).alias("prov"), (n * 2.0).alias("acc_2014"), (n * 3.0).alias("gini_2014"))
    return panel.fill_from(cities, table, "city", "prov", ["acc_2014", "gini_2014"], "acc_2014", ["r1", "r5", "r7", "r11", "none"])


@query("""WITH c AS (SELECT n_nationkey, n_name AS city, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 END AS acc_2014 FROM nation),
    t AS (SELECT n_name AS county, s_acctbal AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) = 1)
    SELECT n_nationkey, city, CASE WHEN acc_2014 IS NULL THEN v ELSE acc_2014 END AS acc_2014 FROM c LEFT JOIN t ON county = city""")
def fallback_join_county_first(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    cities = nation.select("n_nationkey", F.col("n_name").alias("city"), F.when(F.col("n_nationkey") % 2 == 0, 1.0).alias("acc_2014"))
    county = _table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("county"), "s_suppkey", F.col("s_acctbal").alias("acc_2014"))
    return panel.fill_from(cities, panel.first_by(county, "county", ["s_suppkey"]), "city", "county", ["acc_2014"], "acc_2014")


# ---- models ----------------------------------------------------------------------------------------------------------

@query(f"WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer) SELECT c_custkey, {_r('(c_acctbal - m) / d', 'c_acctbal')} FROM customer, s")
def zscore(spark, sf_dir):
    return _rounded(regression.zscore(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


_VIF = ("l_quantity", "l_extendedprice", "l_discount")


@query(f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
    SELECT 'l_quantity' AS variable, round((1 - c * c) / det, 6) AS "VIF" FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM d""")
def corr_vif(spark, sf_dir):
    return _rounded(regression.vif(_table(spark, sf_dir, "lineitem"), _VIF))


@query("""WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM d),
    e AS (SELECT x, pow(y - a - b * x, 2) AS ee, s.* FROM d, s),
    v AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(n) / (any_value(n) - 2.0) * sum(ee * pow(x - mx, 2)) / pow(any_value(sxx), 2) AS vb,
        any_value(n) / (any_value(n) - 2.0) * sum(ee * pow(1.0 / n - mx * (x - mx) / sxx, 2)) AS va FROM e)
    SELECT 'Intercept' AS term, round(a, 6) AS coef, round(sqrt(va), 6) AS se FROM v UNION ALL SELECT 'x', round(b, 6), round(sqrt(vb), 6) FROM v""")
def ols_hc1(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return _rounded(regression.ols_hc1(df, "y", regression.design(["x"])).frame(spark).select("term", "coef", "se"))


@query("""SELECT c_custkey, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS stars, CASE WHEN v IS NULL THEN '' ELSE printf('%.2f', v) END AS number
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 200) / 1000.0 END AS p, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey / 4.0 END AS v FROM customer)""")
def star_format(spark, sf_dir):
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 9 != 0, k % 200 / 1000.0).alias("p"), F.when(k % 4 != 0, k / 4.0).alias("v"))
    return df.select("c_custkey", text.star_from_p(F.col("p")).alias("stars"), text.fmt_num(F.col("v"), 2).alias("number"))


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '***' ELSE CAST(round(c_acctbal, 2) AS VARCHAR) || repeat('*', c_custkey % 4) END AS s FROM customer)
    SELECT c_custkey, try_cast(nullif(regexp_replace(s, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS coef, regexp_replace(s, '[0-9.\\-]', '', 'g') AS stars, contains(s, '*') AS significant FROM t""")
def split_coef_star(spark, sf_dir):
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, "***").otherwise(F.concat(F.round("c_acctbal", 2).cast("decimal(20,2)").cast("string"), F.repeat(F.lit("*"), (k % 4).cast("int"))))
    df = _table(spark, sf_dir, "customer").select("c_custkey", s.alias("s"))
    return df.select("c_custkey", text.coefficient_of(F.col("s")).alias("coef"), text.stars_of(F.col("s")).alias("stars"), text.is_significant(text.stars_of(F.col("s"))).alias("significant"))


# ---- decomposition ---------------------------------------------------------------------------------------------------

_EIGHT = ["2014", *decomposition.SCENARIOS, "2024"]


def _scenarios(spark, sf_dir) -> DataFrame:
    """Eight scenario rows of two indicators, from orders by their key modulo 8."""
    label = F.element_at(F.array(*(F.lit(x) for x in _EIGHT)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").groupBy(label.alias("Year")).agg((F.avg("o_totalprice") / 1000).alias("price"), (F.avg("o_custkey") / 100).alias("customer"))


def _decomposed_sql() -> str:
    names = ["A000", *decomposition.SCENARIOS.values(), "A111"]
    cols = ", ".join(f"avg(v) FILTER (WHERE k = {i}) AS {n}" for i, n in enumerate(names))

    def marginal(k: int) -> str:
        terms = []
        for i in range(8):
            bits = f"{i:03b}"
            if bits[k] == "0":
                terms.append(f"(A{bits[:k]}1{bits[k + 1:]} - A{bits})")
        return "(" + " + ".join(terms) + ") / 4"

    return f"""v AS (SELECT 'price' AS indicator, o_orderkey % 8 AS k, o_totalprice / 1000 AS v FROM orders UNION ALL SELECT 'customer', o_orderkey % 8, o_custkey / 100.0 FROM orders),
        a AS (SELECT indicator, {cols} FROM v GROUP BY indicator),
        m AS (SELECT *, A111 - A000 AS total, {marginal(0)} AS r, {marginal(1)} AS p, {marginal(2)} AS b FROM a)"""


def _found(spark, sf_dir) -> DataFrame:
    rows = _scenarios(spark, sf_dir)
    return decomposition.contributions(decomposition.scenario_values(rows, rows, ["price", "customer"]))


@query(f"WITH {_decomposed_sql()} SELECT indicator, {_r('total', 'total')}, {_r('r', '\"raw_Road\"')}, {_r('p', '\"raw_Population\"')}, {_r('b', '\"raw_Bed\"')} FROM m")
def shapley_3factors(spark, sf_dir):
    return _rounded(_found(spark, sf_dir).select("indicator", "total", *(f"raw_{f}" for f in decomposition.FACTORS)))


_ROWS_SQL = f"""{_decomposed_sql()}, s AS (SELECT *, total / (r + p + b) AS f FROM m), long AS (
    SELECT indicator, 0 AS ordinal, '2014' AS factor, A000 AS v, 0.0 AS pct FROM s UNION ALL SELECT indicator, 1, 'Road', r * f, r * f / total * 100 FROM s
    UNION ALL SELECT indicator, 2, 'Population', p * f, p * f / total * 100 FROM s UNION ALL SELECT indicator, 3, 'Bed', b * f, b * f / total * 100 FROM s UNION ALL SELECT indicator, 4, '2024', A111, 100.0 FROM s)"""


@query(f"WITH {_ROWS_SQL} SELECT {_r('v', '\"Contribution_abs\"')}, round(pct, 3) + 0.0 AS \"Contribution_pct\", 'accessibility' AS task, indicator, factor, ordinal FROM long")
def shapley_scaled(spark, sf_dir):
    rows = decomposition.contribution_rows(_found(spark, sf_dir), "accessibility")
    return rows.select(F.round("Contribution_abs", DIGITS).alias("Contribution_abs"), (F.round("Contribution_pct", 3) + 0.0).alias("Contribution_pct"), "task", "indicator", "factor", "ordinal")


@query(f"""WITH {_ROWS_SQL}, w AS (SELECT *, CASE factor WHEN '2014' THEN 0 WHEN 'Bed' THEN 1 WHEN 'Population' THEN 2 WHEN 'Road' THEN 3 ELSE 4 END AS position FROM long),
    c AS (SELECT *, sum(CASE WHEN position < 4 THEN v ELSE 0 END) OVER (PARTITION BY indicator ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT indicator, factor, position, {_r('CASE WHEN position IN (0, 4) THEN 0 ELSE run - v END', 'start')}, {_r('CASE WHEN position IN (0, 4) THEN v ELSE run END', '\"end\"')}, CASE WHEN position IN (0, 4) THEN 'total' WHEN v >= 0 THEN 'better' ELSE 'worse' END AS colour FROM c""")
def waterfall(spark, sf_dir):
    rows = decomposition.waterfall(decomposition.contribution_rows(_found(spark, sf_dir), "accessibility"))
    return _rounded(rows.select("indicator", "factor", "position", "start", "end", "colour"))


# ---- levels, sources, models over groups -------------------------------------------------------------------------------

_LEVELS = {"national": (), "priority": ("priority",), "year": ("year",), "both": ("priority", "year")}


def _levels_sql() -> str:
    parts = []
    for level, keys in _LEVELS.items():
        missing = [f"{none} AS {k}" for k, none in (("priority", "'all'"), ("year", "CAST(0 AS INT)")) if k not in keys]
        found = _stats_sql(f"SELECT {', '.join([*keys, 'acc', 'pop'])} FROM cells", ", ".join(keys))
        parts.append(f"SELECT {', '.join([f'{level!r} AS level', *missing, '*'])} FROM ({found})")
    return " UNION ALL BY NAME ".join(parts)


@query(_levels_sql())
def acc_stats_at_levels(spark, sf_dir):
    """Four grouping levels from one read."""
    return _rounded(weighted.stats_at_levels(cells(spark, sf_dir), _LEVELS)).fillna({"priority": "all", "year": 0})


def _folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS acc, o_custkey % 10 AS pop FROM orders)
    SELECT year, count(*) AS grid_num, CAST(sum(pop) AS DOUBLE) AS pop_num, round(sum(acc * pop) / sum(pop), 4) AS pop_mean FROM y WHERE pop > 0 AND year NOT IN (1998, 1999) GROUP BY year""")
def yearly_files(spark, sf_dir):
    """Yearly grid files, written and read back: a year without a file and one without the needed column are left out."""
    folder = _folder(spark, "yearly-files")
    grid = _table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("acc"), (F.col("o_custkey") % 10).alias("pop"), F.col("o_orderstatus").alias("省级"))
    years = sorted(r["y"] for r in grid.select("y").distinct().collect())
    for y in years:
        name = "national_{}_sample.csv" if y % 2 else "national_{}.csv"
        if y != 1999:
            sinks.write_csv(grid.where(F.col("y") == y).drop("y", *(["省级"] if y == 1998 else [])), f"{folder}/{name.format(y)}", bom=y % 3 == 0)
    rows = yearly.load_years(spark, folder, [*years, 2030], need="省级")
    x, w = clean.to_double(F.col("acc")), clean.to_double(F.col("pop"))
    return rows.withColumns({"x": x, "w": w}).where("w > 0").groupBy("year").agg(F.count(F.lit(1)).alias("grid_num"), F.sum("w").alias("pop_num"), F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 4).alias("pop_mean"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_totalprice, o_orderstatus FROM orders")
def yearly_folders(spark, sf_dir):
    """A CSV folder for each year, written and read back whole."""
    path = _folder(spark, "yearly-folders")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus")
    sinks.write_by(orders, path, ["year"])
    return yearly.csv(spark, path, "o_orderkey long, o_totalprice double, o_orderstatus string, year int")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS grid_id, n_nationkey * 3.0 + 0.5 AS lng, n_regionkey * 2.0 + 1.0 AS lat, CASE WHEN n_nationkey % 4 = 1 THEN 0.0 ELSE n_nationkey * 10.0 END AS pop FROM nation""")
def grid_features(spark, sf_dir):
    """A GeoJSON file with a feature on each line, written from every nation and read back."""
    path, i = _folder(spark, "grid"), F.col("n_nationkey")
    w, s = i * 3.0, F.col("n_regionkey") * 2.0
    corners = F.array(*(F.array(a, b) for a, b in ((w, s), (w + 1, s), (w + 1, s + 2), (w, s + 2), (w, s))))
    total = F.when(i % 4 == 1, "none").otherwise((i * 10).cast("string"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(i.cast("string").alias("grid_id"), total.alias("sum")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates")).alias("geometry"))
    _table(spark, sf_dir, "nation").select(F.concat(F.to_json(feature), F.lit(",")).alias("value")).write.text(path)
    return geojson.grid(spark, path).select("grid_id", F.round("lng", DIGITS).alias("lng"), F.round("lat", DIGITS).alias("lat"), "pop")


_BY_FLAG_SQL = """d AS (SELECT l_returnflag AS level, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
    s AS (SELECT level, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM d GROUP BY level),
    e AS (SELECT level, sum(pow(y - a - b * x, 2) * pow(x - mx, 2)) / pow(any_value(sxx), 2) AS v FROM d JOIN s USING (level) GROUP BY level),
    t AS (SELECT sum(n) AS n, 2 * count(*) AS k FROM s)"""


def _by_flag(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("level"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return df, sorted(r["level"] for r in df.select("level").distinct().collect())


@query(f"WITH {_BY_FLAG_SQL} SELECT 'x' AS variable, level, round(b, 6) AS effect, round(sqrt(t.n / (t.n - t.k) * v), 6) AS se FROM s JOIN e USING (level), t")
def marginal_effects(spark, sf_dir):
    """Effects at each level of a model with a variable times levels: with all interactions they are each level's own slope."""
    df, levels = _by_flag(spark, sf_dir)
    fit = regression.ols_hc1(df, "y", regression.design([], "level", levels, levels[-1], interacted=["x"]))
    rows = regression.marginal_effects(fit, ["x"], levels, levels[-1])
    out = spark.createDataFrame(rows, "variable string, level string, effect double, se double, low double, high double, p double")
    return _rounded(out.select("variable", "level", "effect", "se"))


@query(f"WITH {_BY_FLAG_SQL} SELECT level, 'y' AS metric, round(b, 6) AS effect FROM s UNION ALL SELECT level, 'twice', round(2 * b, 6) FROM s")
def total_effects(spark, sf_dir):
    """The effect table of two models fitted together."""
    df, levels = _by_flag(spark, sf_dir)
    terms = regression.design([], "level", levels, levels[-1], interacted=["x"])
    fits = regression.fit_all(df.withColumn("twice", 2 * F.col("y")), {"y": ("y", terms), "twice": ("twice", terms)})
    rows = [(x, m, regression.total_effect(f, "x", x, levels[-1])[0]) for m, f in fits.items() for x in levels]
    return _rounded(spark.createDataFrame(rows, "level string, metric string, effect double"))


@query("""WITH d AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice / 1000 AS y FROM lineitem)
    SELECT 'by_x' AS model, count(*) AS n, round(regr_slope(y, x), 6) AS coef, round(regr_r2(y, x), 6) AS r2 FROM d UNION ALL SELECT 'by_z', count(*), round(regr_slope(y, z), 6), round(regr_r2(y, z), 6) FROM d""")
def model_set(spark, sf_dir):
    """Several models in the same passes."""
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))
    fits = regression.fit_all(df, {"by_x": ("y", regression.design(["x"])), "by_z": ("y", regression.design(["z"]))})
    return _rounded(spark.createDataFrame([(m, f.n, float(f.beta[1]), float(f.r2)) for m, f in fits.items()], "model string, n long, coef double, r2 double"))


# ---- scalar rules over whole tables ------------------------------------------------------------------------------------

@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 > 1 THEN s_acctbal END, 5.0) AS beds FROM supplier")
def beds_default(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 1, "n/a").when(k != 0, F.col("s_acctbal").cast("string"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", catchment.beds_or_default(raw).alias("beds"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 2 THEN c_acctbal END AS v FROM customer")
def finite_or_null(spark, sf_dir):
    k = F.col("c_custkey") % 5
    v = F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k == 2, float("nan")).otherwise(F.col("c_acctbal"))
    return clean.finite_frame(_table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")))


@query("""SELECT c_custkey AS grid_id, c_acctbal AS pop, CAST(0.0 AS DOUBLE) AS acc, CAST(-1.0 AS DOUBLE) AS "nearest_L3_time" FROM customer""")
def no_facility(spark, sf_dir):
    """Cells of regions whose facilities are all of lower levels, under the rule that only level 3 counts."""
    none = _facilities(spark, sf_dir).withColumn("grade", F.lit("Level1"))
    return catchment.two_step(none, _grids(spark, sf_dir), _od(spark, sf_dir))[1]


@query("SELECT o_orderkey, printf('%.0f', o_totalprice / 10000) AS label FROM orders")
def axis_label(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.ten_thousands(F.col("o_totalprice")).alias("label"))


@query("SELECT c_custkey, (c_acctbal - 500 > 0) OR (c_acctbal + 500 < 0) AS excludes FROM customer")
def interval_excludes_zero(spark, sf_dir):
    v = F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select("c_custkey", text.excludes_zero(v - 500, v + 500).alias("excludes"))


@query("""WITH t AS (SELECT c_custkey, c_custkey % 6 AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS a FROM customer)
    SELECT c_custkey, CASE k WHEN 0 THEN 'Megacity' WHEN 1 THEN 'Super Large City' WHEN 2 THEN 'Large City' ELSE 'Medium/Small City' END AS city_level_4, CAST(k AS INT) AS city_level_ordinal, a AS "city_SEE", CAST(2.0 AS DOUBLE) AS "city_CIE", a + 2 AS "city_TotalExpansion" FROM t WHERE k < 4""")
def city_panel_loaded(spark, sf_dir):
    k = F.col("c_custkey") % 6
    level = F.element_at(F.array(*(F.lit(x) for x in (*regression.LEVELS, "Other"))), (F.least(k, F.lit(4)) + 1).cast("int"))
    raw = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k != 5, level).alias("city_level"), F.when(F.col("c_custkey") % 5 == 0, "?").otherwise(F.col("c_acctbal").cast("string")).alias("city_SEE"), F.lit("2").alias("city_CIE"))
    return regression.load_city_panel(raw).select("c_custkey", "city_level_4", "city_level_ordinal", "city_SEE", "city_CIE", "city_TotalExpansion")


_PANEL_SQL = """y AS (SELECT CASE n_nationkey WHEN 0 THEN '北京市' ELSE n_name END AS city, n_nationkey AS key, CAST(year(o_orderdate) AS INT) + 18 AS year, sum(o_totalprice) AS v, count(*) AS n
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
    e AS (SELECT city, key, key % 5 AS k, avg(n) AS pop, sum(v) AS new, sum(n) AS grown, max(v) FILTER (WHERE year = 2014) AS a, max(v) FILTER (WHERE year = 2018) AS b FROM y GROUP BY city, key),
    g AS (SELECT city, avg(v) AS density, avg(n) AS net, sum(n) / sum(v) AS rate, arg_min(v, year) AS first, arg_max(v, year) AS last FROM y WHERE year BETWEEN 2014 AND 2023 GROUP BY city)"""


@query(f"""WITH {_PANEL_SQL} SELECT 'p' || k AS prov, city, CASE k WHEN 0 THEN 'Large City' WHEN 1 THEN 'Medium/Small City' ELSE 'Megacity' END AS city_level, {_r('pop', 'city_pop')}, round(new, 2) AS beds, round(new / pop * 10000, 1) AS see, {_r('(new - grown) / pop', 'dominance')},
    round(a, 2) AS gdp, {_r('(b - a) / a', 'gdp_growth')}, {_r('net', 'net')}, {_r('rate * 1000', 'net_rate')}, {_r('(last - first) / first', 'growth_rate')}, round(density, 4) AS density,
    CASE WHEN key % 3 <> 0 THEN key * 1.0 WHEN key = 0 THEN 7.5 WHEN key % 2 = 0 THEN key * 2.0 END AS acc_2014 FROM e LEFT JOIN g USING (city)""")
def regression_panel(spark, sf_dir):
    """The whole panel: sums by city, controls, baselines from the city, else the municipality's province, else the county."""
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key = F.col("n_nationkey")
    city = F.when(key == 0, "北京市").otherwise(F.col("n_name"))
    met = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == key)
    years = met.groupBy(city.alias("城市"), "n_nationkey", (F.year("o_orderdate") + 18).alias("year")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    level = F.when(key % 5 == 0, "Type I Large City").when(key % 5 == 1, "Small City").otherwise("Megacity")
    cities = years.select(F.concat(F.lit("p"), (key % 5).cast("string")).alias("省级"), F.col("城市").alias("地级"), level.alias("city_level"), F.col("n").alias("city_pop"), F.col("v").alias("new_hosp_beds"), F.col("n").cast("double").alias("expanded_beds"), *(F.lit(1.0).alias(c) for c in panel.SUMMED[2:]))
    gdp = years.where("year IN (2014, 2018)").select("城市", F.when(F.col("year") == 2018, 2023).otherwise(F.col("year")).alias("year"), F.col("v").alias("GDP_per"))
    flow = years.select("城市", F.col("year").alias("年份"), F.col("n").alias("人口净流入(万人)"), F.col("v").alias("户籍人口数(万人)"), F.col("v").alias("常住人口数(万人)"))
    density = years.select("城市", F.col("year").alias("年份"), F.col("v").alias("人口密度(人／平方公里)"))

    def stats(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select(F.lit(2014).alias("Year"), city.alias(name), *(value.alias(c) for c in panel.BASELINES))

    out = panel.regression_panel(cities, gdp, flow, density, stats(nation, "省级", F.lit(7.5)), stats(nation.where(key % 3 != 0), "地级", key * 1.0), stats(nation.where(key % 2 == 0), "县级", key * 2.0))
    shown = {"city_pop": ("city_pop", 6), "beds": ("new_hosp_beds", 2), "see": ("city_SEE", 1), "gdp": ("GDP_2014", 2), "gdp_growth": ("GDP_growth_pct", 6), "net": ("Ppo_NetIn", 6), "growth_rate": ("ResPop_growth_rate", 6), "density": ("pop_density_mean", 4)}
    return out.select(F.col("省级").alias("prov"), F.col("地级").alias("city"), "city_level", *(F.round(c, n).alias(name) for name, (c, n) in shown.items()), F.round(F.col("Dominance") / 10000, 6).alias("dominance"), F.round(F.col("Ppo_NetIn_rate") * 1000, 6).alias("net_rate"), "acc_2014")
