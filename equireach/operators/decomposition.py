"""Three-factor decomposition of a change between two years over eight scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equireach.functions.clean import divided

#: Order of the bits of a scenario's name, A000 to A111.
FACTORS = ("Road", "Population", "Bed")
#: Labels of the six mixed scenarios.
SCENARIOS = {
    "14road+14pop+24bed": "A001",
    "14road+24pop+14bed": "A010",
    "24road+14pop+14bed": "A100",
    "24road+14pop+24bed": "A101",
    "14road+24pop+24bed": "A011",
    "24road+24pop+14bed": "A110",
}
#: Weight of a factor's marginal contribution by how many other factors have changed before it.
WEIGHTS = {"banzhaf_rescaled": (1 / 4, 1 / 4, 1 / 4), "shapley": (1 / 3, 1 / 6, 1 / 3)}
WATERFALL = ("Bed", "Population", "Road")
NAMES = tuple(f"A{i:03b}" for i in range(8))


def scenario_values(baseline: DataFrame, scenarios: DataFrame, indicators: Sequence[str], year: str = "Year", first: int = 2014, last: int = 2024, labels: dict[str, str] | None = None) -> DataFrame:
    """(indicator, A000 .. A111): baseline rows of both years and the labelled scenarios, one row for each indicator.

    Rows with other years or labels are ignored. ValueError if a scenario is missing; of several rows of a label the last
    counts, in the order of the table's file.
    """
    label = F.col(f"`{year}`").cast("string")
    ends = {str(first): "A000", str(last): "A111"}

    def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
        scenario = reduce(lambda out, kv: F.when(label == kv[0], kv[1]).otherwise(out), names.items(), F.lit(None).cast("string"))
        return df.select(scenario.alias("scenario"), F.monotonically_increasing_id().alias("_at"), *(F.col(f"`{i}`").cast("double").alias(i) for i in indicators)).where("scenario IS NOT NULL")

    rows = named(baseline, ends).unionByName(named(scenarios, labels or SCENARIOS))
    found = {r[0] for r in rows.select("scenario").distinct().collect()}  # eight at most
    if missing := sorted(set(NAMES) - found):
        raise ValueError(f"scenarios are missing: {', '.join(missing)}")
    long = rows.unpivot(["scenario", "_at"], [f"`{i}`" if not i.isidentifier() else i for i in indicators], "indicator", "value")
    return long.groupBy("indicator").pivot("scenario", list(NAMES)).agg(F.max_by("value", "_at"))


def contributions(values: DataFrame, method: str = "banzhaf_rescaled") -> DataFrame:
    """values with `total` and one column a factor.

    banzhaf_rescaled averages the four marginal contributions alike and scales them to add up to the total;
    shapley weights them by order and adds up of itself.
    """
    weights = WEIGHTS[method]

    def marginal(k: int) -> Column:
        others = [i for i in range(3) if i != k]
        out = F.lit(0.0)
        for n in range(3):
            for chosen in combinations(others, n):
                name = "A" + "".join("1" if i in chosen else "0" for i in range(3))
                with_it = "A" + "".join("1" if i in chosen or i == k else "0" for i in range(3))
                out = out + F.lit(weights[n]) * (F.col(with_it) - F.col(name))
        return out

    raw = values.withColumns({f"raw_{f}": marginal(k) for k, f in enumerate(FACTORS)} | {"total": F.col("A111") - F.col("A000")})
    if method == "shapley":
        return raw.withColumns({f: F.col(f"raw_{f}") for f in FACTORS})
    scale = divided(F.col("total"), F.col("raw_Road") + F.col("raw_Population") + F.col("raw_Bed"))
    return raw.withColumns({f: F.col(f"raw_{f}") * scale for f in FACTORS})


def contribution_rows(found: DataFrame, task: str, first: int = 2014, last: int = 2024) -> DataFrame:
    """Five rows for each indicator: the first year, the factors, the last year, with shares in percent."""
    total = F.col("total")
    rows = [F.struct(F.lit(0).alias("ordinal"), F.col("A000").alias("Contribution_abs"), F.lit(0.0).alias("Contribution_pct"), F.lit(str(first)).alias("factor"))]
    rows += [F.struct(F.lit(k + 1).alias("ordinal"), F.col(f).alias("Contribution_abs"), (divided(F.col(f), total) * 100).alias("Contribution_pct"), F.lit(f).alias("factor")) for k, f in enumerate(FACTORS)]
    rows += [F.struct(F.lit(4).alias("ordinal"), F.col("A111").alias("Contribution_abs"), F.lit(100.0).alias("Contribution_pct"), F.lit(str(last)).alias("factor"))]
    out = found.select("indicator", F.explode(F.array(*rows)).alias("r"))
    return out.select("r.Contribution_abs", "r.Contribution_pct", F.lit(task).alias("task"), "indicator", "r.factor", "r.ordinal")


def waterfall(rows: DataFrame, first: int = 2014, last: int = 2024) -> DataFrame:
    """rows with position, start, end and colour of each bar: first year, Bed, Population, Road, last year.

    A rise is good for the task `accessibility` and bad for others.
    """
    order = [str(first), *WATERFALL, str(last)]
    position = reduce(lambda out, kv: F.when(F.col("factor") == kv[1], kv[0]).otherwise(out), enumerate(order), F.lit(None).cast("int"))
    placed = rows.withColumn("position", position)
    ends = (F.col("position") == 0) | (F.col("position") == len(order) - 1)
    along = Window.partitionBy("task", "indicator").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.when(F.col("position") < len(order) - 1, F.col("Contribution_abs")).otherwise(0.0)).over(along)
    sign = F.when(F.col("task") == "accessibility", 1).otherwise(-1)
    colour = F.when(ends, "total").when(F.col("Contribution_abs") * sign >= 0, "better").otherwise("worse")
    out = placed.withColumn("end", F.when(ends, F.col("Contribution_abs")).otherwise(running))
    return out.withColumn("start", F.when(ends, 0.0).otherwise(F.col("end") - F.col("Contribution_abs"))).withColumn("colour", colour)


def run_tasks(spark, tasks: Sequence[dict], read, labels: dict[str, str] | None = None, method: str = "banzhaf_rescaled", first: int = 2014, last: int = 2024) -> DataFrame:
    """The rows of all tasks, each a dict with name, baseline_csv, shapley_csv and value_cols; read opens a path."""
    parts = []
    for t in tasks:
        values = scenario_values(read(t["baseline_csv"]), read(t["shapley_csv"]), t["value_cols"], first=first, last=last, labels=labels)
        parts.append(contribution_rows(contributions(values, method), t["name"], first, last))
    return reduce(DataFrame.unionByName, parts)
