"""Linear models with heteroscedasticity-robust errors: cross products on the cluster, k x k algebra on the driver.

A design is a list of named columns. One aggregation gives X'X and X'y, a second one the sums that weigh squared
residuals; rows never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.functions.clean import existing, to_double
from equireach.functions.distributions import normal_p, normal_quantile, t_p, t_quantile

#: City levels in order, the reference one, and the variables of the models.
LEVELS = ("Megacity", "Super Large City", "Large City", "Medium/Small City")
REFERENCE = "Medium/Small City"
CONTROLS = ("pop_density_mean", "GDP_2014", "GDP_growth_pct", "ResPop_2014", "Ppo_NetIn_rate", "ResPop_growth_rate")
SCALED = ("city_SEE", "city_CIE", "city_TotalExpansion", "acc_2014", "gini_2014", "theil_2014", "MLD_2014", "GDP_2014", "GDP_growth", "GDP_growth_pct", "Ppo_NetIn", "Ppo_NetIn_rate", "ResPop_2014", "ResPop_growth", "ResPop_growth_rate", "pop_density_mean")
FAIRNESS = ("gini_delta", "theil_delta", "MLD_delta", "gini_2014", "theil_2014", "MLD_2014")
#: Outcomes and the baseline that controls for each.
OUTCOMES = {"acc_delta": "acc_2014", "gini_delta": "gini_2014", "theil_delta": "theil_2014", "MLD_delta": "MLD_2014"}
INTERCEPT = "Intercept"


def load_city_panel(panel: DataFrame, levels: Sequence[str] = LEVELS, level_col: str = "city_level") -> DataFrame:
    """Rows of the listed levels with city_level_4, its ordinal, numeric SEE and CIE, and their sum (null if one is)."""
    out = panel.where(F.col(level_col).isin(list(levels))).withColumn("city_level_4", F.col(level_col))
    ordinal = F.array_position(F.array(*(F.lit(x) for x in levels)), F.col(level_col)).cast("int") - 1
    out = out.withColumns({"city_level_ordinal": ordinal, "city_SEE": to_double(F.col("city_SEE")), "city_CIE": to_double(F.col("city_CIE"))})
    return out.withColumn("city_TotalExpansion", F.col("city_SEE") + F.col("city_CIE"))


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that df has, centred and divided by their sample deviation; one without spread is only coerced."""
    names = existing(df, columns)
    if not names:
        return df
    cast = df.withColumns({c: to_double(F.col(c)) for c in names})
    row = cast.agg(*(x for c in names for x in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s")))).first()

    def scaled(c: str) -> Column:
        m, s = row[f"{c}_m"], row[f"{c}_s"]
        return F.col(c) if m is None or s is None or s == 0 or s != s else (F.col(c) - m) / s

    return cast.withColumns({c: scaled(c) for c in names})


def prepared(df: DataFrame) -> DataFrame:
    """Continuous variables z-scored over the whole panel, the fairness ones once more."""
    return zscore(zscore(df, SCALED), FAIRNESS)


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson's, over rows that have all the columns."""
    rows = df.dropna(subset=list(columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    got = rows.agg(*(F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else {}
    out = np.eye(len(columns))
    for i, j in pairs:
        out[i, j] = out[j, i] = np.nan if got[f"c{i}_{j}"] is None else got[f"c{i}_{j}"]
    return out


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, VIF): the diagonal of the inverse correlation matrix; null where it has none."""
    names = existing(df, columns)
    matrix = correlations(df, names)
    try:
        values = np.diag(np.linalg.inv(matrix)).tolist()
    except np.linalg.LinAlgError:
        values = [None] * len(names)
    return df.sparkSession.createDataFrame([(n, None if v is None or not np.isfinite(v) else float(v)) for n, v in zip(names, values, strict=True)], "variable string, VIF double")


@dataclass(frozen=True)
class Fit:
    """A fitted model: terms, coefficients, their HC1 covariance, rows, rank, R squared."""

    terms: tuple[str, ...]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    rank: int
    r2: float

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def p(self) -> list[float | None]:
        """Two-sided, by the normal distribution, as robust errors have it."""
        return [normal_p(b / s) if s > 0 else None for b, s in zip(self.beta, self.se(), strict=True)]

    def combined(self, weights: dict[str, float]) -> tuple[float, float]:
        """A linear combination of coefficients and its variance; KeyError for a term it lacks."""
        v = np.zeros(len(self.terms))
        for term, w in weights.items():
            v[self.terms.index(term) if term in self.terms else self._missing(term)] += w
        return float(v @ self.beta), float(v @ self.cov @ v)

    @staticmethod
    def _missing(term: str) -> int:
        raise KeyError(term)

    def frame(self, spark) -> DataFrame:
        rows = [(t, float(b), float(s), p) for t, b, s, p in zip(self.terms, self.beta, self.se(), self.p(), strict=True)]
        return spark.createDataFrame(rows, "term string, coef double, se double, p double")

    def text(self, name: str, confidence: float = 0.95) -> str:
        """A table of coefficients with errors, z, p and intervals by the normal distribution."""
        reach = normal_quantile(0.5 + confidence / 2)
        lines = [f"{name}: n={self.n}, R2={self.r2:.4f}", f"{'':40s} {'coef':>12s} {'se':>10s} {'z':>9s} {'p':>7s} {'low':>12s} {'high':>12s}"]
        for t, b, s, p in zip(self.terms, self.beta, self.se(), self.p(), strict=True):
            z, shown = (f"{b / s:9.3f}", f"{p:7.4f}") if p is not None else (" " * 9, " " * 7)
            lines.append(f"{t:40s} {b:12.4f} {s:10.4f} {z} {shown} {b - reach * s:12.4f} {b + reach * s:12.4f}")
        return "\n".join(lines)


def side_by_side(fits: dict[str, Fit]) -> str:
    """Models as columns: coefficients with stars, errors in brackets below them, then N and R squared."""

    def stars(p: float | None) -> str:
        return "" if p is None else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""

    terms = list(dict.fromkeys(t for f in fits.values() for t in f.terms))
    lines = [f"{'':40s}" + "".join(f"{n:>24s}" for n in fits)]
    for t in terms:
        at = [f.terms.index(t) if t in f.terms else None for f in fits.values()]
        lines.append(f"{t:40s}" + "".join(" " * 24 if i is None else f"{f.beta[i]:.4f}{stars(f.p()[i])}".rjust(24) for f, i in zip(fits.values(), at, strict=True)))
        lines.append(" " * 40 + "".join(" " * 24 if i is None else f"({f.se()[i]:.4f})".rjust(24) for f, i in zip(fits.values(), at, strict=True)))
    lines += [f"{'N':40s}" + "".join(f"{f.n:24d}" for f in fits.values()), f"{'R2':40s}" + "".join(f"{f.r2:24.3f}" for f in fits.values())]
    return "\n".join(lines)


def design(columns: Sequence[str], level: str | None = None, levels: Sequence[str] = LEVELS, reference: str = REFERENCE, interacted: Sequence[str] = ()) -> dict[str, Column]:
    """Terms of a model: intercept, columns, treatment dummies of level, and interacted columns times dummies."""
    terms = {INTERCEPT: F.lit(1.0)} | {c: F.col(c) for c in columns}
    dummies = {x: F.when(F.col(level) == x, 1.0).otherwise(0.0) for x in levels if x != reference} if level else {}
    terms |= {f"level[{x}]": d for x, d in dummies.items()}
    terms |= {c: F.col(c) for c in interacted}
    terms |= {f"{c}:level[{x}]": F.col(c) * d for c in interacted for x, d in dummies.items()}
    return terms


def ols_hc1(df: DataFrame, y: str, terms: dict[str, Column]) -> Fit:
    """Least squares by the pseudo-inverse with HC1 covariance, over rows in which y and all terms are there."""
    names = list(terms)
    k = len(names)
    rows = df.select(F.col(y).cast("double").alias("y"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values()))).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(k))).first()
    n = first["n"]
    if not n:
        raise ValueError(f"no complete rows for {y}")

    def symmetric(row, name: str) -> np.ndarray:
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"]
        return out

    xx = symmetric(first, "s")
    inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    beta = inverse @ np.array([first[f"t{i}"] for i in range(k)])
    rank = int(np.linalg.matrix_rank(xx, hermitian=True))
    rest = F.col("y")
    for i, b in enumerate(beta.tolist()):
        rest = rest - F.col(f"x{i}") * F.lit(b)
    squared = rows.withColumn("ee", rest * rest)
    second = squared.agg(F.sum("ee").alias("rss"), *(F.sum(F.col("ee") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i, j in pairs)).first()
    factor = n / (n - rank) if n > rank else float("nan")
    cov = factor * inverse @ symmetric(second, "m") @ inverse
    spread = first["syy"] - first["sy"] ** 2 / n
    return Fit(tuple(names), beta, cov, n, rank, 1 - second["rss"] / spread if spread else float("nan"))


def _per_model(wide: DataFrame, models: dict[str, tuple[int, list[int]]], matrices) -> dict[str, np.ndarray]:
    """The sum over rows of a matrix for each model. models: the places of y and of the terms among wide's columns;
    matrices(model, x, y) gives the matrix of some complete rows. Each batch sends one matrix a model, and they are added
    up before they come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for name, (y, terms) in models.items():
                rows = z[~np.isnan(z[:, [y, *terms]]).any(1)]
                total[name] = total.get(name, 0) + matrices(name, rows[:, terms], rows[:, y])
        for name, m in total.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array([name] * m.size), pa.array(i.reshape(-1)), pa.array(j.reshape(-1)), pa.array(m.reshape(-1))], ["model", "i", "j", "v"])

    got = wide.mapInArrow(run, "model string, i long, j long, v double").groupBy("model", "i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for name, (_, terms) in models.items():
        out[name] = np.zeros((len(terms) + 1, len(terms) + 1))
    for r in got:
        out[r["model"]][r["i"], r["j"]] = r["v"]
    return out


def fit_all(df: DataFrame, models: dict[str, tuple[str, dict[str, Column]]]) -> dict[str, Fit]:
    """ols_hc1 of many models (y, terms), each with an intercept, in two passes over df in all; a term's name means the
    same in every model."""
    wide = {f"y:{y}": F.col(y) for y, _ in models.values()} | {n: c for _, terms in models.values() for n, c in terms.items()}
    at = {n: i for i, n in enumerate(wide)}
    rows = df.select(*(F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(wide.values())))
    places = {m: (at[f"y:{y}"], [at[t] for t in terms]) for m, (y, terms) in models.items()}

    def products(_: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([x, y])
        return z.T @ z

    first, known = _per_model(rows, places, products), {}
    for m, (y, _) in models.items():
        xx, one = first[m][:-1, :-1], list(models[m][1]).index(INTERCEPT)
        if not xx[one, one]:
            raise ValueError(f"no complete rows for {y}")
        inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
        known[m] = inverse, inverse @ first[m][:-1, -1], int(np.linalg.matrix_rank(xx, hermitian=True))

    def weighed(m: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ee = (y - x @ known[m][1]) ** 2
        out = np.zeros((x.shape[1] + 1,) * 2)
        out[:-1, :-1], out[-1, -1] = x.T @ (x * ee[:, None]), ee.sum()
        return out

    second, out = _per_model(rows, places, weighed), {}
    for m, (_, terms) in models.items():
        inverse, beta, rank = known[m]
        one = list(terms).index(INTERCEPT)
        n, sy = int(first[m][one, one]), first[m][one, -1]
        factor = n / (n - rank) if n > rank else float("nan")
        spread = first[m][-1, -1] - sy**2 / n
        out[m] = Fit(tuple(terms), beta, factor * inverse @ second[m][:-1, :-1] @ inverse, n, rank, 1 - second[m][-1, -1] / spread if spread else float("nan"))
    return out


def model_designs(columns: Sequence[str]) -> dict[str, tuple[str, dict[str, Column]]]:
    """(y, terms) of the 21 models by name: <outcome>_<1|2|3> for accessibility, <outcome>_<see_cie|total>_<1|2|3> for others.

    1: controls; 2: with effects of city level; 3: expansion interacted with city level. columns: those of the panel.
    """
    out = {}
    for y, base in OUTCOMES.items():
        for family, variables in (("see_cie", ("city_SEE", "city_CIE")), ("total", ("city_TotalExpansion",))):
            if y == "acc_delta" and family == "total":
                continue
            controls = [c for c in (base, *CONTROLS) if c in columns]
            prefix = "acc_delta" if y == "acc_delta" else f"{y}_{family}"
            out[f"{prefix}_1"] = y, design([*controls, *variables])
            out[f"{prefix}_2"] = y, design([*controls, *variables], "city_level_4")
            out[f"{prefix}_3"] = y, design(controls, "city_level_4", interacted=variables)
    return out


def model_set(df: DataFrame) -> dict[str, Fit]:
    """All 21 models by name, over rows that have a city level and all of a model's variables."""
    return fit_all(df.where("city_level_4 IS NOT NULL"), model_designs(df.columns))


def total_effect(fit: Fit, variable: str, level: str, reference: str = REFERENCE) -> tuple[float | None, float | None]:
    """(effect, p) of a variable at a level; (effect, None) without the interaction, (None, None) without the variable."""
    if variable not in fit.terms:
        return None, None
    if level == reference:
        return float(fit.beta[fit.terms.index(variable)]), fit.p()[fit.terms.index(variable)]
    term = f"{variable}:level[{level}]"
    if term not in fit.terms:
        return float(fit.beta[fit.terms.index(variable)]), None
    effect, variance = fit.combined({variable: 1.0, term: 1.0})
    return effect, normal_p(effect / variance**0.5) if variance > 0 else None


def effect_table(spark, fits: dict[str, Fit], variable: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(level, metric, effect, p): to be formatted and pivoted."""
    rows = [(x, m, *total_effect(f, variable, x)) for m, f in fits.items() for x in levels]
    return spark.createDataFrame(rows, "level string, metric string, effect double, p double")


def marginal_effects(fit: Fit, variables: Sequence[str] = ("city_SEE", "city_CIE"), levels: Sequence[str] = LEVELS, reference: str = REFERENCE, confidence: float = 0.95) -> list[tuple[str, str, float, float, float, float, float]]:
    """(variable, level, effect, se, low, high, p) with Student's t of the residual degrees of freedom."""
    reach, out = t_quantile(0.5 + confidence / 2, fit.df_resid), []
    for v in variables:
        for x in levels:
            weights = {v: 1.0} | ({} if x == reference else {f"{v}:level[{x}]": 1.0})
            effect, variance = fit.combined(weights)
            se = max(variance, 0.0) ** 0.5
            out.append((v, x, effect, se, effect - reach * se, effect + reach * se, t_p(effect / se, fit.df_resid) if se else float("nan")))
    return out
