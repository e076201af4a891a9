"""Coercion and missing values: what cannot be read, NaN and infinities become null on the way in."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_or_null(c: Column) -> Column:
    """c, null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def to_double(c: Column) -> Column:
    """c as a finite double; null where it cannot be read as one."""
    return finite_or_null(c.try_cast("double"))


def finite_frame(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of every float column replaced by null."""
    return df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("double", "float")})


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that df has, in the order given."""
    there = set(df.columns)
    return [n for n in names if n in there]


def recode(c: Column, mapping: dict[str, str]) -> Column:
    """Values by a mapping; those it lacks pass through."""
    return reduce(lambda out, kv: out.when(c == kv[0], F.lit(kv[1])), list(mapping.items())[1:], F.when(c == next(iter(mapping)), F.lit(next(iter(mapping.values()))))).otherwise(c)


def any_equals(df: DataFrame, names: Iterable[str], value: int) -> Column:
    """Whether any of the columns, those that exist, equals a sentinel; null counts as no."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(f"`{n}`") == value, F.lit(False)) for n in existing(df, names)), F.lit(False))


RULES = ("gt0", "ge0")


def valid_rows(df: DataFrame, rank: str, value: str, weight: str, rule: str = "gt0") -> DataFrame:
    """df with the three columns as finite doubles, where all are there, weight > 0 and rank > 0 (gt0) or >= 0 (ge0).

    A rank column that df lacks is all null, so no row is left.
    """
    if rule not in RULES:
        raise ValueError(f"rule is {rule!r}; it must be one of {RULES}")
    cast = {c: to_double(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double") for c in (rank, value, weight)}
    out = finite_frame(df).withColumns(cast)
    positive = F.col(f"`{rank}`") > 0 if rule == "gt0" else F.col(f"`{rank}`") >= 0
    return out.where(F.col(f"`{value}`").isNotNull() & (F.col(f"`{weight}`") > 0) & positive)


def divided(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a / b)
