"""Scalar functions over strings: years in free text, significance stars, and coefficients printed with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the year that is not known.
UNKNOWN_YEAR = -1


def format_time(c: Column) -> Column:
    """The four-digit year that free text begins with, where it ends or 年, -, . or / follows; else UNKNOWN_YEAR."""
    found = F.regexp_extract(F.trim(c.cast("string")), r"^([0-9]{4})(?:年|[-./]|$)", 1)
    return F.coalesce(F.when(found != "", found).try_cast("int"), F.lit(UNKNOWN_YEAR))


def star_from_p(p: Column) -> Column:
    """*** under 0.01, ** under 0.05, * under 0.10; empty above, for null and for NaN."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def fmt_num(value: Column, digits: int = 4) -> Column:
    """value with so many decimals; empty for null."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def coefficient_of(c: Column) -> Column:
    """The number in text such as -0.1234***; null if none."""
    digits = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.when(digits != "", digits).try_cast("double")


def stars_of(c: Column) -> Column:
    """What such text has besides its number."""
    return F.regexp_replace(c, r"[0-9.\-]", "")


def is_significant(stars: Column) -> Column:
    return F.coalesce(F.contains(stars, F.lit("*")), F.lit(False))


def excludes_zero(low: Column, high: Column) -> Column:
    """Whether an interval lies on one side of zero."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def _whole_digits(size: Column) -> Column:
    """Every digit of a whole double of 2^53 or more: a part below 10^18, then times 8 as often as it was divided, in limbs of 18 digits."""
    base = 10**18
    times = F.greatest(F.floor((F.log2(size) - 54) / 3), F.lit(0)).cast("int")
    first = F.concat(F.array((size / F.pow(F.lit(8.0), times)).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), 17))

    def eightfold(limbs: Column, _) -> Column:
        more = F.transform(limbs, lambda x: x * 8)
        return F.transform(more, lambda x, i: x % base + F.when(i > 0, ((F.get(more, i - 1) - F.get(more, i - 1) % base) / base).cast("bigint")).otherwise(0))

    limbs = F.aggregate(F.array_repeat(F.lit(0), times), first, eightfold)
    return F.regexp_replace(F.concat_ws("", F.reverse(F.transform(limbs, lambda x: F.lpad(x.cast("string"), 18, "0")))), "^0+", "")


def ten_thousands(c: Column) -> Column:
    """An axis label: value in units of ten thousand, no decimals, every digit, halves to even; nan, inf, null for null."""
    v = F.rint(c.cast("double") / 10000)
    size, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    label = F.when(size < 2**53, F.format_string("%.0f", v)).when(F.isnan(v), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf")))
    return label.when(v.isNotNull(), F.concat(sign, _whole_digits(size)))
