"""Small column helpers shared by the operators: rounding, clamping, ages.

``as_of`` arguments are timestamp literals or columns standing for "now".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: Column | str) -> Column:
    """floor(x + 0.5): halves go up, so -2.5 becomes -2."""
    return F.floor(col(c).cast("double") + F.lit(0.5))


def round1(c: Column | str) -> Column:
    """One decimal, halves up, as a double."""
    return F.floor(col(c).cast("double") * 10 + F.lit(0.5)).cast("double") / F.lit(10.0)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def pct1(part: Column | str, whole: Column | str) -> Column:
    """Percentage with one decimal; null when the denominator is 0 or null."""
    w = col(whole).cast("double")
    return F.when(w != 0, round1(col(part).cast("double") * 100 / w))


def as_of_lit(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def calendar_age(as_of: Column, ts: Column | str) -> Column:
    """Number of date boundaries crossed."""
    return F.datediff(as_of, col(ts))


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def elapsed_days(as_of: Column, ts: Column | str) -> Column:
    """Whole 24-hour periods since ``ts``."""
    return F.floor((_micros(as_of) - _micros(ts)) / F.lit(86_400_000_000.0))


def fractional_days(as_of: Column, ts: Column | str) -> Column:
    return (_micros(as_of) - _micros(ts)) / F.lit(86_400_000_000.0)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (_micros(later) - _micros(earlier)) / F.lit(1_000_000.0)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns computed once for each row.

    Else the optimiser writes their expressions into every use, and a use inside a lambda is
    evaluated for each element of its array.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("__once")).select(*rest, "__once.*")
