"""Column helpers for doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def inverse(x: Column) -> Column:
    """1/x with infinity at zero (plain division raises there in ANSI mode)."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), x))


def log10_signed(x: Column) -> Column:
    """log10 that keeps numpy's edge values: -inf at zero and NaN below."""
    return (
        F.when(x > 0, F.log10(x))
        .when(x == 0, F.lit(float("-inf")))
        .when(x < 0, F.lit(float("nan")))
    )


def log10_finite(x: Column) -> Column:
    """log10, null wherever the result would not be finite."""
    return F.when((x > 0) & (x < float("inf")), F.log10(x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def floor_div(x: Column, size: int | Column) -> Column:
    """Whole division rounding towards minus infinity, as BIGINT."""
    return F.floor(x / size)


def ceil_div(x: Column, size: int | Column) -> Column:
    return F.ceil(x / size)


def snap(x: Column, places: int = 6) -> Column:
    """Round half up at a fixed place, with a small nudge so that sums taken in another order agree. Null, NaN and
    infinite values stay what they are, and so do values too large for the place to matter."""
    scale = float(10**places)
    near = F.abs(x) < 1e15 / scale
    return F.when(near, F.floor(x * scale + 0.501) / F.lit(scale)).otherwise(x)
