"""Arithmetic that keeps missing, infinite and undefined apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN to NULL, so that aggregates skip it."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den; x/0 is an infinity of the sign of x, 0/0 is NULL."""
    inf = F.lit(float("inf"))
    return clean(F.when(den != 0, num / den).when(num > 0, inf).when(num < 0, -inf))
