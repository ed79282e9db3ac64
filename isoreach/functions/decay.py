"""Distance decay: distance to weight, as projections that stay in generated code."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.checks import check_choice, check_columns, check_length, check_numeric, check_positive
from isoreach.functions.numeric import safe_ratio

#: Used where no sigma is given. inverse has none.
DEFAULT_SIGMA = {"gaussian": 11.64884, "exponential": 0.1, "power": 2.0, "binary": 97.5}
METHODS = ("gaussian", "exponential", "power", "inverse", "binary")


def _gaussian(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / (2.0 * sigma * sigma))


def _exponential(d: Column, sigma: float) -> Column:
    """sigma is a rate."""
    return F.exp(d * -sigma)


def _power(d: Column, sigma: float) -> Column:
    """Infinite at a distance of zero."""
    return F.pow(d, F.lit(-sigma))


def _inverse(d: Column, c: float = 1.0) -> Column:
    return safe_ratio(F.lit(1.0), d + c)


def _binary(d: Column, sigma: float) -> Column:
    """Inclusive at sigma; a missing distance stays missing."""
    return (d <= sigma).cast("double")


def decay_column(distance: Column, method: str | Callable[..., Column] = "gaussian", sigma: float | None = None, validate: bool = True, **kwargs: Any) -> Column:
    """The weight of a distance column.

    A callable gets the distance, sigma if it declares that and one is given,
    and those of the other arguments that it declares; the rest is ignored.
    """
    if callable(method):
        known = inspect.signature(method).parameters
        given = {k: v for k, v in kwargs.items() if k in known}
        if "sigma" in known and sigma is not None:
            given["sigma"] = sigma
        return method(distance, **given)
    check_choice(method, METHODS, "method")
    if validate and sigma is not None:
        check_length(sigma if isinstance(sigma, (list, tuple)) else [sigma], 1, "sigma")
        check_numeric(sigma, "sigma")
        check_positive(sigma, "sigma")
    d = distance.cast("double")
    if method == "inverse":
        return _inverse(d, float(kwargs.get("c", 1.0)))
    s = float(DEFAULT_SIGMA[method] if sigma is None else sigma)
    return {"gaussian": _gaussian, "exponential": _exponential, "power": _power, "binary": _binary}[method](d, s)


def calc_decay(distance: DataFrame, method: str | Callable[..., Column] = "gaussian", sigma: float | None = None, col: str = "value", out: str = "weight", validate: bool = True, **kwargs: Any) -> DataFrame:
    """Replace the distance column by the weight column."""
    if validate:
        check_columns(distance, [col], "distance")
    w = decay_column(F.col(col), method, sigma, validate, **kwargs)
    return distance.select(*[c for c in distance.columns if c not in (col, out)], w.alias(out))
