"""Argument checks. They look at driver-side values and schemas, never at rows, unless a docstring says so."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame


def _values(x: Any) -> list:
    """The non-missing numbers in a scalar or sequence."""
    xs = list(x) if isinstance(x, (list, tuple, set)) else [x]
    return [v for v in xs if v is not None and not (isinstance(v, float) and math.isnan(v))]


def check_class(x: Any, classes: type | tuple[type, ...], name: str) -> None:
    classes = classes if isinstance(classes, tuple) else (classes,)
    if not isinstance(x, classes):
        raise TypeError(f"{name} must be one of the following classes: {', '.join(c.__name__ for c in classes)}")


def check_numeric(x: Any, name: str) -> None:
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in _values(x)):
        raise TypeError(f"{name} must be numeric")


def check_integer(x: Any, name: str) -> None:
    check_numeric(x, name)
    if not all(float(v).is_integer() for v in _values(x)):
        raise ValueError(f"{name} must be integer")


def check_greater(x: Any, bound: float, name: str) -> None:
    if not all(v > bound for v in _values(x)):
        raise ValueError(f"{name} must be > {bound}")


def check_greater_equal(x: Any, bound: float, name: str) -> None:
    if not all(v >= bound for v in _values(x)):
        raise ValueError(f"{name} must be >= {bound}")


def check_less(x: Any, bound: float, name: str) -> None:
    if not all(v < bound for v in _values(x)):
        raise ValueError(f"{name} must be < {bound}")


def check_less_equal(x: Any, bound: float, name: str) -> None:
    if not all(v <= bound for v in _values(x)):
        raise ValueError(f"{name} must be <= {bound}")


def check_range(x: Any, low: float, high: float, name: str) -> None:
    check_greater_equal(x, low, name)
    check_less_equal(x, high, name)


def check_positive(x: Any, name: str) -> None:
    check_greater(x, 0, name)


def check_length(x: Sequence, n: int, name: str) -> None:
    if len(x) != n:
        raise ValueError(f"{name} must have length {n}, not {len(x)}")


def check_lengths_match(x: Sequence, y: Sequence, x_name: str, y_name: str) -> None:
    if len(x) != len(y):
        raise ValueError(f"Length of {x_name} ({len(x)}) must match length of {y_name} ({len(y)})")


def check_surface(x: Any, name: str, cols: Iterable[str] = ("cell_id",)) -> None:
    """A surface or pair table is a DataFrame with the given columns."""
    check_class(x, DataFrame, name)
    check_columns(x, cols, name)


def check_aligned(a: Any, b: Any, a_name: str, b_name: str) -> None:
    """Two grids, where both are known, have one geometry."""
    if a is not None and b is not None and a != b:
        raise ValueError(f"{a_name} and {b_name} must have the same geometry (resolution, extent, and CRS)")


def check_columns(df: DataFrame, cols: Iterable[str], name: str) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"Column(s) not found in {name}: {', '.join(missing)}")


def check_no_missing(x: Sequence, name: str) -> None:
    if len(_values(x)) != len(x):
        raise ValueError(f"{name} must not contain missing values")


def check_choice(x: Any, allowed: Sequence[str], name: str) -> None:
    if x not in allowed:
        raise ValueError(f"{name} must be one of: {', '.join(allowed)}")


def check_unique_ids(df: DataFrame, id_col: str, name: str) -> None:
    """Runs a job: ids occur once."""
    if dup := df.groupBy(id_col).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"{name} must have unique values in {id_col}; {dup[0][0]!r} repeats")
