"""Weight normalisation: across facilities within each cell, never across cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.checks import check_choice, check_columns, check_greater_equal, check_numeric
from isoreach.functions.numeric import clean

METHODS = ("identity", "standard", "semi", "reference")


def calc_normalize(weights: DataFrame, method: str | Callable[..., DataFrame] = "standard", a0: float = 0.0, ref_value: float | None = None, keys: Sequence[str] = ("cell_id",), col: str = "weight", validate: bool = True, **kwargs: Any) -> DataFrame:
    """Normalise ``col`` within ``keys``. With no keys the whole table is one vector.

    standard: w/(sum+a0) where sum+a0 > 0, else NULL. semi: the same where
    sum+a0 > 1, else w. reference: w/ref where ref > 0, else NULL; ref is
    ref_value or the largest weight of the keys. identity: unchanged, and no
    shuffle. A callable gets (weights, ...) and returns a DataFrame.
    """
    if callable(method):
        return method(weights, **kwargs)
    check_choice(method, METHODS, "method")
    if validate:
        check_columns(weights, [*keys, col], "weights")
        check_numeric(a0, "a0")
        check_greater_equal(a0, 0, "a0")
    w = F.col(col)
    if method == "identity":
        return weights
    if method == "reference" and ref_value is not None:
        return weights.withColumn(col, w / F.lit(float(ref_value)) if ref_value > 0 else F.lit(None).cast("double"))
    stat = (F.max if method == "reference" else F.sum)(clean(w))
    if keys:
        df = weights.withColumn("__s", stat.over(Window.partitionBy(*keys)))
    else:  # one row joined to all: no window over an unpartitioned table
        df = weights.crossJoin(F.broadcast(weights.agg(stat.alias("__s"))))
    s = F.col("__s") + (0.0 if method == "reference" else float(a0))
    scaled = F.when(s > (1 if method == "semi" else 0), w / s)
    return df.withColumn(col, scaled.otherwise(w) if method == "semi" else scaled).drop("__s")
