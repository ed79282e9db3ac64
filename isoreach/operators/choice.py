"""Huff choice probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.checks import check_columns, check_greater_equal, check_numeric
from isoreach.operators.normalize import calc_normalize


def calc_choice(weights: DataFrame, attractiveness: DataFrame | None = None, alpha: float = 1.0, a0: float = 0.0, validate: bool = True) -> DataFrame:
    """A_j^alpha * w_ij / (sum_k A_k^alpha * w_ik + a0) per cell, as column ``probability``.

    attractiveness: (facility_id, attractiveness), 1 where not given. The power
    is taken on facility rows, before they meet the pairs. Cells whose weights
    are all zero get NULL.
    """
    if validate:
        check_columns(weights, ["cell_id", "facility_id", "weight"], "weights")
        check_numeric(alpha, "alpha")
        check_numeric(a0, "a0")
        check_greater_equal(a0, 0, "a0")
    if attractiveness is not None:
        if validate:
            check_columns(attractiveness, ["facility_id", "attractiveness"], "attractiveness")
            if attractiveness.filter("attractiveness < 0").limit(1).count():
                raise ValueError("attractiveness must be >= 0")
        a = attractiveness.select("facility_id", F.pow(F.col("attractiveness").cast("double"), F.lit(float(alpha))).alias("__a"))
        weights = weights.join(a, "facility_id").select("cell_id", "facility_id", (F.col("weight") * F.col("__a")).alias("weight"))
    return calc_normalize(weights, "standard", a0, validate=validate).withColumnRenamed("weight", "probability")
