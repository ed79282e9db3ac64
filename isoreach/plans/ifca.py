"""Iterative floating catchment area: an equilibrium of use and attractiveness.

Weights are decayed once and kept, dealt and sorted by cell, so that each step
is one pass over them: cells are summed where they lie, and only a sum for each
facility and task is shuffled. The state, a number for each facility, is on the
driver and is broadcast, so that the pairs stay where they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoreach.checks import check_choice, check_columns, check_integer, check_positive, check_range
from isoreach.functions.decay import calc_decay
from isoreach.operators.flow import spread_weighted
from isoreach.plans.models import AccessResult, check_unique_ids


def with_demand(weights: DataFrame, demand: DataFrame) -> DataFrame:
    """Pairs beside the demand of their cell; cells without any are left out."""
    return weights.join(demand.groupBy("cell_id").agg(F.sum("value").alias("demand")), "cell_id")


def utilization(weights: DataFrame, state: DataFrame) -> DataFrame:
    """U_j = A_j * sum_i P_i w_ij^2 / sum_k A_k w_ik of facilities with pairs: choice, times weight, gathered, with a cell's denominator summed once.

    weights: (cell_id, facility_id, weight, demand). state: (facility_id, attractiveness).
    """
    a, w = F.col("attractiveness"), F.col("weight")
    pairs = weights.join(F.broadcast(state), "facility_id").withColumn("den", F.sum(a * w).over(Window.partitionBy("cell_id"))).filter("den > 0")
    return pairs.groupBy("facility_id").agg(F.coalesce(F.sum(F.col("demand") / F.col("den") * w * w * a), F.lit(0.0)).alias("utilization"))


def ifca(spark: SparkSession, distance: DataFrame, demand: DataFrame, supply: DataFrame, decay_params: dict[str, Any] | None = None, lam: float = 0.5, max_iter: int = 100, tolerance: float = 1e-6, window_size: int = 5, convergence_type: str = "utilization", fast: bool = False, layers: Sequence[Any] | None = None, validate: bool = True) -> AccessResult:
    """supply: (facility_id, supply). demand: (cell_id, value), or with a
    ``layer`` column and ``layers``, one for each iteration.

    Facilities without supply stand aside and come back with zeros. fast: at
    most max_iter updates, the first difference is skipped, no history is
    kept. Else: at most max_iter-1 updates, differences in utilization or
    ratio start from zero, and ``iterations["history"]`` has a row for each
    step and facility. Both stop when the mean of the last window_size
    differences, of a window that starts as zeros, is at most tolerance.
    """
    params = dict(decay_params) if decay_params is not None else {"method": "gaussian", "sigma": 30}
    check_range(lam, 0, 1, "lambda")
    for name, v in (("max_iter", max_iter), ("window_size", window_size)):
        check_integer(v, name)
        check_positive(v, name)
    check_positive(tolerance, "tolerance")
    check_choice(convergence_type, ("utilization", "ratio"), "convergence_type")
    if validate:
        check_columns(distance, ["cell_id", "facility_id", "value"], "distance")
        check_columns(demand, ["cell_id", "value"], "demand")
        check_columns(supply, ["facility_id", "supply"], "supply")
        check_unique_ids(supply, "facility_id", "supply")
        if layers is not None and len(layers) != max_iter:
            raise ValueError(f"demand must have 1 or {max_iter} layers")
    ids = supply.select("facility_id", F.col("supply").cast("double").alias("supply"))
    held = ids.filter("supply <> 0").toArrow()
    start = dict(zip(*(c.to_pylist() for c in held.columns), strict=True))  # the state: a number for each facility
    id_type = ids.schema["facility_id"].dataType.simpleString()
    weights = calc_decay(distance.select("cell_id", "facility_id", "value"), validate=validate, **params).join(ids.filter("supply <> 0").select("facility_id"), "facility_id", "left_semi").filter("weight IS NOT NULL")
    tasks = 2 * spark.sparkContext.defaultParallelism  # each sends a sum for each of its facilities: no more of them than keep the cores busy
    weights = weights.repartition(tasks, "cell_id").sortWithinPartitions("cell_id")
    weights = (with_demand(weights, demand) if layers is None else weights).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        a, u, r = dict(start), dict.fromkeys(start, 0.0), dict.fromkeys(start, 0.0)
        history = [(1, k, 0.0, 0.0, v) for k, v in start.items()]
        window, filled, step, diffs = [0.0] * window_size, False, 0 if fast else 1, []
        while step < max_iter and not (filled and sum(window) / window_size <= tolerance):
            step += 1
            pairs = weights if layers is None else with_demand(weights, demand.filter(F.col("layer") == F.lit(layers[step - 1 if fast else step - 2])))
            state = spark.createDataFrame(pa.table([held.column(0), pa.array([a[k] for k in start], pa.float64())], ["facility_id", "attractiveness"]))
            new_u = dict.fromkeys(start, 0.0) | dict(zip(*(c.to_pylist() for c in utilization(pairs, state).toArrow().columns), strict=True))
            new_r = {k: start[k] / v if v > 0 else 0.0 for k, v in new_u.items()}
            a = {k: (1 - lam) * v + lam * new_r[k] for k, v in a.items()}
            if not (fast and step == 1):
                old, new = (r, new_r) if convergence_type == "ratio" and not fast else (u, new_u)
                diff = max((abs(new[k] - old[k]) for k in new), default=0.0)
                diffs.append(diff)
                window[(step - 1) % window_size] = diff
            filled = filled or step >= window_size
            u, r = new_u, new_r
            if not fast:
                history += [(step, k, u[k], r[k], a[k]) for k in start]
        converged = filled and sum(window) / window_size <= tolerance
        if fast and not converged:
            warnings.warn(f"no convergence within {max_iter} iterations", stacklevel=2)
    finally:
        weights.unpersist()
    final = spark.createDataFrame([(k, u[k], r[k], a[k]) for k in start], f"facility_id {id_type}, utilization double, ratio double, attractiveness double")
    facilities = ids.join(final, "facility_id", "left").fillna(0.0, ["utilization", "ratio", "attractiveness"])
    full = calc_decay(distance.select("cell_id", "facility_id", "value"), validate=False, **params)
    access = spread_weighted(F.broadcast(facilities.select("facility_id", F.col("ratio").alias("accessibility"))), full, validate=False)  # what was on the driver
    states = spark.createDataFrame(history, f"iteration int, facility_id {id_type}, utilization double, ratio double, attractiveness double") if not fast else None
    info = {"iterations": step, "converged": converged, "tolerance": tolerance, "last_difference": diffs[-1] if diffs else None}
    if states is not None:
        info["history"] = states
    chosen = spread_weighted(facilities.filter("supply <> 0").select("facility_id", F.col("attractiveness").alias("den")), full, validate=False)
    probs = full.join(facilities.filter("supply <> 0").select("facility_id", "attractiveness"), "facility_id").join(chosen.filter("den > 0"), "cell_id").select("cell_id", "facility_id", (F.col("weight") * F.col("attractiveness") / F.col("den") * F.col("weight")).alias("probability"))
    return AccessResult(access, "iFCA", {"decay_params": params, "lambda": lam, "max_iter": max_iter, "window_size": window_size, "convergence_type": convergence_type}, facilities, info, call="ifca", extra={"util_probs": probs})
