"""Floating catchment area models composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.checks import check_choice, check_columns, check_length, check_numeric, check_positive, check_unique_ids
from isoreach.functions.decay import calc_decay
from isoreach.functions.numeric import safe_ratio
from isoreach.operators.flow import gather_demand, spread_weighted
from isoreach.operators.normalize import calc_normalize


@dataclass(frozen=True)
class AccessResult:
    accessibility: DataFrame
    type: str
    parameters: dict[str, Any]
    facilities: DataFrame
    iterations: dict[str, Any] | None = None
    variations: Any = None
    call: str = ""
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.accessibility is None:
            raise ValueError("accessibility results required")
        check_columns(self.accessibility, ["cell_id"], "accessibility")

    def __str__(self) -> str:
        from isoreach.operators.summary import format_result

        return format_result(self)


def prepare_supply(supply: DataFrame, id_col: str = "facility_id", supply_cols: Sequence[str] | None = None, validate: bool = True) -> tuple[DataFrame, list[str]]:
    """(facility_id, measures as doubles) and the measures."""
    cols = list(supply_cols) if supply_cols is not None else [c for c in supply.columns if c != id_col]
    if validate:
        check_columns(supply, [id_col, *cols], "supply")
        check_unique_ids(supply, id_col, "supply")
    return supply.select(F.col(id_col).alias("facility_id"), *[F.col(c).cast("double").alias(c) for c in cols]), cols


def compute_access(demand: DataFrame, supply: DataFrame, demand_weights: DataFrame, access_weights: DataFrame | None = None, id_col: str = "facility_id", supply_cols: Sequence[str] | None = None, indicator_names: Sequence[str] | None = None, validate: bool = True) -> DataFrame:
    """Gather demand, divide supply by it, spread the ratio: (cell_id, a column for each measure).

    A facility of the weights that supply lacks is an error in the ratio's
    place, not a silent loss: with validate its id is looked for.
    """
    supply, cols = prepare_supply(supply, id_col, supply_cols, validate)
    if indicator_names is not None:
        check_length(indicator_names, len(cols), "indicator_names")
    if validate and demand_weights.select("facility_id").distinct().join(supply, "facility_id", "left_anti").limit(1).count():
        raise ValueError("Some weight layer IDs not found in supply data")
    names = list(indicator_names) if indicator_names is not None else cols
    gathered = gather_demand(demand, demand_weights, validate)
    j = supply.join(gathered.withColumnRenamed("location_id", "facility_id"), "facility_id")
    ratios = j.select("facility_id", *[safe_ratio(F.col(c), F.col("potential_demand")).alias(n) for c, n in zip(cols, names, strict=True)])
    return spread_weighted(ratios, demand_weights if access_weights is None else access_weights, names, validate=validate)


def e2sfca(demand: DataFrame, supply: DataFrame, distance: DataFrame, decay_params: dict[str, Any] | None = None, demand_normalize: str = "identity", id_col: str = "facility_id", supply_cols: Sequence[str] | None = None, indicator_names: Sequence[str] | None = None, validate: bool = True) -> AccessResult:
    """Enhanced two-step floating catchment area (Luo & Qi 2009).

    Demand is gathered by normalised weights, access is spread by the decay
    weights as they are.
    """
    params = dict(decay_params) if decay_params is not None else {"method": "gaussian", "sigma": 30}
    if params.get("method") is None:
        raise ValueError("decay_params must have a method")
    check_choice(demand_normalize, ("identity", "standard", "semi"), "demand_normalize")
    if validate:
        check_columns(demand, ["cell_id", "value"], "demand")
        check_columns(distance, ["cell_id", "facility_id", "value"], "distance")
    weights = calc_decay(distance.select("cell_id", "facility_id", "value"), validate=validate, **params)
    normalized = calc_normalize(weights, demand_normalize, validate=validate)
    access = compute_access(demand, supply, normalized, weights, id_col, supply_cols, indicator_names, validate)
    facilities, _ = prepare_supply(supply, id_col, supply_cols, False)
    return AccessResult(access, "E2SFCA", {"decay_params": params, "demand_normalize": demand_normalize}, facilities, call="e2sfca")


def two_sfca(demand: DataFrame, supply: DataFrame, distance: DataFrame, threshold: float, id_col: str = "facility_id", supply_cols: Sequence[str] | None = None, validate: bool = True) -> AccessResult:
    """Two-step floating catchment area (Luo & Wang 2003): 0 outside all catchments, missing where no distance is known."""
    check_numeric(threshold, "threshold")
    check_positive(threshold, "threshold")
    r = e2sfca(demand, supply, distance, {"method": "binary", "sigma": threshold}, "identity", id_col, supply_cols, validate=validate)
    return AccessResult(r.accessibility, "2SFCA", r.parameters, r.facilities, call="two_sfca")


DecayMethod = str | Callable[..., Column]
