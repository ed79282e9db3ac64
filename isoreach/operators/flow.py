"""Gather (cells to facilities) and spread (facilities to cells)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.checks import check_aligned, check_columns
from isoreach.functions.numeric import clean
from isoreach.grid import GridSpec


def _weighted(strict_cells: int | None, product: Column) -> Column:
    if strict_cells is None:
        return F.coalesce(F.sum(product), F.lit(0.0))
    return F.when(F.count(product) == strict_cells, F.sum(product))


def gather_weighted(values: DataFrame, weights: DataFrame, na_rm: bool = True, layers: Sequence[str] | None = None, grid: GridSpec | None = None, weights_grid: GridSpec | None = None, simplify: bool = False, validate: bool = True) -> DataFrame | dict:
    """U_j = sum_i v_i * w_ij.

    One layer: (unit_id, weighted_sum). With a ``layer`` column in values:
    unit_id and ``<layer>_weighted_sum`` for each of ``layers`` in one pass.
    Every facility of ``weights`` comes back. With na_rm a pair with a missing
    side is skipped and a facility without pairs gets 0; without it any missing
    pair makes the sum NULL, counted against grid.ncell. simplify: a dict on
    the driver, of one number or list of numbers for each facility.
    """
    if validate:
        check_columns(values, ["cell_id", "value"], "values")
        check_columns(weights, ["cell_id", "facility_id", "weight"], "weights")
        check_aligned(grid, weights_grid, "values", "weights")
        if not na_rm and grid is None:
            raise ValueError("na_rm=False needs grid, whose cells are counted")
    n = None if na_rm else grid.ncell
    if "layer" in values.columns:
        layers = list(layers) if layers is not None else sorted(r[0] for r in values.select("layer").distinct().collect())
        # a row for each cell: the pairs then meet each cell once, however many layers there are
        wide = values.groupBy("cell_id").pivot("layer", layers).agg(F.first("value"))
        sums = [_weighted(n, clean(F.col(f"`{k}`") * F.col("weight"))).alias(f"{k}_weighted_sum") for k in layers]
    else:
        wide = values.select("cell_id", "value")
        sums = [_weighted(n, clean(F.col("value") * F.col("weight"))).alias("weighted_sum")]
    out = weights.join(wide, "cell_id", "left").groupBy(F.col("facility_id").alias("unit_id")).agg(*sums)
    if simplify:
        return {r[0]: r[1] if len(r) == 2 else list(r[1:]) for r in out.collect()}
    return out


def gather_demand(demand: DataFrame, weights: DataFrame, validate: bool = True) -> DataFrame:
    """gather_weighted of one layer as (location_id, potential_demand).

    Weights are probabilities. The range rides along with the sums as an
    assertion, so the check costs no pass of its own.
    """
    if validate:
        check_columns(demand, ["cell_id", "value"], "demand")
        check_columns(weights, ["cell_id", "facility_id", "weight"], "weights")
    w = F.col("weight")
    bad = "weights must contain probability values between 0 and 1"
    total = F.coalesce(F.sum(clean(F.col("value") * w)), F.lit(0.0))
    out = weights.join(demand.select("cell_id", "value"), "cell_id", "left").groupBy(F.col("facility_id").alias("location_id")).agg(total.alias("potential_demand"), F.min(clean(w)).alias("__lo"), F.max(clean(w)).alias("__hi"))
    checked = F.when((F.col("__lo") < 0) | (F.col("__hi") > 1), F.raise_error(F.lit(bad)).cast("double")).otherwise(F.col("potential_demand"))
    return out.select("location_id", checked.alias("potential_demand"))


def spread_weighted(values: DataFrame, weights: DataFrame, value_cols: Sequence[str] | None = None, name_prefix: str | None = None, full_output: bool = False, validate: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """A_i = sum_j r_j * w_ij for each measure column, in one aggregation.

    values: (facility_id, measures). full_output: also the products before the
    sum, as (cell_id, facility_id, measures): (total_distribution,
    unit_distribution). A cell whose products are all missing gets NULL.
    """
    cols = list(value_cols) if value_cols is not None else [c for c in values.columns if c != "facility_id"]
    if validate:
        check_columns(values, ["facility_id", *cols], "values")
        check_columns(weights, ["cell_id", "facility_id", "weight"], "weights")
    named = {c: f"{name_prefix or ''}{c}" for c in cols}
    rates = values.select("facility_id", *[F.col(c).cast("double").alias(f"__r{i}") for i, c in enumerate(cols)])
    pairs = weights.select("cell_id", "facility_id", "weight").join(rates, "facility_id")
    products = [clean(F.col(f"__r{i}") * F.col("weight")) for i in range(len(cols))]
    total = pairs.groupBy("cell_id").agg(*[F.sum(p).alias(named[c]) for p, c in zip(products, cols, strict=True)])
    if not full_output:
        return total
    return total, pairs.select("cell_id", "facility_id", *[p.alias(named[c]) for p, c in zip(products, cols, strict=True)])
