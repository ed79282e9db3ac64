"""Statistics of results, and their text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions.numeric import clean
from isoreach.grid import GridSpec


def measure_stats(df: DataFrame, measures: Sequence[str], ncell: int | None = None, quantiles: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """A row for each measure: min, max, mean, sd (n-1), interpolated quantiles, covered and total cells.

    One pass: the measures are stacked, so the rows to aggregate are counted
    once each and the result is one row for each measure. ncell is the cells
    of the grid; rows of df where it is not given.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), clean(F.col(m)).alias("v")) for m in measures]))
    long = df.select(stack.alias("s")).select("s.*")
    q = [F.percentile("v", F.lit(float(p))).alias(f"q{round(100 * p):02d}") for p in quantiles]
    total = F.lit(ncell) if ncell is not None else F.count("*")
    return long.groupBy("measure").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), *q, F.count("v").alias("covered"), total.cast("long").alias("cells")).withColumn("coverage", F.col("covered") / F.col("cells"))


def facility_stats(facilities: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A row for each supply column: min, max, mean, sd, total."""
    cols = list(cols) if cols is not None else [c for c, t in facilities.dtypes if c not in ("id", "facility_id") and t in ("double", "float", "int", "bigint")]
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), clean(F.col(m)).alias("v")) for m in cols]))
    return facilities.select(stack.alias("s")).select("s.*").groupBy("measure").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.sum("v").alias("total"))


def summarize(result: Any, grid: GridSpec | None = None, quantiles: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> dict[str, Any]:
    """accessibility and facilities as DataFrames, model_specific as a dict."""
    measures = [c for c in result.accessibility.columns if c != "cell_id"]
    return {"type": result.type, "parameters": result.parameters, "accessibility": measure_stats(result.accessibility, measures, grid.ncell if grid else None, quantiles), "facilities": facility_stats(result.facilities), "model_specific": result.iterations or {}}


def _line(row, digits: int) -> str:
    return "  " + ", ".join(f"{k}: {v:.{digits}g}" if isinstance(v, (int, float)) else f"{k}: {v}" for k, v in row.asDict().items())


def format_summary(summary: dict[str, Any], digits: int = 4) -> str:
    """The text of a summary; it has a row for each measure and supply column only."""
    out = [f"Spatial accessibility, {summary['type']}", "Parameters:", *(f"  {k}: {v}" for k, v in summary["parameters"].items())]
    for part in ("accessibility", "facilities"):
        out += [f"{part.capitalize()}:", *(_line(r, digits) for r in summary[part].orderBy("measure").collect())]
    out += [f"  {k}: {v}" for k, v in summary["model_specific"].items() if not isinstance(v, DataFrame)]
    return "\n".join(out)


def format_result(result: Any) -> str:
    """A short text of a result; runs no job."""
    method = result.parameters.get("decay_params", {}).get("method", "-")
    shown = getattr(method, "__name__", method)
    return "\n".join([f"Spatial accessibility, {result.type}", f"  measures: {', '.join(c for c in result.accessibility.columns if c != 'cell_id')}", f"  decay: {shown}", f"  facility columns: {', '.join(result.facilities.columns)}"])
