"""Probability surfaces and reproducible Monte-Carlo demand.

Random numbers are md5 of (seed, iteration, k), so a draw depends on neither
the partitioning nor the engine, and a lost task repeats it exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoreach.checks import check_choice, check_columns, check_greater_equal, check_integer, check_numeric, check_positive, check_range


def transform_pmf(x: DataFrame, return_total: bool = False, validate: bool = True) -> DataFrame | tuple[DataFrame, float]:
    """value / sum over all cells; missing cells stay missing.

    With validate one aggregate looks for surfaces that are all missing,
    negative or zero; without it the total is joined as a single row.
    """
    check_columns(x, ["cell_id", "value"], "x")
    if not (validate or return_total):
        total = F.broadcast(x.agg(F.sum("value").cast("double").alias("__t")))
        return x.crossJoin(total).withColumn("value", F.when(F.col("__t") != 0, F.col("value") / F.col("__t"))).drop("__t")
    n, low, total = x.agg(F.count("value"), F.min("value"), F.sum("value").cast("double")).first()
    if not n:
        raise ValueError("x contains only NA values")
    if low < 0:
        raise ValueError("values in x must be >= 0")
    if total == 0:
        raise ValueError("Sum of all values in 'x' is zero")
    out = x.withColumn("value", F.col("value") / F.lit(total))
    return (out, total) if return_total else out


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by '-': 52 bits, 13 hex digits."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _uniform(*parts: object) -> float:
    """uniform() on the driver, of a number for each iteration."""
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def _invert(u: float, log_first: float, ratio: Callable[[int], float], mean: float, top: float = math.inf) -> int:
    """The least k whose probabilities of 0 to k exceed u; each is the one before times ratio(k). Probabilities that underflow at 0 are summed from logarithms."""
    k, log_p, total = 0, log_first, math.exp(log_first)
    while total <= u and k < top and not (k > mean and math.exp(log_p) < 1e-18):
        k += 1
        log_p += math.log(ratio(k)) if ratio(k) > 0 else -math.inf
        total += math.exp(log_p)
    return k


def cumulative(x: DataFrame, col: str = "value", blocks: int = 64) -> DataFrame:
    """(cell_id, lo, hi): running sums by cell_id.

    Two levels: cells are dealt to blocks by range, each block is summed, and
    the few block sums are run on their own; no window spans the table.
    """
    low, high = x.agg(F.min("cell_id"), F.max("cell_id")).first()
    if low is None:
        return x.select("cell_id", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).limit(0)
    width = (high - low) // blocks + 1
    b = x.filter(F.col(col) > 0).withColumn("__b", F.floor((F.col("cell_id") - low) / width))
    tops = b.groupBy("__b").agg(F.sum(col).alias("__s"))  # at most `blocks` rows
    before = tops.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    run = F.sum(col).over(Window.partitionBy("__b").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, 0))
    hi = (F.col("__before") + F.col("__run")).cast("double")
    return b.join(F.broadcast(before), "__b").withColumn("__run", run).select("cell_id", (hi - F.col(col)).alias("lo"), hi.alias("hi"))


def locate(points: DataFrame, cum: DataFrame, total: float, buckets: int = 1024) -> DataFrame:
    """Give each point (u) the cell whose [lo, hi) holds u*total: an equi-join on buckets of the range, then the bounds."""
    width = total / buckets
    spans = F.sequence(F.floor(F.col("lo") / width).cast("int"), F.floor(F.col("hi") / width).cast("int"))
    cells = cum.withColumn("__k", F.explode(spans))
    p = points.withColumn("__x", F.col("u") * total).withColumn("__k", F.floor(F.col("__x") / width).cast("int"))
    return p.join(cells, "__k").filter((F.col("lo") <= F.col("__x")) & (F.col("__x") < F.col("hi"))).drop("__k", "__x", "lo", "hi", "u")


def sample_sizes(iterations: int, n: int | None = None, size: int | None = None, prob: float | None = None, method: str | Callable[..., Sequence[int]] = "poisson", seed: int = 0, **kwargs) -> list[int]:
    """How many points each iteration draws; n comes first. One number for each iteration, on the driver.

    Random sizes come by inversion from the md5 of (seed, "size", iteration),
    so any engine that has md5 draws the same.
    """
    if n is not None:
        return [int(n)] * iterations
    if callable(method):
        out = list(method(**kwargs))
        if len(out) != iterations or any(v < 0 or not float(v).is_integer() for v in out):
            raise ValueError(f"the size function must return {iterations} non-negative integers")
        return [int(v) for v in out]
    check_choice(method, ("poisson", "binomial", "nbinom"), "method")
    if size is None or prob is None:
        raise ValueError("size and prob are needed where n is not given")
    us = [_uniform(seed, "size", t) for t in range(1, iterations + 1)]
    if size == 0 or (prob == 0 and method != "nbinom"):
        return [0] * iterations
    if method == "poisson":
        m = size * prob
        return [_invert(u, -m, lambda k: m / k, m) for u in us]
    if method == "binomial":
        if prob == 1:
            return [size] * iterations
        odds = prob / (1 - prob)
        return [_invert(u, size * math.log1p(-prob), lambda k: odds * (size - k + 1) / k, size * prob, size) for u in us]
    if prob == 0:
        raise ValueError("a negative binomial size needs a prob above 0")
    return [_invert(u, size * math.log(prob), lambda k: (1 - prob) * (size + k - 1) / k, size * (1 - prob) / prob) for u in us]


def evolving_sizes(sizes: Sequence[int], evolve_prop: float) -> list[tuple[int, int]]:
    """(new, old) of each iteration; halves round to even."""
    out, last = [], 0
    for n in sizes:
        old = min(round(last * (1 - evolve_prop)), n)
        out.append((n - old, old))
        last = n
    return out


def sample_pmf(spark: SparkSession, x: DataFrame, n: int | None = None, size: int | None = None, prob: float | None = None, method: str | Callable[..., Sequence[int]] = "poisson", iterations: int = 1, evolve_prop: float = 1.0, seed: int = 0, replace_0: bool = True, buckets: int = 1024, **kwargs) -> DataFrame:
    """Counts (iteration, cell_id, count) of points drawn with replacement by weight.

    x: a PMF or any surface of weights >= 0; it is scaled by its own total.
    Iteration t keeps round(n_{t-1} * (1-evolve_prop)) points of t-1, drawn
    without replacement, and adds new ones. evolve_prop 0 gives one iteration
    and a warning. replace_0: cells without points have no row; else a zero.
    A draw of no points has no rows.
    """
    check_columns(x, ["cell_id", "value"], "x")
    for name, v in (("iterations", iterations), ("n", n), ("size", size)):
        if v is not None:
            check_integer(v, name)
    check_positive(iterations, "iterations")
    if prob is not None:
        check_numeric(prob, "prob")
        check_range(prob, 0, 1, "prob")
    check_range(evolve_prop, 0, 1, "evolve_prop")
    if n is not None:
        check_greater_equal(n, 0, "n")
    if evolve_prop == 0 and iterations > 1:
        import warnings

        warnings.warn("evolve_prop is 0: one iteration is drawn", stacklevel=2)
        iterations = 1
    _, total = transform_pmf(x, return_total=True)
    sizes = sample_sizes(iterations, n, size, prob, method, seed, **kwargs)
    cum = cumulative(x)
    parts = evolving_sizes(sizes, evolve_prop)
    plan = spark.createDataFrame([(t + 1, new) for t, (new, _) in enumerate(parts) if new > 0] or [(0, 0)], "iteration int, new long").filter("new > 0")
    points = plan.select("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new") - 1)).alias("k"))
    if sum(new for new, _ in parts) > 1_000_000:
        points = points.repartition("iteration", "k")
    fresh = locate(points.withColumn("u", uniform(F.lit(seed), F.col("iteration"), F.col("k"))), cum, total, buckets)
    drawn = fresh if evolve_prop == 1 or iterations == 1 else _evolve(spark, fresh, parts, seed)
    counts = drawn.groupBy("iteration", "cell_id").agg(F.count("*").alias("count"))
    if replace_0:
        return counts
    cells = x.filter("value IS NOT NULL").select("cell_id", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    return cells.join(counts, ["iteration", "cell_id"], "left").select("iteration", "cell_id", F.coalesce("count", F.lit(0)).alias("count"))


def _checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder in local mode and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return d or "/tmp/isoreach-checkpoint"


def _evolve(spark: SparkSession, fresh: DataFrame, parts: Sequence[tuple[int, int]], seed: int) -> DataFrame:
    """Points of all iterations. Kept ones are the first of t-1 by md5; a point is named by where it was drawn."""
    fresh = fresh.select("iteration", "cell_id", F.concat_ws(":", "iteration", "k").alias("point"))
    now, out = None, None
    for t, (_, old) in enumerate(parts, 1):
        new = fresh.filter(F.col("iteration") == t)
        if now is not None and old:
            rank = F.md5(F.concat_ws("-", F.lit(seed), F.lit(t), F.col("point")))
            kept = now.orderBy(rank, "point").limit(old).withColumn("iteration", F.lit(t))
            new = new.unionByName(kept)
        if t % 20 == 0:
            if not spark.sparkContext.getCheckpointDir():
                spark.sparkContext.setCheckpointDir(_checkpoint_dir(spark))
            new = new.checkpoint()
        now, out = new, new if out is None else out.unionByName(new)
    return out
