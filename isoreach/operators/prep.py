"""What real inputs need before a model: rasters from points and zones, coarser grids, masks, zonal figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.checks import check_choice
from isoreach.grid import GridSpec


def block_aggregate(x: DataFrame, grid: GridSpec, factor: int, fun: str = "sum") -> DataFrame:
    """Blocks of factor x factor cells as one cell of grid.coarser(factor)."""
    check_choice(fun, ("sum", "mean", "min", "max"), "fun")
    to = grid.coarser(factor)
    cell = to.cell(F.floor(grid.row(F.col("cell_id")) / factor), F.floor(grid.col(F.col("cell_id")) / factor))
    agg = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[fun]
    return x.groupBy(cell.alias("cell_id")).agg(agg("value").alias("value"))


def rasterize_points(points: DataFrame, grid: GridSpec, value: str | None = None) -> DataFrame:
    """Sum (or count) of the points (x, y) of each cell; points outside are left out."""
    cell = grid.cell_at(F.col("x"), F.col("y"))
    p = points.select(cell.alias("cell_id"), (F.col(value) if value else F.lit(1.0)).alias("value")).filter("cell_id IS NOT NULL")
    return p.groupBy("cell_id").agg(F.sum("value").alias("value"))


def dealt(cells: DataFrame) -> DataFrame:
    """Cells over all cores by their id: a small file of them is one task, however many pairs they make."""
    return cells.repartition(4 * cells.sparkSession.sparkContext.defaultParallelism, "cell_id")


def rasterize_zones(tiles: DataFrame, values: DataFrame, by: str = "location_id", zone: str = "zone") -> DataFrame:
    """Sum of zone values over (cell_id, zone) tiles, a layer for each ``by``: (cell_id, facility_id, value).

    Both sides are summed for each zone before they meet, so that the layers of
    a cell in one zone are ready as they are made; only those of cells in
    several are summed once more.
    """
    sums = values.groupBy(zone, F.col(by).alias("facility_id")).agg(F.sum("value").alias("value"))
    to = sums.schema["value"].dataType
    each = dealt(tiles.select("cell_id", zone).filter(F.col(zone).isNotNull())).groupBy("cell_id", zone).agg(F.count("*").alias("__n"))
    each = each.withColumn("__zones", F.count("*").over(Window.partitionBy("cell_id")))

    def met(t: DataFrame) -> DataFrame:
        return t.join(sums, zone).select("cell_id", "facility_id", F.when(F.col("__n") == 1, F.col("value")).otherwise((F.col("value") * F.col("__n")).cast(to)).alias("value"))

    several = met(each.filter("__zones > 1")).groupBy("cell_id", "facility_id").agg(F.sum("value").cast(to).alias("value"))
    return met(each.filter("__zones = 1")).unionByName(several)


def density_to_count(x: DataFrame, cell_area: float) -> DataFrame:
    return x.withColumn("value", F.col("value") * F.lit(float(cell_area)))


def euclidean_distance(cells: DataFrame, facilities: DataFrame, max_distance: float) -> DataFrame:
    """(cell_id, facility_id, value) of pairs of (x, y) no further than max_distance.

    Both sides are dealt to squares of max_distance; a facility goes to the
    nine around its own, so pairs meet by an equi-join and not all with all.
    There are as many as lie near each other: where tables grow in one area,
    their number grows with the product of both.
    """
    sq = lambda c: F.floor(F.col(c) / F.lit(float(max_distance)))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    f = facilities.select("facility_id", F.col("x").alias("__x"), F.col("y").alias("__y"), sq("x").alias("__c"), sq("y").alias("__r"))
    f = f.withColumn("__dc", F.explode(near)).withColumn("__dr", F.explode(near)).withColumn("__c", F.col("__c") + F.col("__dc")).withColumn("__r", F.col("__r") + F.col("__dr"))
    c = dealt(cells).select("cell_id", "x", "y", sq("x").alias("__c"), sq("y").alias("__r"))
    d = F.sqrt(F.pow(F.col("x") - F.col("__x"), 2) + F.pow(F.col("y") - F.col("__y"), 2))
    return c.join(f, ["__c", "__r"]).select("cell_id", "facility_id", d.alias("value")).filter(F.col("value") <= max_distance)


def mask(x: DataFrame, inside: DataFrame) -> DataFrame:
    return x.join(inside.select("cell_id"), "cell_id", "left_semi")


def missing_in_mask(x: DataFrame, inside: DataFrame) -> DataFrame:
    """The cells of a mask without a value."""
    return inside.select("cell_id").join(x.filter("value IS NOT NULL").select("cell_id"), "cell_id", "left_anti")


def zonal(x: DataFrame, zones: DataFrame, fun: str = "mean", value: str = "value") -> DataFrame:
    check_choice(fun, ("sum", "mean", "count"), "fun")
    agg = {"sum": F.sum, "mean": F.avg, "count": F.count}[fun]
    return x.join(zones, "cell_id").groupBy("zone").agg(agg(value).alias(fun))


def midpoint(df: DataFrame, low: str = "isomin", high: str = "isomax", out: str = "iso_mean") -> DataFrame:
    return df.withColumn(out, (F.col(low) + F.col(high)) / 2)


def attach(df: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    return df.join(attributes, key, "left")


def map_algebra(a: DataFrame, b: DataFrame, fun=lambda x, y: x * y) -> DataFrame:
    """fun of the values of two surfaces where both have the cell."""
    right = b.select("cell_id", F.col("value").alias("__v"))
    return a.select("cell_id", "value").join(right, "cell_id").select("cell_id", fun(F.col("value"), F.col("__v")).alias("value"))


def stack_filter(pairs: DataFrame, least: float, col: str = "weight") -> DataFrame:
    """Cells whose layers sum to more than least."""
    return pairs.groupBy("cell_id").agg(F.sum(col).alias("value")).filter(F.col("value") > least)


def percent_difference(df: DataFrame, order: Column | str, value: str, out: str = "pct_diff") -> DataFrame:
    """Against the first row of a small report; all rows meet in one window."""
    first = F.first(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, (F.col(value) - first) / first * 100)
