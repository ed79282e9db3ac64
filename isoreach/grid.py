"""Raster geometry kept on the driver: 1-based, row-major cell numbers from the top left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    nrows: int
    ncols: int
    xmin: float = 0.0
    xmax: float = 1.0
    ymin: float = 0.0
    ymax: float = 1.0
    crs: str = ""

    @property
    def ncell(self) -> int:
        return self.nrows * self.ncols

    @property
    def xres(self) -> float:
        return (self.xmax - self.xmin) / self.ncols

    @property
    def yres(self) -> float:
        return (self.ymax - self.ymin) / self.nrows

    def row(self, cell: Column) -> Column:
        """0-based row."""
        return F.floor((cell - 1) / self.ncols).cast("long")

    def col(self, cell: Column) -> Column:
        """0-based column."""
        return F.pmod(cell - 1, F.lit(self.ncols)).cast("long")

    def cell(self, row: Column, col: Column) -> Column:
        return (row * self.ncols + col + 1).cast("long")

    def x(self, cell: Column) -> Column:
        return F.lit(self.xmin) + (self.col(cell) + 0.5) * self.xres

    def y(self, cell: Column) -> Column:
        return F.lit(self.ymax) - (self.row(cell) + 0.5) * self.yres

    def cell_at(self, x: Column, y: Column) -> Column:
        """The cell that holds a point; NULL outside. Points on the right or lower edge belong to the last cell."""
        inside = (x >= self.xmin) & (x <= self.xmax) & (y >= self.ymin) & (y <= self.ymax)
        c = F.least(F.floor((x - self.xmin) / self.xres), F.lit(self.ncols - 1))
        r = F.least(F.floor((F.lit(self.ymax) - y) / self.yres), F.lit(self.nrows - 1))
        return F.when(inside, self.cell(r, c))

    def coarser(self, factor: int) -> GridSpec:
        rows, cols = -(-self.nrows // factor), -(-self.ncols // factor)
        return GridSpec(rows, cols, self.xmin, self.xmin + cols * factor * self.xres, self.ymax - rows * factor * self.yres, self.ymax, self.crs)


def to_grid(df: DataFrame, grid: GridSpec, value: str = "value"):
    """A surface as a NumPy matrix for plotting. The result has grid.ncell numbers, so it suits maps, not pair tables."""
    import numpy as np

    out = np.full(grid.ncell, np.nan)
    rows = df.select("cell_id", value).toPandas()
    out[rows["cell_id"].to_numpy() - 1] = rows[value].to_numpy(dtype=float)
    return out.reshape(grid.nrows, grid.ncols)
