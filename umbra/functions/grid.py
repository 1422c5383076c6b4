"""Georeferenced grids: north-up square cells, rows to the south, columns to the east."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    x_min: float
    y_max: float
    res: float
    rows: int
    cols: int

    @classmethod
    def covering(cls, x_min: float, y_min: float, x_max: float, y_max: float, res: float) -> Grid:
        return cls(x_min, y_max, res, math.ceil((y_max - y_min) / res), math.ceil((x_max - x_min) / res))

    def padded(self, distance: float) -> Grid:
        """The grid with the cells that a ray of this length can reach around it."""
        n = math.ceil(distance / self.res)
        return Grid(self.x_min - n * self.res, self.y_max + n * self.res, self.res, self.rows + 2 * n, self.cols + 2 * n)

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y_max) - y) / F.lit(self.res)).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x_min)) / F.lit(self.res)).cast("int")

    def center_x(self, col: Column) -> Column:
        return F.lit(self.x_min) + (col + F.lit(0.5)) * F.lit(self.res)

    def center_y(self, row: Column) -> Column:
        return F.lit(self.y_max) - (row + F.lit(0.5)) * F.lit(self.res)

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.rows) & (col >= 0) & (col < self.cols)

    def cells(self, spark) -> DataFrame:
        """Every (row, col)."""
        n = F.col("id")
        return spark.range(self.rows * self.cols).select(F.floor(n / self.cols).cast("int").alias("row"), (n % self.cols).cast("int").alias("col"))


def locate(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Points with their (row, col); those outside the half-open grid, NaN or infinite, are dropped."""
    finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))
    on_grid = (F.col(x) >= grid.x_min) & (F.col(x) < grid.x_min + grid.cols * grid.res) & (F.col(y) > grid.y_max - grid.rows * grid.res) & (F.col(y) <= grid.y_max)
    placed = points.where(finite & on_grid).withColumn("row", grid.row(F.col(y))).withColumn("col", grid.col(F.col(x)))
    return placed.where(grid.inside(F.col("row"), F.col("col")))


def tile_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("int")


def snap_bounds(x_min: Column, y_min: Column, x_max: Column, y_max: Column, step: float) -> list[Column]:
    """A box grown outward to a lattice."""
    down = lambda v: F.floor(v / step) * F.lit(float(step))
    up = lambda v: F.ceil(v / step) * F.lit(float(step))
    return [down(x_min), down(y_min), up(x_max), up(y_max)]
