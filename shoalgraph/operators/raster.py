"""Grids as long tables (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph import literals


def masked(cells: DataFrame, nodata: float | None) -> DataFrame:
    """No-data cells and NaN as null."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return cells.withColumn("value", v if nodata is None else F.when(v != nodata, v))


def extremes(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))


def scaled(cells: DataFrame) -> DataFrame:
    """Adds scaled (0 to 1; null for no data and for a flat grid)."""
    both = cells.crossJoin(F.broadcast(extremes(cells)))
    return both.withColumn("scaled", F.try_divide(F.col("value") - F.col("vmin"), F.col("vmax") - F.col("vmin"))).drop("vmin", "vmax")


def alpha(cells: DataFrame) -> DataFrame:
    return cells.withColumn("alpha", F.when(F.col("value").isNull(), 0.0).otherwise(0.7))


def coloured(cells: DataFrame) -> DataFrame:
    """Adds r, g, b (0 to 1) between the legend's colours, piecewise linear over scaled."""
    stops = [[int(c[k : k + 2], 16) / 255 for k in (1, 3, 5)] for c in literals.LEGEND]
    s = F.col("scaled")
    for k, name in enumerate("rgb"):
        low, mid, high = (x[k] for x in stops)
        cells = cells.withColumn(name, F.when(s <= 0.5, low + (mid - low) * (s / 0.5)).otherwise(mid + (high - mid) * ((s - 0.5) / 0.5)))
    return cells


def image_bounds(left: float, bottom: float, right: float, top: float) -> list[list[float]]:
    return [[bottom, left], [top, right]]
