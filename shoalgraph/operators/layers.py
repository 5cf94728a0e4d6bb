"""Map layers as DataFrames; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph import literals


def centre(points: DataFrame) -> DataFrame:
    """Mean latitude and longitude of valid points, the default centre without any, and their number."""
    lat, lng = literals.DEFAULT_CENTRE
    return points.agg(F.coalesce(F.avg("lat"), F.lit(lat)).alias("lat"), F.coalesce(F.avg("lng"), F.lit(lng)).alias("lng"), F.count("*").alias("n"))


def scatter(points: DataFrame) -> DataFrame:
    return points.select("lat", "lng")


def heat(points: DataFrame) -> DataFrame:
    return points.select(F.array("lat", "lng").alias("position"))


def popups(joined: DataFrame) -> DataFrame:
    """Marker positions with a popup of province and coordinates to four places; a null province stays null."""
    return joined.select("lat", "lng", "province_name", F.format_string("%.4f, %.4f", "lng", "lat").alias("popup"))


def grid(points: DataFrame, side: float) -> DataFrame:
    """Points for each grid cell of the given side (for clusters and heat surfaces)."""
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).alias(f"{c}_cell")
    return points.groupBy(cell("lng"), cell("lat")).agg(F.count("*").alias("n"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))


def choropleth(regions: DataFrame, counts: DataFrame, bins: int = 6) -> DataFrame:
    """All region names with their count (null without one) and an equal-width class from 1 to ``bins``.

    counts has a row for each region at most, so its range is a small aggregate, joined back by broadcast.
    """
    bounds = counts.agg(F.min("counts").alias("lo"), F.max("counts").alias("hi"))
    joined = regions.select("name").distinct().join(counts, F.col("name") == F.col("province_name"), "left").crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_ = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("counts") - F.col("lo")) / width) + 1, F.lit(bins)))
    return joined.select("name", "counts", F.when(F.col("counts").isNotNull(), bin_.cast("int")).alias("bin"))
