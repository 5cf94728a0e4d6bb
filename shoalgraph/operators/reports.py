"""New records: constraints, gazetteer look-ups and safe appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgraph.functions.text import not_blank, strip
from shoalgraph.session import shared_folder

EARTH_KM = 6371.0
#: Gazetteer rows up to which it is broadcast (counted first).
BROADCAST_PLACES = 200_000


def checked(reports: DataFrame, this_year: Column | None = None) -> DataFrame:
    """Adds reason: null for a good record, else what is out of range."""
    now = F.year(F.current_date()) if this_year is None else this_year
    reason = F.when(~F.coalesce(F.col("lng").between(-180, 180), F.lit(False)), "lng").when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "lat").when(~F.coalesce((F.col("year") >= 1900) & (F.col("year") <= now), F.lit(False)), "year")
    return reports.withColumn("reason", reason)


def user_record(rows: DataFrame) -> DataFrame:
    """Report rows in the shape of occurrences: count 1, source UserInput, no administrative fields."""
    none = F.lit(None).cast("string")
    return rows.select("species_label", "lng", "lat", "year", none.alias("province"), none.alias("city"), none.alias("district"), "address", F.lit(1).alias("count"), F.lit("UserInput").alias("data_source"))


def with_reports(points: DataFrame, reports: DataFrame) -> DataFrame:
    """Union by column name; columns that one side lacks are null."""
    return points.unionByName(reports, allowMissingColumns=True)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES else df


def forward(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of addresses by trimmed name; null where the name is unknown, blank ones are left out."""
    asked = addresses.where(not_blank(F.col("address"))).withColumn("_name", strip(F.col("address")))
    places = gazetteer.select(F.col("name").alias("_place"), F.col("lng").alias("found_lng"), F.col("lat").alias("found_lat"))
    return asked.join(_small(places), F.col("_name") == F.col("_place"), "left").drop("_name", "_place")


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def reverse(points: DataFrame, gazetteer: DataFrame, id_col: str, degrees: float = 10.0) -> DataFrame:
    """Nearest gazetteer place of each point with coordinates (ties by name); null without any place.

    Points and places meet on grid cells (a place is copied to its 9 neighbouring cells, and across the date line), so
    neither side is joined with all of the other. A point whose nearest place so found may not be the nearest, as the window
    reaches less far, is searched again with a window of twice the side, until none is left; the last window is the globe.
    """
    places = gazetteer.dropna(subset=["lng", "lat"]).select(F.col("name").alias("place"), F.col("lng").alias("place_lng"), F.col("lat").alias("place_lat"))
    left, done = points.dropna(subset=["lng", "lat"]).select(id_col, "lng", "lat"), None
    shared_folder(points.sparkSession)
    while True:
        degrees = min(degrees, 180.0)
        found = _within(left, places, id_col, degrees)
        # the least distance of a place outside the window: that of the meridian on its side
        reach = EARTH_KM * F.asin(F.sin(F.radians(F.lit(min(degrees, 90.0)))) * F.cos(F.radians("lat")))
        proven = F.coalesce(F.col("km") <= reach, F.lit(False)) if degrees < 180 else F.lit(True)
        found = found.withColumn("proven", proven).checkpoint(eager=True)
        settled = found.where("proven").select(id_col, "place", "km")
        done = settled if done is None else done.unionByName(settled)
        left = found.where("not proven").select(id_col, "lng", "lat")
        if degrees == 180 or left.isEmpty():
            return done
        degrees *= 2


def _within(at: DataFrame, places: DataFrame, id_col: str, degrees: float) -> DataFrame:
    """(id, lng, lat, place, km): the nearest place within ``degrees`` of latitude and longitude."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / degrees)
    turns = places.withColumn("place_lng", F.explode(F.transform(F.array(*map(F.lit, (-360, 0, 360))), lambda t: F.col("place_lng") + t)))
    copies = turns.where(F.abs("place_lng") <= 180 + degrees).withColumn("d", F.explode(near))
    copies = copies.withColumn("_i", cell("place_lng") + F.col("d.i")).withColumn("_j", cell("place_lat") + F.col("d.j")).drop("d")
    asked = at.withColumn("_pi", cell("lng")).withColumn("_pj", cell("lat"))
    close = (F.abs(F.col("lng") - F.col("place_lng")) <= degrees) & (F.abs(F.col("lat") - F.col("place_lat")) <= degrees)
    both = asked.join(_small(copies), (F.col("_pi") == F.col("_i")) & (F.col("_pj") == F.col("_j")) & close, "left")
    km = haversine_km(F.col("lng"), F.col("lat"), F.col("place_lng"), F.col("place_lat"))
    best = F.min(F.when(F.col("place").isNotNull(), F.struct(F.round(km, 6).alias("km"), F.col("place").alias("place"))))
    return both.groupBy(id_col, "lng", "lat").agg(best.alias("b")).select(id_col, "lng", "lat", F.col("b.place").alias("place"), F.col("b.km").alias("km"))
