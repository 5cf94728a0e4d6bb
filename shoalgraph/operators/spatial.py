"""Points in polygons.

A polygon is a set of directed edges; even-odd crossing parity over all rings of a part handles holes,
points on an edge are outside, and a point in several regions gives several rows. Points and regions meet on grid
cells: a region has a tile for each cell that its bounding box touches, with only those edges that can cross a ray to the east
from there, so parity is computed in the row that the cell's match made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges and tiles up to which the tiles are broadcast (counted first); beyond it they are shuffled by cell.
BROADCAST_EDGES, BROADCAST_TILES = 200_000, 100_000
#: Tiles that all regions together may have, or so many for each region, before cells are made larger.
MOST_TILES, EACH = 1_000_000, 4


def region_table(edges: DataFrame) -> DataFrame:
    """One row for each region and part: bounding box and edges."""
    return edges.groupBy("region", "part").agg(
        F.min(F.least("x1", "x2")).alias("x_lo"),
        F.max(F.greatest("x1", "x2")).alias("x_hi"),
        F.min(F.least("y1", "y2")).alias("y_lo"),
        F.max(F.greatest("y1", "y2")).alias("y_hi"),
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("sides"),
    )


def inside(x: Column, y: Column, sides: Column) -> Column:
    """Strictly inside: an odd number of edges is crossed by the ray to the east, and no edge holds the point."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"])

    def holds(e: Column) -> Column:
        on_line = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        return on_line & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return (F.size(F.filter(sides, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1) & ~F.exists(sides, holds)


def tiles(regions: DataFrame, cell: float) -> DataFrame:
    """(i, j, region, box, sides) for each cell that a region's box touches and some of its edges can matter in."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cut = regions.withColumn("_i", F.explode(span("x_lo", "x_hi"))).withColumn("_j", F.explode(span("y_lo", "y_hi")))
    west, south = F.col("_i") * F.lit(cell), F.col("_j") * F.lit(cell)
    near = lambda e: (F.greatest(e["x1"], e["x2"]) >= west) & (F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= south + F.lit(cell))
    return cut.withColumn("sides", F.filter("sides", near)).where(F.size("sides") > 0)


def points_in_regions(points: DataFrame, edges: DataFrame, strategy: str = "auto", cell: float = 1.0) -> DataFrame:
    """Left join: columns of points and province_name, null where no region holds the point.

    The join is on grid cells of side ``cell``, or of a side doubled until all regions have a bounded number of
    tiles. strategy: "broadcast" sends the tiles to every task, "grid" leaves that to the planner, which shuffles both sides by cell
    where they are large (adaptive execution splits crowded cells); "auto" counts edges and tiles and broadcasts within fixed bounds.
    """
    regions = region_table(edges)
    wide, high = F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")
    sums = regions.agg(F.count("*").alias("n"), F.sum(wide * high).alias("area"), F.sum(wide + high).alias("rim"), F.sum(F.size("sides")).alias("edges")).first()
    if not sums["n"]:
        return points.withColumn("province_name", F.lit(None).cast("string"))
    number = lambda: sums["area"] / cell**2 + sums["rim"] / cell + sums["n"]
    while number() > max(MOST_TILES, EACH * sums["n"]):
        cell *= 2
    if strategy == "auto":
        strategy = "broadcast" if sums["edges"] <= BROADCAST_EDGES and number() <= BROADCAST_TILES else "grid"
    box = F.col("lng").between(F.col("x_lo"), F.col("x_hi")) & F.col("lat").between(F.col("y_lo"), F.col("y_hi"))
    within = box & inside(F.col("lng"), F.col("lat"), F.col("sides"))
    placed = points.withColumn("_pi", F.floor(F.col("lng") / cell)).withColumn("_pj", F.floor(F.col("lat") / cell))
    tiled = tiles(regions, cell)
    tiled = F.broadcast(tiled) if strategy == "broadcast" else tiled
    joined = placed.join(tiled, (F.col("_pi") == F.col("_i")) & (F.col("_pj") == F.col("_j")) & within, "left")
    return joined.select(*points.columns, F.col("region").alias("province_name"))


def admin_levels(points: DataFrame, id_col: str, levels: dict[str, DataFrame]) -> DataFrame:
    """The points with a column for each level (name: its region edges): the region that holds the point, the first by name of
    several, null without one. Points without coordinates stay, with nulls. ``id_col`` tells the points apart."""
    out = points
    for name, edges in levels.items():
        found = points_in_regions(points.select(id_col, "lng", "lat").dropna(subset=["lng", "lat"]), edges)
        found = found.where("province_name is not null").groupBy(id_col).agg(F.min("province_name").alias(name))
        out = out.drop(name).join(found, id_col, "left")
    return out


def merged_points(*parts: DataFrame) -> DataFrame:
    """One row for each (species_label, lng, lat, year) of all parts with coordinates: administrative fields and source by the
    first name, count the sum (a missing one counts 1). Our definition of the compact merge."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    have = [F.min(c).alias(c) for c in ("province", "city", "district", "data_source") if c in out.columns]
    count = F.coalesce(F.col("count"), F.lit(1)) if "count" in out.columns else F.lit(1)
    return out.dropna(subset=["lng", "lat"]).groupBy("species_label", "lng", "lat", "year").agg(*have, F.sum(count).cast("long").alias("count"))


def with_admin(points: DataFrame, id_col: str, levels: dict[str, DataFrame]) -> DataFrame:
    """Points whose administrative fields are those stored or, where they are null, those of the regions."""
    stored = {c: f"_stored_{c}" for c in levels if c in points.columns}
    found = admin_levels(points.withColumnsRenamed(stored), id_col, levels)
    return found.withColumns({c: F.coalesce(F.col(s), F.col(c)) for c, s in stored.items()}).drop(*stored.values())


def valid_points(points: DataFrame, species: str | None = None) -> DataFrame:
    """Points of one species (or all) with both coordinates; the filter reaches the scan."""
    own = points if species is None else points.where(F.col("species_label") == species)
    return own.dropna(subset=["lng", "lat"])


def province_counts(joined: DataFrame) -> DataFrame:
    return joined.where("province_name is not null").groupBy("province_name").agg(F.count("*").alias("counts"))


def simplify(edges: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on each ring (optional preprocessing): places within ``tolerance`` of a chord go, rings stay closed."""
    import pandas as pd

    def run(ring: "pd.DataFrame") -> "pd.DataFrame":
        ring = ring.sort_values("seq")
        pts = list(zip(ring["x1"], ring["y1"], strict=True))
        if len(pts) < 4:
            return ring
        loop = [*pts, pts[0]]
        far = max(range(1, len(pts)), key=lambda k: (loop[k][0] - loop[0][0]) ** 2 + (loop[k][1] - loop[0][1]) ** 2)
        keep, todo = {0, far, len(pts)}, [(0, far), (far, len(pts))]
        while todo:
            a, b = todo.pop()
            (ax, ay), (bx, by) = loop[a], loop[b]
            long = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 or 1e-300
            off = [(abs((bx - ax) * (ay - loop[k][1]) - (ax - loop[k][0]) * (by - ay)) / long, k) for k in range(a + 1, b)]
            if off and max(off)[0] > tolerance:
                k = max(off)[1]
                keep.add(k)
                todo += [(a, k), (k, b)]
        kept = [loop[k] for k in sorted(keep)]
        if len(kept) < 4:
            return ring
        rows = [(ring["region"].iloc[0], ring["part"].iloc[0], ring["ring"].iloc[0], k, *kept[k], *kept[k + 1]) for k in range(len(kept) - 1)]
        return pd.DataFrame(rows, columns=list(ring.columns))

    order = ["region", "part", "ring", "seq", "x1", "y1", "x2", "y2"]
    return edges.select(*order).groupBy("region", "part", "ring").applyInPandas(run, edges.select(*order).schema)
