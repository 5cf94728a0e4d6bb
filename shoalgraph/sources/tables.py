"""Readers and sinks with the tolerance rules of the domain's files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgraph import schemas
from shoalgraph.functions.text import na_to_null

#: The file that names the folder of the graph as it is now.
CURRENT = "CURRENT"


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Occurrence points with a fixed schema; quoted line feeds and doubled quotes are read."""
    return spark.read.schema(schemas.OCCURRENCES).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def empty_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.OCCURRENCES)


def guarded(spark: SparkSession, path: str, read=points_csv) -> tuple[DataFrame, str | None]:
    """The table, or an empty one and a message if the path is missing."""
    try:
        return read(spark, path), None
    except AnalysisException as e:
        return empty_points(spark), f"cannot read {path}: {e.getCondition()}"


def species_labels(points: DataFrame) -> DataFrame:
    return points.where("species_label is not null").select("species_label").distinct().orderBy("species_label")


ROWS = ", ".join(f"`{c}` string" for c in schemas.TRIPLES) + ", file_name string, row_index long"
REJECTS = "file_name string, row_index long, reason string"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, header) of each file: its first line that isn't blank, without a byte-order mark."""
    lines = spark.read.option("pathGlobFilter", "*.csv").option("ignoreMissingFiles", True).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), at.alias("at"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    return lines.where(F.col("at.block") == 0).where(F.trim("value") != "").groupBy("path", "file_name").agg(F.min_by("value", "at").alias("header"))


def of_header(spark: SparkSession, header: str, files: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files (path, name) that all have this header, by one reader."""
    names = [c.strip().strip('"').strip() for c in header.split(",")]
    missing = [c for c in ("Entity1", "Entity2", "Relationship", "Property") if c not in names]
    if missing:
        return spark.createDataFrame([], ROWS), spark.createDataFrame([(name, None, f"no column {missing[0]}") for _, name in files], REJECTS)
    wide = ", ".join(f"`c{k}` string" for k in range(len(names))) + ", _corrupt_record string"
    reader = spark.read.schema(wide).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    raw = reader.csv([path for path, _ in files], header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=True)
    raw = raw.select("*", F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("row_index"))  # a file with multi-line fields is one split
    commas = F.length(F.regexp_replace(F.regexp_replace("_corrupt_record", '"[^"]*"', ""), "[^,]", ""))
    read_too = F.coalesce(F.length("c0"), F.lit(0)) >= 0  # always so; a query of the corrupt-record column alone is refused
    long = F.coalesce(commas >= len(names), F.lit(False)) & read_too
    have = {n: f"c{k}" for k, n in reversed(list(enumerate(names)))}
    columns = [(na_to_null(F.col(have[c])) if c in have else F.lit(None).cast("string")).alias(c) for c in schemas.TRIPLES]
    return raw.where(~long).select(*columns, "file_name", "row_index"), raw.where(long).select("file_name", "row_index", F.lit("too many fields").alias("reason"))


def triple_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the *.csv files at a path, each read by its own header; files of equal headers share a reader.

    Short rows are padded, over-long ones rejected; texts that mean null become null; missing optional columns are null. A file
    without Entity1, Entity2, Relationship or Property is rejected whole, one that turns unreadable while it is read gives no
    more rows, and an empty one none.
    """
    groups: dict[str, list[tuple[str, str]]] = {}
    for r in headers(spark, path).orderBy("path").collect():  # a row for each file
        groups.setdefault(r["header"], []).append((r["path"], r["file_name"]))
    rows, bad = [spark.createDataFrame([], ROWS)], [spark.createDataFrame([], REJECTS)]
    for header, files in groups.items():
        good, poor = of_header(spark, header, files)
        rows.append(good)
        bad.append(poor)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(rows), union(bad)


triple_folder = triple_csv


def regions_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the polygons of a GeoJSON file; coordinates stay text until the geometry's type is known."""
    found = spark.read.option("multiLine", True).schema(schemas.GEOJSON).json(path).select(F.explode("features").alias("f"))
    shape = found.select(F.col("f.properties")["name"].alias("region"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    ring = "array<array<array<double>>>"
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", ring))).when(F.col("type") == "MultiPolygon", F.from_json("c", f"array<{ring}>"))
    rings = shape.select("region", F.posexplode(parts).alias("part", "rings")).select("region", "part", F.posexplode("rings").alias("ring", "points"))
    sides = rings.select("region", "part", "ring", "points", F.posexplode(F.slice("points", F.lit(1), F.size("points") - 1)).alias("seq", "p"))
    q = F.get("points", F.col("seq") + 1)
    return sides.select("region", "part", "ring", "seq", F.col("p")[0].alias("x1"), F.col("p")[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"))


def ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """(row, col, value) cells of an .asc grid and its header values; rows are counted from the top, blank lines don't count.

    Lines are numbered by partition and place there, so the file may lie in any number of splits.
    """
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).where(F.length(F.trim("value")) > 0)
    is_head = F.col("value").rlike("^\\s*[A-Za-z]")
    pair = F.regexp_extract("value", "^\\s*(\\S+)\\s+(\\S+)", 1), F.regexp_extract("value", "^\\s*(\\S+)\\s+(\\S+)", 2)
    head = {r["k"].lower(): float(r["v"]) for r in lines.where(is_head).select(pair[0].alias("k"), pair[1].alias("v")).collect()}
    body = lines.where(~is_head).withColumn("part", F.shiftright("id", 33))
    counts = body.groupBy("part").agg(F.count("*").alias("n"))  # a row for each split
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    numbered = body.withColumn("within", within).join(F.broadcast(before), "part")
    cells = numbered.select((F.col("before") + F.col("within")).cast("int").alias("row"), F.posexplode(F.split(F.trim("value"), "\\s+")).alias("col", "v"))
    return cells.select("row", "col", F.col("v").cast("double").alias("value")), head


def raster_path(have: list[str], stem: str) -> str | None:
    """The .tif if there is one, else the .asc, else none."""
    return next((p for p in (f"{stem}.tif", f"{stem}.asc") if p in have), None)


def _files(spark: SparkSession, folder: str):
    """Hadoop's file context of a folder, and a function that makes its paths."""
    jvm = spark._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    root = path(CURRENT)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), path, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Replaces the graph; empty tables replace it by an empty graph.

    Both tables are written into a folder of a new name first; the file that names the graph's folder is then replaced in one
    step. A reader sees the old graph or the new one, and a failed write leaves the old one. The graph before the one that
    was replaced is deleted.
    """
    spark = nodes.sparkSession
    name = f"graph-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{folder}/{name}/nodes")
    edges.write.parquet(f"{folder}/{name}/edges")
    context, path, fs = _files(spark, folder)
    old = current_graph(spark, folder) if fs.exists(path(CURRENT)) else None
    out = fs.create(path(f"{name}.new"), True)
    out.write(bytearray(name.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{name}.new"), path(CURRENT), replace)
    for status in fs.listStatus(path("")) if old else ():
        if status.getPath().getName().startswith("graph-") and status.getPath().getName() not in (old, name):
            fs.delete(status.getPath(), True)


def current_graph(spark: SparkSession, folder: str) -> str:
    return spark.read.text(f"{folder}/{CURRENT}", wholetext=True).first()["value"]


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    at = f"{folder}/{current_graph(spark, folder)}"
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")


def append_records(rows: DataFrame, path: str) -> None:
    """Appends; files that exist are never rewritten."""
    rows.write.mode("append").partitionBy("species_label").parquet(path)
