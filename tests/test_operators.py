"""Spatial, graph, layer, raster, chat, report and source operators on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shoalgraph import literals, schemas
from shoalgraph.operators import chat, graph, layers, raster, reports, spatial
from shoalgraph.sources import tables


def ring(region, part, k, pts):
    return [(region, part, k, i, float(x), float(y), float(u), float(v)) for i, ((x, y), (u, v)) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]


SHAPES = (
    ring("hole", 0, 0, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring("hole", 0, 1, [(3, 3), (6, 3), (6, 6), (3, 6)])
    + ring("two", 0, 0, [(20, 0), (25, 0), (20, 5)]) + ring("two", 1, 0, [(30, 0), (33, 1), (31, 4)]) + ring("over", 0, 0, [(5, 5), (15, 5), (15, 15), (5, 15)])
)


def brute(x, y):
    found = []
    for key in {(e[0], e[1]) for e in SHAPES}:
        sides = [e[4:] for e in SHAPES if (e[0], e[1]) == key]
        on = any((c - a) * (y - b) == (d - b) * (x - a) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d) for a, b, c, d in sides)
        odd = sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in sides) % 2
        if odd and not on:
            found.append(key[0])
    return sorted(found)


@pytest.mark.parametrize("strategy", ["broadcast", "grid", "auto"])
def test_points_in_regions(spark, strategy):
    r = random.Random(5)
    pts = [(k, r.randrange(0, 70) / 2, r.randrange(0, 32) / 2) for k in range(400)]
    joined = spatial.points_in_regions(spark.createDataFrame(pts, "id long, lng double, lat double"), spark.createDataFrame(SHAPES, schemas.EDGES), strategy, 3.0)
    got = {}
    for row in joined.collect():
        got.setdefault(row.id, []).append(row.province_name)
    for k, x, y in pts:
        assert sorted(n for n in got[k] if n) == brute(x, y), (x, y)
        assert len(got[k]) == max(1, len(brute(x, y)))


def test_simplify_keeps_shape(spark):
    dense = ring("r", 0, 0, [(x, 0) for x in range(10)] + [(10, y) for y in range(10)] + [(x, 10) for x in range(10, 0, -1)] + [(0, y) for y in range(10, 0, -1)])
    out = spatial.simplify(spark.createDataFrame(dense, schemas.EDGES), 0.001).orderBy("seq").collect()
    assert len(out) == 4
    assert {(r.x1, r.y1) for r in out} == {(0, 0), (10, 0), (10, 10), (0, 10)}


TRIPLES = "Entity1 string, Relationship string, Entity2 string, Property string, species_source string, file_name string, row_index long"


def test_graph_merge(spark):
    rows = [
        ("a", "CAUSES", "b", "a=1;b=1", None, "f1", 1), ("a", "causes ", "b", "b=2", None, "f1", 2), ("a", "CAUSES", "b", "a=9", None, "f0", 5), ("x事件", "DURING", "1999", None, "福寿螺", "f1", 3),
        ("c", "BELONGS_TO", "a", "=v", None, "f1", 4), (None, "CAUSES", "b", None, None, "f1", 6), ("a", "NOPE", "b", None, None, "f1", 7), ("a", "HAS_HABIT", "a", None, " ", "f1", 8),
        ("甲事件", "CAUSES", "乙事件", None, "大鳄龟", "f1", 9),
    ]
    df = graph.prepared(spark.createDataFrame(rows, TRIPLES))
    good = graph.accepted(df)
    assert sorted((r.row_index, r.reason) for r in graph.rejects(df).collect()) == [(4, "empty property name"), (6, "null entity"), (7, "unknown relation")]
    merged = {(r.src_name, r.rel, r.dst_name): r.props for r in graph.edges_with_props(good).collect()}
    assert merged[("a", "CAUSES", "b")] == {"a": "1", "b": "2"}
    assert merged[("福寿螺", "HAS_EVENT", "x事件")] == {}
    assert ("大鳄龟", "HAS_EVENT", "甲事件") in merged and ("大鳄龟", "HAS_EVENT", "乙事件") not in merged
    names = {(r.label, r.name) for r in graph.nodes(good).collect()}
    assert ("Species", "a") in names and ("Habit", "a") in names
    twice = graph.accepted(graph.prepared(spark.createDataFrame(rows + rows, TRIPLES)))
    assert graph.nodes(twice).count() == len(names) and graph.edges(twice).count() == len(merged)
    assert graph.upsert(graph.nodes(good), graph.nodes(twice), ["label", "name"]).isEmpty()
    nan = graph.accepted(graph.prepared(spark.createDataFrame([("x", "DURING", "1", None, None, "f", 1)], TRIPLES), nan_source=True))
    assert [r.src_name for r in graph.event_edges(nan).collect()] == ["nan"]


def test_patterns(spark):
    g = spark.createDataFrame([("District", "d", "LOCATED_IN", "City", "c"), ("City", "c", "LOCATED_IN", "Province", "p"), ("Province", "p", "REPORTED_IN", "Species", "s"), ("District", "e", "LOCATED_IN", "District", "e")], "src_label string, src_name string, rel string, dst_label string, dst_name string")
    got = {(r.start, r.name): r.depth for r in graph.reach(g, "LOCATED_IN", graph.nodes_of(g, "District"), 0, 2).collect()}
    assert got == {("d", "d"): 0, ("d", "c"): 1, ("d", "p"): 2, ("e", "e"): 0}
    assert {tuple(r) for r in graph.admin_rollup(g).collect()} == {("d", "c", "p"), ("e", None, None)}
    verdicts = {r.start: r.verdict for r in graph.checked_patterns(g, literals.graph_schema(spark)).where("type = 'REPORTED_IN'").collect()}
    assert verdicts == {"Province": "reversed"}


def test_layers(spark):
    none = spark.createDataFrame([], "lat double, lng double")
    assert tuple(layers.centre(none).first()) == (35.0, 105.0, 0)
    counts = spark.createDataFrame([("a", 1), ("b", 7), ("c", 4)], "province_name string, counts long")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "name string")
    assert {r.name: r.bin for r in layers.choropleth(names, counts).collect()} == {"a": 1, "b": 6, "c": 4, "z": None}


def test_raster(spark, tmp_path):
    path = tmp_path / "g.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n0 1 -9999\n2 4 3\n")
    cells, head = tables.ascii_grid(spark, str(path))
    assert head["nodata_value"] == -9999 and cells.count() == 6
    got = {(r.row, r.col): (r.scaled, r.alpha) for r in raster.alpha(raster.scaled(raster.masked(cells, head["nodata_value"]))).collect()}
    assert got[(0, 2)] == (None, 0.0) and got[(1, 1)] == (1.0, 0.7) and got[(0, 0)] == (0.0, 0.7)
    flat = raster.scaled(spark.createDataFrame([(0, 0, 5.0), (0, 1, float("nan"))], "row int, col int, value double").transform(raster.masked, None))
    assert {r.scaled for r in flat.collect()} == {None}
    low = raster.coloured(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "scaled double")).collect()
    assert [round(r.r * 255) for r in low] == [0xFF, 0xFD, 0xE3]
    assert raster.image_bounds(1, 2, 3, 4) == [[2, 1], [4, 3]]


def test_chat(spark):
    pool = literals.questions(spark, "福寿螺")
    last = pool.limit(2)
    assert chat.suggestions(pool, last).join(last, "label", "left_semi").isEmpty()
    assert chat.suggestions(pool.where("position < 3"), last).count() == 2
    log = spark.createDataFrame([(literals.NO_QUERY,), (" ",), ("MATCH",), (None,)], "cypher string")
    assert [r.show_details for r in chat.detail_flags(log).collect()] == [False, False, True, False]
    answers = spark.createDataFrame([('{"intermediate_steps":[{"query":"q"},{"context":[1]}]}',), ("{}",)], "response string")
    assert [(r.cypher, r.context) for r in chat.unpacked(answers).collect()] == [("q", "[1]"), (literals.NO_QUERY, "[]")]
    clicks = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (1, 3, None, 1.0), (1, 4, 1.0, 1.0)], "u int, n int, lat double, lng double")
    assert sorted(r.n for r in chat.changed_clicks(clicks, "u", "n").collect()) == [1, 3, 4]
    both = chat.appended(log, spark.createDataFrame([("c", "x")], "cypher string, image string"))
    assert both.where("image is null").count() == 4
    files = spark.createDataFrame([("file:/d/images/福寿螺.jpg",)], "path string")
    assert [r.species for r in chat.with_images(spark.createDataFrame([("福寿螺",), ("x",)], "species string"), files).collect()] == ["福寿螺"]
    turn = spark.createDataFrame([("nothing", "about 福寿螺"), ("大鳄龟 and 福寿螺", "x")], "answer string, prompt string")
    assert [r.species for r in chat.spotted_in_either(turn, ["福寿螺", "大鳄龟"]).collect()] == ["福寿螺", "大鳄龟"]
    assert chat.random_pick(pool, 3).count() == 1


def test_reports(spark):
    rows = spark.createDataFrame([(1, 200.0, 0.0, 2000), (2, 0.0, -91.0, 2000), (3, 0.0, 0.0, 1899), (4, 0.0, 0.0, 3000), (5, 0.0, 0.0, 2000), (6, None, 0.0, 2000)], "id int, lng double, lat double, year int")
    assert [r.reason for r in reports.checked(rows, F.lit(2026)).orderBy("id").collect()] == ["lng", "lat", "year", "year", None, "lng"]
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 0.0)], "name string, lng double, lat double")
    found = {r.id: r.place for r in reports.reverse(spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 90.0, 80.0)], "id int, lng double, lat double"), places, "id").collect()}
    assert found == {1: "a", 2: "b", 3: "b"}
    r = random.Random(3)
    where = lambda: (r.uniform(-180, 180), r.uniform(-90, 90))
    there, here = [(f"p{k}", *where()) for k in range(30)], [(k, *where()) for k in range(150)] + [(200, 179.9, 1.0), (201, None, 1.0)]
    there.append(("line", -179.9, 1.0))
    rad = math.radians
    km = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(rad(b[2] - a[2]) / 2) ** 2 + math.cos(rad(a[2])) * math.cos(rad(b[2])) * math.sin(rad(b[1] - a[1]) / 2) ** 2))
    near = reports.reverse(spark.createDataFrame(here, "id int, lng double, lat double"), spark.createDataFrame(there, "name string, lng double, lat double"), "id", 5.0)
    assert {x.id: x.place for x in near.collect()} == {h[0]: min(there, key=lambda t: km(h, t))[0] for h in here if h[1] is not None}
    assert reports.reverse(rows, places.limit(0), "id").where("place is not null").isEmpty()


def test_admin_fields(spark):
    squares = lambda side: [e for i in range(4) for e in ring(f"s{side}-{i}", 0, 0, [(side * i, 0), (side * i + side, 0), (side * i + side, 9), (side * i, 9)])]
    levels = {"province": spark.createDataFrame(squares(4), schemas.EDGES), "city": spark.createDataFrame(squares(2), schemas.EDGES)}
    pts = spark.createDataFrame([(1, 1.0, 1.0, "stored"), (2, 5.0, 1.0, None), (3, 50.0, 1.0, None), (4, None, 1.0, None)], "id int, lng double, lat double, city string")
    got = {r.id: (r.province, r.city) for r in spatial.with_admin(pts, "id", levels).collect()}
    assert got == {1: ("s4-0", "stored"), 2: ("s4-1", "s2-2"), 3: (None, None), 4: (None, None)}
    both = spatial.merged_points(*[spark.createDataFrame([("a", 1.0, 1.0, 2000, n, p)], "species_label string, lng double, lat double, year int, count int, province string") for n, p in ((2, None), (None, "x"))])
    assert [(r.province, r["count"]) for r in both.collect()] == [("x", 3)]
    assert spatial.points_in_regions(pts, levels["city"].limit(0)).where("province_name is not null").isEmpty()


def test_files_of_many_splits(spark, tmp_path):
    path = tmp_path / "big.asc"
    path.write_text("ncols 2\nnrows 4000\nnodata_value -9999\n\n" + "".join(f"{k} {-k}\n" + "\n" * (k % 3 == 0) for k in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells, _ = tables.ascii_grid(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
        assert cells.count() == 8000 and cells.where("value != row * (1 - 2 * col)").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_graph_is_replaced_in_one_step(spark, tmp_path):
    g = lambda name: spark.createDataFrame([("Species", name)], "label string, name string")
    folder = str(tmp_path / "graph")
    for name in "abc":
        tables.write_graph(g(name), g(name), folder)
        assert [r.name for r in tables.read_graph(spark, folder)[0].collect()] == [name]
    broken = g("d").withColumn("name", F.raise_error(F.lit("no"))) if hasattr(F, "raise_error") else None
    with pytest.raises(Exception, match="no"):
        tables.write_graph(g("d"), broken, folder)
    assert [r.name for r in tables.read_graph(spark, folder)[0].collect()] == ["c"]


def test_sources(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.csv").write_bytes("﻿Entity1 ,Relationship,Entity2,Property\nx,CAUSES,y,a=1\nx,CAUSES\n1,2,3,4,5\n\"q\"\"uo\nte\",CAUSES,NA,\nlong,CAUSES,y,,\n".encode())
    (folder / "b.csv").write_text("Entity2,Entity1,Relationship,Property,species_source\nB,A,CAUSES,,s\n")
    (folder / "c.csv").write_text("Nope,Relationship\n1,2\n")
    (folder / "d.csv").write_text("Entity1,Entity2,Relationship\n1,2,CAUSES\n")
    (folder / "skip.txt").write_text("x")
    rows, bad = tables.triple_folder(spark, str(folder))
    got = {(r.file_name, r.Entity1, r.Entity2, r.species_source) for r in rows.collect()}
    assert got == {("a.csv", "x", "y", None), ("a.csv", "x", None, None), ("a.csv", 'q"uo\nte', None, None), ("b.csv", "A", "B", "s")}
    assert sorted((r.file_name, r.reason) for r in bad.collect()) == [("a.csv", "too many fields"), ("a.csv", "too many fields"), ("c.csv", "no column Entity1"), ("d.csv", "no column Property")]
    empty, message = tables.guarded(spark, str(tmp_path / "none.csv"))
    assert empty.isEmpty() and message
    (tmp_path / "p.csv").write_text("species_label,lng,lat,year,province,city,district,address,count,data_source\na,1.5,2,2000,,,,,1,GBIF\nb,,2,2000,,,,,1,GBIF\n")
    points = tables.points_csv(spark, str(tmp_path / "p.csv"))
    assert spatial.valid_points(points).count() == 1 and [r[0] for r in tables.species_labels(points).collect()] == ["a", "b"]
    tables.append_records(points, str(tmp_path / "table"))
    tables.append_records(points, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    (tmp_path / "r.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"m"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[0,1],[0,0]]],[[[5,5],[6,5],[5,6],[5,5]]]]}},{"type":"Feature","properties":{"name":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]],[[2,1],[3,1],[3,2],[2,1]]]}}]}')
    edges = tables.regions_geojson(spark, str(tmp_path / "r.json"))
    assert {(r.region, r.part, r.ring): r["count"] for r in edges.groupBy("region", "part", "ring").count().collect()} == {("m", 0, 0): 3, ("m", 1, 0): 3, ("p", 0, 0): 3, ("p", 0, 1): 3}
    assert tables.raster_path(["a.asc", "a.tif"], "a") == "a.tif" and tables.raster_path([], "a") is None
    g = spark.createDataFrame([("Species", "a")], "label string, name string")
    tables.write_graph(g, g, str(tmp_path / "graph"))
    tables.write_graph(g.limit(0), g.limit(0), str(tmp_path / "graph"))
    assert tables.read_graph(spark, str(tmp_path / "graph"))[0].isEmpty()


def test_stream(spark, tmp_path):
    from shoalgraph.streaming.reports import stream_reports

    good = tables.empty_points(spark).unionByName(spark.createDataFrame([("a", 1.0, 2.0, 2000), ("a", 999.0, 2.0, 2000)], "species_label string, lng double, lat double, year int"), allowMissingColumns=True)
    good.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
