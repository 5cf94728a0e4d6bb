"""The queries over the reference domain, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgraph import literals, schemas
from shoalgraph.functions import labels, props, text
from shoalgraph.operators import chat, graph, layers, raster, reports, spatial
from shoalgraph.plans import views
from shoalgraph.session import shared_folder
from shoalgraph.sources import tables
from shoalgraph.streaming.reports import stream_reports

SPECIES = "purchase"
NAMES = ["the", "and", "idiot", "der", "les", "que", "ing"]


def points(spark, sf, species=None):
    return spatial.valid_points(views.spark_view(spark, sf, views.POINTS), species)


def joined(spark, sf, species=None):
    return spatial.points_in_regions(points(spark, sf, species), views.spark_view(spark, sf, views.REGION_EDGES))


def triples(spark, sf):
    return views.spark_view(spark, sf, views.TRIPLES)


def rows(spark, sf):
    return graph.accepted(graph.prepared(triples(spark, sf)))


def ecograph(spark, sf):
    return views.spark_view(spark, sf, views.GRAPH)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def province_counts(spark, sf):
    return spatial.province_counts(joined(spark, sf, SPECIES)).orderBy(F.desc("counts"), "province_name")


def points_with_province(spark, sf):
    return joined(spark, sf).select("event_id", "species_label", "lng", "lat", "province_name")


def points_with_province_grid(spark, sf):
    found = spatial.points_in_regions(points(spark, sf), views.spark_view(spark, sf, views.REGION_EDGES), strategy="grid", cell=5.0)
    return found.select("event_id", "species_label", "lng", "lat", "province_name")


def province_choropleth(spark, sf):
    regions = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("name"))
    return layers.choropleth(regions, spatial.province_counts(joined(spark, sf, SPECIES)))


def species_list(spark, sf):
    return tables.species_labels(views.spark_view(spark, sf, views.POINTS))


def species_center(spark, sf):
    return rounded(layers.centre(points(spark, sf, SPECIES)), "lat", "lng")


def species_center_empty(spark, sf):
    return layers.centre(points(spark, sf, "no such species"))


def valid_point_count(spark, sf):
    return joined(spark, sf, SPECIES).agg(F.count("*").alias("n"))


def scatter_layer(spark, sf):
    return layers.scatter(points(spark, sf, SPECIES))


def heat_layer(spark, sf):
    at = layers.heat(points(spark, sf, SPECIES))
    return at.select(F.col("position")[0].alias("lat"), F.col("position")[1].alias("lng"))


def cluster_layer(spark, sf):
    return layers.popups(joined(spark, sf, SPECIES)).select("lat", "lng", "province_name", "popup")


def cluster_grid(spark, sf):
    return rounded(layers.grid(points(spark, sf), 5.0), "lng", "lat")


def strip_names(spark, sf):
    return triples(spark, sf).select("row_index", text.strip(F.col("Entity1")).alias("name"))


def relation_sanitize(spark, sf):
    return triples(spark, sf).select("row_index", text.relation(F.col("Relationship")).alias("rel"))


def label_sanitize(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    names = [F.lit(x) for x in [*literals.LABELS, "Unknown", "species"]]
    given = F.get(F.array(*names), F.pmod("c_custkey", F.lit(len(names))).cast("int"))
    return c.select("c_custkey", text.label(given).alias("label"))


def label_rows(spark, sf):
    return triples(spark, sf).select("row_index", text.strip(F.col("Entity1")).alias("a"), text.strip(F.col("Entity2")).alias("b"), text.relation(F.col("Relationship")).alias("rel"))


def geo_label(spark, sf):
    return label_rows(spark, sf).select("row_index", labels.geo_label(F.col("a")).alias("label"))


def source_label(spark, sf):
    return label_rows(spark, sf).where("a is not null").select("row_index", labels.source_label(F.col("a"), F.col("rel")).alias("label"))


def target_label(spark, sf):
    return label_rows(spark, sf).where("b is not null").select("row_index", labels.target_label(F.col("b"), F.col("rel")).alias("label"))


def prop_texts(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    made = F.concat(F.lit("qty="), F.col("l_linenumber"), F.lit("; flag = "), F.col("l_returnflag"), F.lit(" ;x;status="), F.when(F.col("l_linenumber") % 2 == 0, "NONE").otherwise("ok=1"), F.lit(";qty="), F.col("l_linenumber") + 1)
    return li.select("l_orderkey", "l_linenumber", made.alias("p"))


def parse_props(spark, sf):
    return prop_texts(spark, sf).select("l_orderkey", "l_linenumber", F.explode(props.parse_props(F.col("p"))).alias("x")).select("l_orderkey", "l_linenumber", "x.k", "x.v")


def normalize_props(spark, sf):
    pairs = props.normalize_props(props.parse_props(F.col("p")))
    return prop_texts(spark, sf).select("l_orderkey", "l_linenumber", F.explode(pairs).alias("x")).select("l_orderkey", "l_linenumber", "x.k", "x.v")


def triple_rejects(spark, sf):
    return graph.rejects(graph.prepared(triples(spark, sf)))


def graph_nodes(spark, sf):
    return graph.nodes(rows(spark, sf))


def graph_edges(spark, sf):
    return graph.edges(rows(spark, sf))


def edge_props(spark, sf):
    return graph.edge_props(rows(spark, sf))


def edge_prop_counts(spark, sf):
    return graph.edges_with_props(rows(spark, sf)).select(*graph.EDGE_KEY, F.size("props").alias("n_props"))


def event_edges(spark, sf):
    return graph.event_edges(rows(spark, sf))


def upsert_nodes(spark, sf):
    every = graph.nodes(rows(spark, sf))
    return graph.upsert(every.where("label != 'Event'"), every, ["label", "name"])


def match_1hop(spark, sf):
    return graph.hop(ecograph(spark, sf), "REPORTED_IN", "a").select(F.col("a_src_name").alias("species"), F.col("a_dst_name").alias("place"))


def match_2hop(spark, sf):
    return graph.path(ecograph(spark, sf), "HAS_EVENT", "DURING").select(F.col("a_src_name").alias("species"), F.col("a_dst_name").alias("event"), F.col("b_dst_name").alias("period"))


def optional_match(spark, sf):
    return graph.path(ecograph(spark, sf), "HAS_EVENT", "DURING", optional=True).select(F.col("a_src_name").alias("species"), F.col("a_dst_name").alias("event"), F.col("b_dst_name").alias("period"))


def multi_rel(spark, sf):
    g = ecograph(spark, sf).where(F.col("rel").isin("CAUSES", "PREYS_ON"))
    return g.groupBy("rel", "dst_name").agg(F.count("*").alias("n"))


def var_path(spark, sf):
    starts = graph.nodes_of(ecograph(spark, sf), "District")
    return graph.reach(ecograph(spark, sf), "LOCATED_IN", starts, 0, 2).select("start", "name", "depth")


def contains_match(spark, sf):
    return graph.names_like(graph.all_nodes(ecograph(spark, sf)), "AT")


def schema_valid(spark, sf):
    return graph.checked_patterns(ecograph(spark, sf), literals.graph_schema(spark))


def admin_rollup(spark, sf):
    return graph.admin_rollup(ecograph(spark, sf))


def intent_distribution(spark, sf):
    return graph.intent(ecograph(spark, sf), "distribution")


def intent_events(spark, sf):
    return graph.event_history(ecograph(spark, sf))


def intent_control(spark, sf):
    return graph.intent(ecograph(spark, sf), "control")


def intent_spread(spark, sf):
    return graph.intent(ecograph(spark, sf), "spread")


def intent_overview(spark, sf):
    return graph.canned(ecograph(spark, sf), "overview")


def intent_top(spark, sf):
    return graph.intent(ecograph(spark, sf), "pathway", limit=10)


def intent_context(spark, sf):
    return graph.as_context(graph.intent(ecograph(spark, sf), "alias").unionByName(graph.intent(ecograph(spark, sf), "taxonomy")).select("subject", "object"))


def cells(spark, sf):
    return raster.masked(views.raster(spark, sf), -9999.0)


def raster_minmax(spark, sf):
    return raster.extremes(cells(spark, sf))


def raster_norm(spark, sf):
    return rounded(raster.scaled(cells(spark, sf)).select("row", "col", "scaled"), "scaled")


def raster_alpha(spark, sf):
    return raster.alpha(cells(spark, sf)).select("row", "col", "alpha")


def raster_colour(spark, sf):
    return rounded(raster.coloured(raster.scaled(cells(spark, sf))).select("row", "col", "r", "g", "b"), "r", "g", "b")


def species_spotting(spark, sf):
    return chat.spotted(spark.read.parquet(f"{sf}/documents.parquet"), NAMES).select("doc_id", "species")


def chat_detail_flags(spark, sf):
    return chat.detail_flags(views.spark_view(spark, sf, views.CHAT)).select("conv_id", "turn", "show_details")


def chat_refresh(spark, sf):
    log = chat.spotted(views.spark_view(spark, sf, views.CHAT), NAMES, "content")
    return chat.refresh_turns(log).select("conv_id", "turn", "refresh")


def append_report(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS)
    new = p.withColumn("address", F.concat(F.lit("place "), F.col("event_id")))
    both = reports.with_reports(p.select("species_label", "lng", "lat", "year"), reports.user_record(new))
    return both.groupBy("species_label", "data_source").agg(F.count("*").alias("n"), F.sum("count").alias("reported"))


def report_checks(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS).select("event_id", (F.col("lng") * 4).alias("lng"), (F.col("lat") * 2).alias("lat"), (F.col("year") + 15).alias("year"))
    return reports.checked(p, F.lit(2030)).select("event_id", "reason")


def click_changes(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS)
    clicks = p.select("event_id", "user_id", F.floor(F.col("lng") / 20).alias("lng"), F.floor(F.col("lat") / 20).alias("lat"))
    return chat.changed_clicks(clicks, "user_id", "event_id").select("event_id", "user_id")


def suggestion_pool(spark, sf):
    pool = literals.questions(spark, "福寿螺")
    return chat.suggestions(pool, pool.where("position < 2"), n=3).select("position", "label", "prompt")


def suggestion_fallback(spark, sf):
    pool = literals.questions(spark, "福寿螺").where("position < 3")
    return chat.suggestions(pool, pool.where("position < 2"), n=3).select("position", "label", "prompt")


def gazetteer_forward(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    asked = s.select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, "nowhere").when(F.col("s_suppkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("n_name"), F.lit("　"))).alias("address"))
    return reports.forward(asked, views.spark_view(spark, sf, views.GAZETTEER)).select("s_suppkey", "found_lng", "found_lat")


def gazetteer_reverse(spark, sf):
    return reports.reverse(views.spark_view(spark, sf, views.POINTS), views.spark_view(spark, sf, views.GAZETTEER), "event_id").select("event_id", "place", F.round("km", 3).alias("km"))


def triples_dedup(spark, sf):
    t = triples(spark, sf)
    return graph.merged_triples(t, t.where("row_index % 2 = 0")).select(*schemas.TRIPLES)


def relation_split(spark, sf):
    near, far = graph.split_relations(triples(spark, sf), ["LOCATED_IN", "REPORTED_IN"])
    return near.withColumn("part", F.lit("place")).unionByName(far.withColumn("part", F.lit("other"))).select("row_index", "part")


def text_chunks(spark, sf):
    c = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(text.chunked(F.col("text"), 500, 50)).alias("chunk", "piece"))
    return c.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("digest"))


def species_dimension(spark, sf):
    return literals.species(spark)


def source_type_dimension(spark, sf):
    return literals.source_types(spark)


def relation_dimension(spark, sf):
    return literals.relations(spark)


def levels(spark, sf):
    return {"province": views.spark_view(spark, sf, views.REGION_EDGES), "city": views.spark_view(spark, sf, views.CITY_EDGES)}


def admin_levels(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS).select("event_id", "lng", "lat")
    return spatial.admin_levels(p, "event_id", levels(spark, sf)).select("event_id", "province", "city")


def points_with_admin(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS)
    stored = p.select("event_id", "lng", "lat", F.when(F.col("event_id") % 10 == 0, "stored").alias("city"))
    return spatial.with_admin(stored, "event_id", levels(spark, sf)).select("event_id", "province", "city")


def geocoded_admin(spark, sf):
    found = gazetteer_forward(spark, sf).select("s_suppkey", F.col("found_lng").alias("lng"), (F.col("found_lat") + 1).alias("lat"))
    return spatial.admin_levels(found, "s_suppkey", levels(spark, sf)).select("s_suppkey", "lng", "lat", "province", "city")


def merged_points(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS).select("species_label", "lng", "lat", "year")
    own = p.withColumns({"count": F.lit(2), "data_source": F.lit("UserInput"), "province": F.when(F.col("year") % 2 == 0, "even")})
    return spatial.merged_points(p.withColumn("data_source", F.lit("GBIF")), own).select("species_label", "lng", "lat", "year", "province", "data_source", "count")


def resolved_places(spark, sf):
    return graph.resolved_places(ecograph(spark, sf))


def intent_habitat(spark, sf):
    return graph.intent(ecograph(spark, sf), "habitat")


def intent_alias(spark, sf):
    return graph.intent(ecograph(spark, sf), "alias")


def canned_harm(spark, sf):
    return graph.canned(ecograph(spark, sf), "harm")


def canned_control(spark, sf):
    return graph.canned(ecograph(spark, sf), "control")


def canned_taxonomy(spark, sf):
    return graph.canned(ecograph(spark, sf), "taxonomy")


def canned_origin(spark, sf):
    return graph.canned(ecograph(spark, sf), "origin")


def taxon_targets(spark, sf):
    return literals.taxon_targets(spark)


def raster_bounds(spark, sf):
    (south, west), (north, east) = raster.image_bounds(1.0, 2.0, 3.0, 4.0)
    return spark.createDataFrame([(south, west, north, east)], "south double, west double, north double, east double")


def simplified_regions(spark, sf):
    sides = views.spark_view(spark, sf, views.REGION_EDGES)
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    half = lambda k, x1, y1, x2, y2: F.struct((F.col("seq") * 2 + k).alias("seq"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    c = F.col
    dense = sides.select("region", "part", "ring", F.inline(F.array(half(0, c("x1"), c("y1"), mx, my), half(1, mx, my, c("x2"), c("y2")))))
    return spatial.simplify(dense, 0.001).select("region", "part", "ring", "seq", "x1", "y1", "x2", "y2")


def response_unpack(spark, sf):
    steps = F.struct(F.array(F.to_json(F.struct(F.col("content").alias("query"))), F.to_json(F.struct(F.array("turn").alias("context")))).alias("s"))
    made = F.when(F.col("turn") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"intermediate_steps":['), F.array_join(steps["s"], ","), F.lit("]}")))
    log = views.spark_view(spark, sf, views.CHAT).drop("cypher").withColumn("response", made)
    return chat.unpacked(log).select("conv_id", "turn", "cypher", "context")


def chat_append(spark, sf):
    log = views.spark_view(spark, sf, views.CHAT).select("conv_id", "turn", "content")
    return chat.appended(log, log.select("conv_id", (F.col("turn") + 100).alias("turn"), F.lit("x").alias("image")))


def spotted_either(spark, sf):
    log = views.spark_view(spark, sf, views.CHAT).withColumnRenamed("content", "answer").withColumn("prompt", F.lit("about idiot"))
    return chat.spotted_in_either(log, NAMES).select("conv_id", "turn", "species")


def species_images(spark, sf):
    files = spark.createDataFrame([("file:/data/images/福寿螺.jpg",), ("file:/data/images/else.png",)], "path string")
    return chat.with_images(literals.species(spark).select(F.col("name").alias("species")), files)


def random_question(spark, sf):
    pool = literals.questions(spark, "福寿螺")
    return chat.random_pick(pool, 3).join(pool.select("label"), "label", "left_semi").agg(F.count("*").alias("n"))


def report_checks_now(spark, sf):
    p = views.spark_view(spark, sf, views.POINTS).select("event_id", "lng", "lat", (F.col("year") + 15).alias("year"))
    return reports.checked(p).select("event_id", "reason")


def place(spark):
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def occurrences(spark, sf):
    none = F.lit(None).cast("string")
    p = views.spark_view(spark, sf, views.POINTS)
    return p.select("species_label", "lng", "lat", "year", none.alias("province"), none.alias("city"), none.alias("district"), F.concat(F.lit('at "'), "event_id", F.lit('",\n')).alias("address"), F.lit(1).alias("count"), F.lit("GBIF").alias("data_source"))


def source_points(spark, sf):
    at = place(spark)
    occurrences(spark, sf).write.csv(at, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found, message = tables.guarded(spark, at)
    return found.withColumn("message", F.lit(message).cast("string"))


def source_missing(spark, sf):
    found, message = tables.guarded(spark, f"{place(spark)}/none.csv")
    return found.agg(F.count("*").alias("n")).withColumn("told", F.lit(message is not None))


def source_triples(spark, sf):
    at, t = place(spark), triples(spark, sf)
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t.where("row_index % 2 = 0").select(*schemas.TRIPLES).write.csv(at, **keep)
    t.where("row_index % 2 = 1").select("Property", "Entity2", "Entity1", F.lit("x").alias("more"), "Relationship").write.mode("append").csv(at, **keep)
    return tables.triple_folder(spark, at)[0].select(*schemas.TRIPLES)


def source_rejects(spark, sf):
    at, n = place(spark), spark.read.parquet(f"{sf}/nation.parquet")
    lines = n.select("n_nationkey", F.concat("n_name", F.lit(",CAUSES,b,c=1"), F.when(F.col("n_nationkey") % 5 == 0, ",over").otherwise("")).alias("x"))
    for head, body in (("Entity1,Relationship,Entity2,Property", lines), ("Entity1,Relationship", lines.limit(1))):
        text = spark.createDataFrame([(-1, head)], "n_nationkey int, x string").unionByName(body).coalesce(1).sortWithinPartitions("n_nationkey")
        text.select("x").write.mode("append").csv(at, sep="\u0001")
    return tables.triple_folder(spark, at)[1].groupBy("reason").agg(F.count("*").alias("n"))


def source_regions(spark, sf):
    at, sides = place(spark), views.spark_view(spark, sf, views.REGION_EDGES)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1"))), lambda p: F.array(p["x1"], p["y1"]))
    rings = sides.groupBy("region", "ring").agg(ring.alias("r")).select("region", "ring", F.concat("r", F.slice("r", 1, 1)).alias("r"))
    shape = rings.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda p: p["r"]).alias("c"))
    one = shape.select(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("region").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.col("c").alias("coordinates")).alias("geometry")).alias("f"))
    one.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features")))).write.text(at)
    return tables.regions_geojson(spark, at)


def source_raster(spark, sf):
    at, grid = place(spark), views.raster(spark, sf)
    lines = grid.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda p: p["value"].cast("string")), " ").alias("value"))
    head = spark.createDataFrame([(k - 3, x) for k, x in enumerate(["ncols 64", "cellsize 1", "NODATA_value -9999"])], "row long, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("row").select("value").write.text(at)  # one grid is one file
    cells, said = tables.ascii_grid(spark, at)
    return raster.masked(cells, said["nodata_value"]).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


def sink_graph(spark, sf):
    at, own = place(spark), rows(spark, sf)
    tables.write_graph(graph.nodes(own).limit(0), graph.edges(own).limit(0), at)
    tables.write_graph(graph.nodes(own), graph.edges(own), at)
    nodes, edges = tables.read_graph(spark, at)
    return nodes.select("label", F.lit("node").alias("kind")).unionByName(edges.select(F.col("rel").alias("label"), F.lit("edge").alias("kind"))).groupBy("kind", "label").agg(F.count("*").alias("n"))


def sink_append(spark, sf):
    at, own = place(spark), occurrences(spark, sf)
    tables.append_records(own, at)
    tables.append_records(own.where("lng > 30"), at)
    return spark.read.parquet(at).groupBy("species_label").agg(F.count("*").alias("n"), F.count("lng").alias("n_lng"))


def streamed_reports(spark, sf):
    at = place(spark)
    occurrences(spark, sf).withColumn("lng", F.col("lng") * 4).write.parquet(f"{at}/in")
    for _ in range(2):  # the second run finds nothing new
        stream_reports(spark, f"{at}/in", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("species_label", "year").agg(F.count("*").alias("n"))


FLAGSHIP = province_counts
ALL = [
    province_counts, points_with_province, points_with_province_grid, province_choropleth, species_list, species_center, species_center_empty, valid_point_count, scatter_layer, heat_layer,
    cluster_layer, cluster_grid, strip_names, relation_sanitize, label_sanitize, geo_label, source_label, target_label, parse_props, normalize_props, triple_rejects, graph_nodes, graph_edges,
    edge_props, edge_prop_counts, event_edges, upsert_nodes, match_1hop, match_2hop, optional_match, multi_rel, var_path, contains_match, schema_valid, admin_rollup, intent_distribution,
    intent_events, intent_control, intent_spread, intent_overview, intent_top, intent_context, raster_minmax, raster_norm, raster_alpha, raster_colour, species_spotting, chat_detail_flags,
    chat_refresh, append_report, report_checks, click_changes, suggestion_pool, gazetteer_forward, gazetteer_reverse, triples_dedup, relation_split, text_chunks, species_dimension,
    source_type_dimension, relation_dimension, suggestion_fallback, admin_levels, points_with_admin, geocoded_admin, merged_points, resolved_places, intent_habitat, intent_alias, canned_harm,
    canned_control, canned_taxonomy, canned_origin, taxon_targets, raster_bounds, simplified_regions, response_unpack, chat_append, spotted_either, species_images, random_question,
    report_checks_now, source_points, source_missing, source_triples, source_rejects, source_regions, source_raster, sink_graph, sink_append, streamed_reports,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
