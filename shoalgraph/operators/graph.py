"""A property graph from relation triples: nodes, edges, merged properties, derived event edges, and patterns over them.

Everything is one lazy plan; shuffles are those of the merges (by node, by edge and by edge property).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph import schemas
from shoalgraph.functions import labels, props, text

EDGE_KEY = ["src_label", "src_name", "rel", "dst_label", "dst_name"]


def prepared(triples: DataFrame, nan_source: bool = False) -> DataFrame:
    """Triples with trimmed names, checked relation, parsed properties, labels and a reason where a row is to be rejected.

    Reasons: "null entity", "unknown relation", "empty property name". nan_source makes a missing species_source the
    species "nan", as a reader without null handling would.
    """
    na = {c: text.na_to_null(F.col(c)) for c in ("Entity1", "Entity2", "Relationship", "Property", "species_source")}
    rows = triples.withColumns(na)
    pairs = props.parse_props(F.col("Property"))
    rows = rows.withColumns({"src_name": text.strip(F.col("Entity1")), "dst_name": text.strip(F.col("Entity2")), "rel": text.relation(F.col("Relationship")), "_pairs": pairs})
    source = text.strip(F.col("species_source"))
    reason = (
        F.when(F.col("Entity1").isNull() | F.col("Entity2").isNull(), "null entity")
        .when(F.col("rel") == "", "unknown relation")
        .when(F.exists(props.normalize_props(F.col("_pairs")), lambda x: x["k"] == ""), "empty property name")
    )
    return rows.select(
        "file_name",
        "row_index",
        "src_name",
        "dst_name",
        "rel",
        props.normalize_props(F.col("_pairs")).alias("props"),
        labels.source_label(F.col("src_name"), F.col("rel")).alias("src_label"),
        labels.target_label(F.col("dst_name"), F.col("rel")).alias("dst_label"),
        (F.coalesce(source, F.lit("nan")) if nan_source else F.nullif(source, F.lit(""))).alias("species_source"),
        reason.alias("reason"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("file_name", "row_index", "reason")


def event_edges(rows: DataFrame) -> DataFrame:
    """Species -HAS_EVENT-> event for rows with a species source of which one end is an event (the source first)."""
    event = F.when(F.col("src_label") == "Event", F.col("src_name")).when(F.col("dst_label") == "Event", F.col("dst_name"))
    found = rows.where("species_source is not null").select(F.col("species_source"), event.alias("event")).where("event is not null and event != ''")
    return found.select(F.lit("Species").alias("src_label"), F.col("species_source").alias("src_name"), F.lit("HAS_EVENT").alias("rel"), F.lit("Event").alias("dst_label"), F.col("event").alias("dst_name")).distinct()


def edges(rows: DataFrame) -> DataFrame:
    """Distinct edges, derived ones included."""
    return rows.select(*EDGE_KEY).unionByName(event_edges(rows)).distinct()


def nodes(rows: DataFrame) -> DataFrame:
    """Distinct (label, name)."""
    return all_nodes(edges(rows))


def edge_props(rows: DataFrame) -> DataFrame:
    """(edge, k, v): for each property of an edge the value of its last row in (file, row) order."""
    each = rows.select(*EDGE_KEY, "file_name", "row_index", F.explode("props").alias("p"))
    return each.groupBy(*EDGE_KEY, F.col("p.k").alias("k")).agg(F.max_by("p.v", F.struct("file_name", "row_index")).alias("v"))


def edges_with_props(rows: DataFrame) -> DataFrame:
    """Edges with a map of their merged properties; edges without any have an empty map."""
    merged = edge_props(rows).groupBy(*EDGE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))
    return edges(rows).join(merged, EDGE_KEY, "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key does not exist yet, once each."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def hop(graph: DataFrame, rel: str | list[str], prefix: str) -> DataFrame:
    """Edges of one relation, or of any of several, with columns named for a step of a pattern."""
    wanted = [rel] if isinstance(rel, str) else rel
    return graph.where(F.col("rel").isin(wanted)).select(*[F.col(c).alias(f"{prefix}_{c}") for c in EDGE_KEY])


def path(graph: DataFrame, first: str | list[str], second: str | list[str], optional: bool = False) -> DataFrame:
    """Two steps a -first-> b -second-> c; with optional, rows without a second step stay with nulls."""
    a, b = hop(graph, first, "a"), hop(graph, second, "b")
    on = (F.col("a_dst_label") == F.col("b_src_label")) & (F.col("a_dst_name") == F.col("b_src_name"))
    return a.join(b, on, "left" if optional else "inner")


def reach(graph: DataFrame, rel: str | list[str], starts: DataFrame, low: int, high: int) -> DataFrame:
    """(start, name, depth) reached over ``low`` to ``high`` steps from nodes (label, name); depth is bounded by ``high``."""
    step = graph.where(F.col("rel").isin([rel] if isinstance(rel, str) else rel)).select(*EDGE_KEY).distinct()
    front = starts.select(F.col("name").alias("start"), "label", "name")
    found = front.withColumn("depth", F.lit(0)) if low == 0 else None
    for depth in range(1, high + 1):
        moved = front.join(step, (front["label"] == step["src_label"]) & (front["name"] == step["src_name"]))
        front = moved.select("start", F.col("dst_label").alias("label"), F.col("dst_name").alias("name")).distinct()
        if depth >= low:
            layer = front.withColumn("depth", F.lit(depth))
            found = layer if found is None else found.unionByName(layer)
    return found.groupBy("start", "label", "name").agg(F.min("depth").alias("depth"))


def all_nodes(graph: DataFrame) -> DataFrame:
    """Distinct (label, name) of an edge table."""
    ends = graph.select(F.col("src_label").alias("label"), F.col("src_name").alias("name"))
    return ends.unionByName(graph.select(F.col("dst_label").alias("label"), F.col("dst_name").alias("name"))).distinct()


def nodes_of(graph: DataFrame, label: str) -> DataFrame:
    return all_nodes(graph).where(F.col("label") == label)


def names_like(nodes_: DataFrame, part: str) -> DataFrame:
    return nodes_.where(F.col("name").contains(part))


def checked_patterns(graph: DataFrame, schema: DataFrame) -> DataFrame:
    """Patterns of the graph with a verdict: "valid", "reversed" (valid the other way round) or "invalid"."""
    seen = graph.select(F.col("src_label").alias("start"), F.col("rel").alias("type"), F.col("dst_label").alias("end")).distinct()
    right = schema.select("start", "type", "end", F.lit(True).alias("_ok"))
    turned = schema.select(F.col("end").alias("start"), "type", F.col("start").alias("end"), F.lit(True).alias("_back")).distinct()
    both = seen.join(F.broadcast(right), ["start", "type", "end"], "left").join(F.broadcast(turned), ["start", "type", "end"], "left")
    return both.select("start", "type", "end", F.when(F.col("_ok"), "valid").when(F.col("_back"), "reversed").otherwise("invalid").alias("verdict"))


def admin_rollup(graph: DataFrame) -> DataFrame:
    """District, city and province of every district, over LOCATED_IN; what is missing is null."""
    place = graph.where("rel = 'LOCATED_IN'")
    up = lambda low, high: place.where((F.col("src_label") == low) & (F.col("dst_label") == high)).select(F.col("src_name").alias(low), F.col("dst_name").alias(high)).distinct()
    districts = place.where("src_label = 'District'").select(F.col("src_name").alias("District")).distinct()
    return districts.join(up("District", "City"), "District", "left").join(up("City", "Province"), "City", "left").select(F.col("District").alias("district"), F.col("City").alias("city"), F.col("Province").alias("province"))


def resolved_places(graph: DataFrame) -> DataFrame:
    """(species, place, parent) of every place that a species is reported in, with what the place is located in.

    Our definition of the step that selects exact places: a place that is located in no other has a null parent.
    """
    reported = graph.where("rel = 'REPORTED_IN'").select(F.col("src_name").alias("species"), F.col("dst_name").alias("place")).distinct()
    located = graph.where("rel = 'LOCATED_IN'").select(F.col("src_name").alias("place"), F.col("dst_name").alias("parent")).distinct()
    return reported.join(located, "place", "left").select("species", "place", "parent")


#: Intent name: relation filter, whether the subject is the target of the edge.
INTENTS = {
    "distribution": (["REPORTED_IN"], False),
    "pathway": (["INTRODUCED_VIA"], False),
    "habitat": (["THRIVES_IN"], False),
    "alias": (["HAS_ALIAS"], False),
    "taxonomy": (["BELONGS_TO"], False),
    "origin": (["NATIVE_TO"], False),
    "harm": (["CAUSES", "AFFECTS", "PREYS_ON", "COMPETES_WITH"], False),
    "control": (["MITIGATES"], True),
    "spread": (["SPREAD_RISK_TO", "CONTAINS"], False),
}
#: Canned question: the intents it is made of.
CANNED = {"overview": ["taxonomy", "harm", "control"], "harm": ["harm"], "control": ["control"], "taxonomy": ["taxonomy"], "origin": ["origin", "pathway"]}


def intent(graph: DataFrame, name: str, subject: str | None = None, limit: int | None = None) -> DataFrame:
    """(intent, subject, rel, label, object) of an intent, for one subject name or all; limit keeps the first rows by name."""
    rels, reverse = INTENTS[name]
    s, o = ("dst", "src") if reverse else ("src", "dst")
    found = graph.where(F.col("rel").isin(rels))
    found = found.where(F.col(f"{s}_name") == subject) if subject is not None else found
    out = found.select(F.lit(name).alias("intent"), F.col(f"{s}_name").alias("subject"), "rel", F.col(f"{o}_label").alias("label"), F.col(f"{o}_name").alias("object")).distinct()
    return out.orderBy("subject", "rel", "label", "object").limit(limit) if limit else out


def canned(graph: DataFrame, question: str, subject: str | None = None) -> DataFrame:
    parts = [intent(graph, name, subject) for name in CANNED[question]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_history(graph: DataFrame) -> DataFrame:
    """Species, their events, and what follows from these (DURING, AFTER, CAUSES; MITIGATES points at the event)."""
    first = hop(graph, "HAS_EVENT", "a").select(F.col("a_src_name").alias("species"), F.col("a_dst_name").alias("event"))
    on = graph.where(F.col("rel").isin("DURING", "AFTER", "CAUSES") & (F.col("src_label") == "Event")).select(F.col("src_name").alias("event"), "rel", F.col("dst_name").alias("detail"))
    to = graph.where((F.col("rel") == "MITIGATES") & (F.col("dst_label") == "Event")).select(F.col("dst_name").alias("event"), "rel", F.col("src_name").alias("detail"))
    return first.join(on.unionByName(to).distinct(), "event", "left").select("species", "event", "rel", "detail")


def as_context(df: DataFrame) -> DataFrame:
    """Rows as JSON texts for an answer's context."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("context"))


def split_relations(triples: DataFrame, rels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Triples of the given relations, and the others (our definition of the split stage)."""
    rel = text.relation(F.col("Relationship"))
    return triples.where(rel.isin(rels)), triples.where(~rel.isin(rels))


def merged_triples(*parts: DataFrame) -> DataFrame:
    """Union by name without exact duplicates (our definition of the merge stage)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates([c for c in schemas.TRIPLES if c in out.columns])
