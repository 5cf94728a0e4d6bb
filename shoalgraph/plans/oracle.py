"""The queries of plans.queries as SQL for the oracle's engine, written on their own."""

from __future__ import annotations

from shoalgraph import literals
from shoalgraph.plans import views
from shoalgraph.plans.views import oracle_view, quoted, values

P = f"p AS ({oracle_view(views.POINTS)})"
V = "v AS (SELECT * FROM p WHERE lng IS NOT NULL AND lat IS NOT NULL)"
E = f"e AS ({oracle_view(views.REGION_EDGES)})"
HITS = """hit AS (SELECT event_id, region FROM v, e GROUP BY event_id, region HAVING
  SUM(CASE WHEN (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
  AND SUM(CASE WHEN (x2 - x1) * (lat - y1) = (y2 - y1) * (lng - x1) AND lng BETWEEN LEAST(x1, x2) AND GREATEST(x1, x2) AND lat BETWEEN LEAST(y1, y2) AND GREATEST(y1, y2) THEN 1 ELSE 0 END) = 0)"""
J = "j AS (SELECT v.*, hit.region AS province_name FROM v LEFT JOIN hit USING (event_id))"
SPATIAL = f"WITH {P}, {V}, {E}, {HITS}, {J}"
ONE = "species_label = 'purchase'"
COUNTS = f"c AS (SELECT province_name, COUNT(*) AS counts FROM j WHERE {ONE} AND province_name IS NOT NULL GROUP BY 1)"

WHITE = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def has_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def ends_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"suffix({x}, {quoted(w)})" for w in words) + ")"


def geo(x: str) -> str:
    whens = " ".join(f"WHEN {ends_any(x, ends)} THEN {quoted(label)}" for label, ends in literals.PLACE_ENDINGS)
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'Entity' {whens} WHEN {has_any(x, literals.HABITAT_HINTS)} THEN 'Habitat' ELSE 'Origin' END)"


def source(x: str) -> str:
    return f"""(CASE WHEN rel = 'MITIGATES' THEN 'Control' WHEN rel = 'DURING' THEN 'Event' WHEN rel = 'EVENT' THEN 'Entity' WHEN rel = 'LOCATED_IN' THEN {geo(x)}
      WHEN rel IN ('AFTER', 'BEFORE', 'OVERLAPS', 'LEADS_TO', 'CAUSES') AND {has_any(x, literals.SOURCE_EVENT_WORDS)} THEN 'Event'
      WHEN rel IN ('CONTAINS', 'INTERSECTS', 'ADJACENT_TO', 'SPREAD_RISK_TO') THEN {geo(x)} ELSE 'Species' END)"""


def target(x: str) -> str:
    default = " ".join(f"WHEN rel = {quoted(r)} THEN {quoted(label)}" for r, label in literals.RELATIONS)
    event = has_any(x, literals.TARGET_EVENT_WORDS)
    return f"""(CASE WHEN rel IN ('LOCATED_IN', 'NATIVE_TO', 'SPREAD_RISK_TO', 'CONTAINS', 'INTERSECTS', 'ADJACENT_TO') THEN {geo(x)}
      WHEN rel = 'REPORTED_IN' THEN (CASE WHEN {geo(x)} IN ('Province', 'City', 'District') THEN {geo(x)} ELSE 'Province' END)
      WHEN rel = 'MITIGATES' THEN (CASE WHEN {event} THEN 'Event' ELSE 'Species' END)
      WHEN rel = 'CAUSES' THEN (CASE WHEN {event} THEN 'Event' ELSE 'Impact' END) {default} ELSE 'Entity' END)"""


KNOWN = in_list([r for r, _ in literals.RELATIONS])
T = f"t AS ({oracle_view(views.TRIPLES)})"
CLEAN = f"""s AS (SELECT *, {strip('Entity1')} AS a, {strip('Entity2')} AS b, CASE WHEN UPPER({strip('Relationship')}) IN {KNOWN} THEN UPPER({strip('Relationship')}) ELSE '' END AS rel FROM t)"""
L = f"""l AS (SELECT file_name, row_index, a AS src_name, b AS dst_name, rel, Property, {strip('species_source')} AS species_source, {source('a')} AS src_label, {target('b')} AS dst_label
  FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND rel <> '')"""
EV = """ev AS (SELECT DISTINCT 'Species' AS src_label, species_source AS src_name, 'HAS_EVENT' AS rel, 'Event' AS dst_label, CASE WHEN src_label = 'Event' THEN src_name ELSE dst_name END AS dst_name
  FROM l WHERE species_source IS NOT NULL AND species_source <> '' AND (src_label = 'Event' OR dst_label = 'Event') AND (CASE WHEN src_label = 'Event' THEN src_name ELSE dst_name END) <> '')"""
KEY = "src_label, src_name, rel, dst_label, dst_name"
ED = f"ed AS (SELECT {KEY} FROM l UNION SELECT {KEY} FROM ev)"
ND = "nd AS (SELECT src_label AS label, src_name AS name FROM ed UNION SELECT dst_label, dst_name FROM ed)"
GRAPHED = f"WITH {T}, {CLEAN}, {L}, {EV}, {ED}, {ND}"


def items(table: str, keys: str, column: str) -> str:
    """CTEs i (all key-value items in order) and q (the last of equal keys)."""
    return f"""raw AS (SELECT {keys}, UNNEST(string_split({column}, ';')) AS item, UNNEST(range(len(string_split({column}, ';')))) AS pos FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN ('', 'null')),
  i AS (SELECT {keys}, pos, {strip("item[:instr(item, '=') - 1]")} AS k, {strip("item[instr(item, '=') + 1:]")} AS v FROM raw WHERE contains(item, '=')),
  q AS (SELECT {keys}, k, arg_max(v, pos) AS v FROM i GROUP BY {keys}, k)"""


G = f"g AS ({oracle_view(views.GRAPH)})"
LI = "li AS (SELECT ROW_NUMBER() OVER () AS rid, l_orderkey, l_linenumber, CONCAT('qty=', l_linenumber, '; flag = ', l_returnflag, ' ;x;status=', CASE WHEN l_linenumber % 2 = 0 THEN 'NONE' ELSE 'ok=1' END, ';qty=', l_linenumber + 1) AS p FROM lineitem)"
R = f"z AS ({views.ORACLE_RASTER}), r AS (SELECT row, col, CASE WHEN value = -9999.0 THEN NULL ELSE value END AS value FROM z), mm AS (SELECT MIN(value) AS vmin, MAX(value) AS vmax FROM r)"
SCALED = "sc AS (SELECT row, col, CASE WHEN vmax - vmin = 0 THEN NULL ELSE (value - vmin) / (vmax - vmin) END AS s FROM r, mm)"
C = f"c AS ({oracle_view(views.CHAT)})"
GZ = f"gz AS ({oracle_view(views.GAZETTEER)})"
NAMES = sorted(["the", "and", "idiot", "der", "les", "que", "ing"])


def first_name(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {quoted(n)}) THEN {quoted(n)}" for n in NAMES) + " END"


def intent(name: str, rels: list[str], reverse: bool = False) -> str:
    s, o = ("dst", "src") if reverse else ("src", "dst")
    return f"SELECT DISTINCT {quoted(name)} AS intent, {s}_name AS subject, rel, {o}_label AS label, {o}_name AS object FROM g WHERE rel IN {in_list(rels)}"


def colour(k: int) -> str:
    low, mid, high = (int(c[1 + 2 * k : 3 + 2 * k], 16) / 255 for c in literals.LEGEND)
    f = lambda x: f"CAST({x!r} AS DOUBLE)"
    return f"ROUND(CASE WHEN s <= 0.5 THEN {f(low)} + {f(mid - low)} * (s / CAST(0.5 AS DOUBLE)) ELSE {f(mid)} + {f(high - mid)} * ((s - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE)) END, 6)"


CITIES = f"ce AS ({oracle_view(views.CITY_EDGES)})"
CITY_HITS = HITS.replace("hit AS", "chit AS").replace("FROM v, e ", "FROM v, ce ")
LEVELS = f"""WITH {P}, {V}, {E}, {HITS}, {CITIES}, {CITY_HITS}, pl AS (SELECT event_id, (SELECT MIN(region) FROM hit WHERE hit.event_id = p.event_id) AS province,
  (SELECT MIN(region) FROM chit WHERE chit.event_id = p.event_id) AS city FROM p)"""
QUESTIONS = values([(k, a.replace("%s", "福寿螺"), b.replace("%s", "福寿螺")) for k, (a, b) in enumerate(literals.QUESTIONS)], "position, label, prompt")


def oracle_sql() -> dict[str, str]:
    asked = "CASE WHEN s_suppkey % 10 = 0 THEN 'nowhere' WHEN s_suppkey % 11 = 0 THEN '  ' ELSE n_name END"
    labels = [*literals.LABELS, "Unknown", "species"]
    schema = values(literals.GRAPH_SCHEMA, "s, t, e")
    km = "2 * 6371.0 * asin(sqrt(pow(sin(radians(gz.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(gz.lat)) * pow(sin(radians(gz.lng - p.lng) / 2), 2)))"
    return {
        "province_counts": f"{SPATIAL}, {COUNTS} SELECT * FROM c ORDER BY counts DESC, province_name",
        "points_with_province": f"{SPATIAL} SELECT event_id, species_label, lng, lat, province_name FROM j",
        "points_with_province_grid": f"{SPATIAL} SELECT event_id, species_label, lng, lat, province_name FROM j",
        "province_choropleth": f"{SPATIAL}, {COUNTS}, b AS (SELECT MIN(counts) AS lo, MAX(counts) AS hi FROM c) SELECT n_name AS name, counts, CAST(CASE WHEN counts IS NULL THEN NULL WHEN hi = lo THEN 1 ELSE LEAST(FLOOR((counts - lo) / ((hi - lo) / CAST(6 AS DOUBLE))) + 1, 6) END AS INT) AS bin FROM nation LEFT JOIN c ON n_name = province_name, b",
        "species_list": f"WITH {P} SELECT DISTINCT species_label FROM p WHERE species_label IS NOT NULL",
        "species_center": f"WITH {P}, {V} SELECT ROUND(AVG(lat), 6) AS lat, ROUND(AVG(lng), 6) AS lng, COUNT(*) AS n FROM v WHERE {ONE}",
        "species_center_empty": "SELECT CAST(35 AS DOUBLE) AS lat, CAST(105 AS DOUBLE) AS lng, CAST(0 AS BIGINT) AS n",
        "valid_point_count": f"{SPATIAL} SELECT COUNT(*) AS n FROM j WHERE {ONE}",
        "scatter_layer": f"WITH {P}, {V} SELECT lat, lng FROM v WHERE {ONE}",
        "heat_layer": f"WITH {P}, {V} SELECT lat, lng FROM v WHERE {ONE}",
        "cluster_layer": f"{SPATIAL} SELECT lat, lng, province_name, printf('%.4f, %.4f', lng, lat) AS popup FROM j WHERE {ONE}",
        "cluster_grid": f"WITH {P}, {V} SELECT CAST(FLOOR(lng / 5) AS BIGINT) AS lng_cell, CAST(FLOOR(lat / 5) AS BIGINT) AS lat_cell, COUNT(*) AS n, ROUND(AVG(lng), 6) AS lng, ROUND(AVG(lat), 6) AS lat FROM v GROUP BY 1, 2",
        "strip_names": f"WITH {T}, {CLEAN} SELECT row_index, a AS name FROM s",
        "relation_sanitize": f"WITH {T}, {CLEAN} SELECT row_index, rel FROM s",
        "label_sanitize": f"SELECT c_custkey, CASE WHEN x IN {in_list(literals.LABELS)} THEN x ELSE 'Entity' END AS label FROM (SELECT c_custkey, [{', '.join(map(quoted, labels))}][c_custkey % {len(labels)} + 1] AS x FROM customer)",
        "geo_label": f"WITH {T}, {CLEAN} SELECT row_index, {geo('a')} AS label FROM s",
        "source_label": f"WITH {T}, {CLEAN} SELECT row_index, {source('a')} AS label FROM s WHERE a IS NOT NULL",
        "target_label": f"WITH {T}, {CLEAN} SELECT row_index, {target('b')} AS label FROM s WHERE b IS NOT NULL",
        "parse_props": f"WITH {LI}, {items('li', 'rid, l_orderkey, l_linenumber', 'p')} SELECT l_orderkey, l_linenumber, k, v FROM q",
        "normalize_props": f"WITH {LI}, {items('li', 'rid, l_orderkey, l_linenumber', 'p')} SELECT l_orderkey, l_linenumber, k, v FROM q WHERE v <> '' AND lower(v) <> 'none'",
        "triple_rejects": f"WITH {T}, {CLEAN} SELECT file_name, row_index, CASE WHEN a IS NULL OR b IS NULL THEN 'null entity' ELSE 'unknown relation' END AS reason FROM s WHERE a IS NULL OR b IS NULL OR rel = ''",
        "graph_nodes": f"{GRAPHED} SELECT * FROM nd",
        "graph_edges": f"{GRAPHED} SELECT * FROM ed",
        "edge_props": f"{GRAPHED}, {items('l', f'{KEY}, file_name, row_index', 'Property')} SELECT {KEY}, k, arg_max(v, (file_name, row_index)) AS v FROM q WHERE v <> '' AND lower(v) <> 'none' GROUP BY {KEY}, k",
        "edge_prop_counts": f"{GRAPHED}, {items('l', f'{KEY}, file_name, row_index', 'Property')}, n AS (SELECT {KEY}, CAST(COUNT(DISTINCT k) AS INT) AS c FROM q WHERE v <> '' AND lower(v) <> 'none' GROUP BY {KEY}) SELECT {KEY}, COALESCE(c, 0) AS n_props FROM ed LEFT JOIN n USING ({KEY})",
        "event_edges": f"{GRAPHED} SELECT * FROM ev",
        "upsert_nodes": f"{GRAPHED} SELECT * FROM nd WHERE label = 'Event'",
        "match_1hop": f"WITH {G} SELECT src_name AS species, dst_name AS place FROM g WHERE rel = 'REPORTED_IN'",
        "match_2hop": f"WITH {G} SELECT a.src_name AS species, a.dst_name AS event, b.dst_name AS period FROM g a JOIN g b ON a.dst_label = b.src_label AND a.dst_name = b.src_name WHERE a.rel = 'HAS_EVENT' AND b.rel = 'DURING'",
        "optional_match": f"WITH {G} SELECT a.src_name AS species, a.dst_name AS event, b.dst_name AS period FROM (SELECT * FROM g WHERE rel = 'HAS_EVENT') a LEFT JOIN (SELECT * FROM g WHERE rel = 'DURING') b ON a.dst_label = b.src_label AND a.dst_name = b.src_name",
        "multi_rel": f"WITH {G} SELECT rel, dst_name, COUNT(*) AS n FROM g WHERE rel IN ('CAUSES', 'PREYS_ON') GROUP BY 1, 2",
        "var_path": f"WITH RECURSIVE {G}, w(start, label, name, depth) AS (SELECT DISTINCT src_name, src_label, src_name, 0 FROM g WHERE src_label = 'District' UNION SELECT w.start, g.dst_label, g.dst_name, w.depth + 1 FROM w JOIN g ON g.rel = 'LOCATED_IN' AND w.label = g.src_label AND w.name = g.src_name WHERE w.depth < 2) SELECT start, name, MIN(depth) AS depth FROM w GROUP BY start, label, name",
        "contains_match": f"WITH {G} SELECT * FROM (SELECT src_label AS label, src_name AS name FROM g UNION SELECT dst_label, dst_name FROM g) WHERE contains(name, 'AT')",
        "schema_valid": f"WITH {G}, d AS (SELECT DISTINCT src_label AS start, rel AS type, dst_label AS \"end\" FROM g) SELECT start, type, \"end\", CASE WHEN EXISTS (SELECT 1 FROM {schema} x WHERE x.s = d.start AND x.t = d.type AND x.e = d.\"end\") THEN 'valid' WHEN EXISTS (SELECT 1 FROM {schema} x WHERE x.e = d.start AND x.t = d.type AND x.s = d.\"end\") THEN 'reversed' ELSE 'invalid' END AS verdict FROM d",
        "admin_rollup": f"WITH {G}, o AS (SELECT DISTINCT * FROM g WHERE rel = 'LOCATED_IN'), d AS (SELECT DISTINCT src_name AS district FROM o WHERE src_label = 'District') SELECT district, c.dst_name AS city, p.dst_name AS province FROM d LEFT JOIN o c ON c.src_label = 'District' AND c.dst_label = 'City' AND c.src_name = district LEFT JOIN o p ON p.src_label = 'City' AND p.dst_label = 'Province' AND p.src_name = c.dst_name",
        "intent_distribution": f"WITH {G} {intent('distribution', ['REPORTED_IN'])}",
        "intent_events": f"WITH {G}, x AS (SELECT src_name AS event, rel, dst_name AS detail FROM g WHERE rel IN ('DURING', 'AFTER', 'CAUSES') AND src_label = 'Event' UNION SELECT dst_name, rel, src_name FROM g WHERE rel = 'MITIGATES' AND dst_label = 'Event') SELECT a.src_name AS species, a.dst_name AS event, x.rel, x.detail FROM (SELECT * FROM g WHERE rel = 'HAS_EVENT') a LEFT JOIN x ON x.event = a.dst_name",
        "intent_control": f"WITH {G} {intent('control', ['MITIGATES'], True)}",
        "intent_spread": f"WITH {G} {intent('spread', ['SPREAD_RISK_TO', 'CONTAINS'])}",
        "intent_overview": f"WITH {G} {intent('taxonomy', ['BELONGS_TO'])} UNION ALL {intent('harm', ['CAUSES', 'AFFECTS', 'PREYS_ON', 'COMPETES_WITH'])} UNION ALL {intent('control', ['MITIGATES'], True)}",
        "intent_top": f"WITH {G} SELECT * FROM ({intent('pathway', ['INTRODUCED_VIA'])}) ORDER BY subject, rel, label, object LIMIT 10",
        "intent_context": f"WITH {G} SELECT CONCAT('{{\"subject\":\"', subject, '\",\"object\":\"', object, '\"}}') AS context FROM ({intent('x', ['HAS_ALIAS'])} UNION ALL {intent('y', ['BELONGS_TO'])})",
        "raster_minmax": f"WITH {R} SELECT * FROM mm",
        "raster_norm": f"WITH {R}, {SCALED} SELECT row, col, ROUND(s, 6) AS scaled FROM sc",
        "raster_alpha": f"WITH {R} SELECT row, col, CAST(CASE WHEN value IS NULL THEN 0 ELSE 0.7 END AS DOUBLE) AS alpha FROM r",
        "raster_colour": f"WITH {R}, {SCALED} SELECT row, col, {colour(0)} AS r, {colour(1)} AS g, {colour(2)} AS b FROM sc",
        "species_spotting": f"SELECT doc_id, {first_name('text')} AS species FROM documents",
        "chat_detail_flags": f"WITH {C} SELECT conv_id, turn, cypher <> '未获取到查询语句' AND trim(cypher) <> '' AS show_details FROM c",
        "chat_refresh": f"WITH {C}, f AS (SELECT conv_id, turn, {first_name('content')} AS s FROM c) SELECT conv_id, turn, (s IS DISTINCT FROM LAG(s) OVER w) OR LAG(turn) OVER w IS NULL OR LAG(turn) OVER w <> turn AS refresh FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
        "append_report": f"WITH {P} SELECT species_label, NULL AS data_source, COUNT(*) AS n, CAST(NULL AS BIGINT) AS reported FROM p GROUP BY 1 UNION ALL SELECT species_label, 'UserInput', COUNT(*), COUNT(*) FROM p GROUP BY 1",
        "report_checks": f"WITH {P} SELECT event_id, CASE WHEN lng IS NULL OR lng * 4 NOT BETWEEN -180 AND 180 THEN 'lng' WHEN lat IS NULL OR lat * 2 NOT BETWEEN -90 AND 90 THEN 'lat' WHEN year + 15 NOT BETWEEN 1900 AND 2030 THEN 'year' END AS reason FROM p",
        "click_changes": f"WITH {P}, k AS (SELECT event_id, user_id, FLOOR(lng / 20) AS x, FLOOR(lat / 20) AS y FROM p), d AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, ROW_NUMBER() OVER w AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, user_id FROM d WHERE n = 1 OR x IS DISTINCT FROM px OR y IS DISTINCT FROM py",
        "suggestion_pool": f"SELECT position, label, prompt FROM {values([(k, a.replace('%s', '福寿螺'), b.replace('%s', '福寿螺')) for k, (a, b) in enumerate(literals.QUESTIONS)], 'position, label, prompt')} WHERE position >= 2",
        "gazetteer_forward": f"WITH {GZ}, a AS (SELECT s_suppkey, {asked} AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, gz.lng AS found_lng, gz.lat AS found_lat FROM a LEFT JOIN gz ON x = name WHERE trim(x) <> ''",
        "gazetteer_reverse": f"WITH {P}, {GZ}, d AS (SELECT event_id, name, ROUND({km}, 6) AS km FROM p CROSS JOIN gz WHERE p.lng IS NOT NULL AND p.lat IS NOT NULL) SELECT event_id, arg_min(name, (km, name)) AS place, ROUND(MIN(km), 3) AS km FROM d GROUP BY 1",
        "triples_dedup": f"WITH {T} SELECT DISTINCT Entity1, Relationship, Entity2, Property, species_source FROM t",
        "relation_split": f"WITH {T}, {CLEAN} SELECT row_index, CASE WHEN rel IN ('LOCATED_IN', 'REPORTED_IN') THEN 'place' ELSE 'other' END AS part FROM s",
        "text_chunks": "WITH d AS (SELECT doc_id, text, UNNEST(range(0, GREATEST(length(text) - 50, 1), 450)) AS o FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(FLOOR(o / 450) AS INT) AS chunk, CAST(length(text[o + 1:o + 500]) AS INT) AS n_chars, md5(text[o + 1:o + 500]) AS digest FROM d",
        "species_dimension": "SELECT name, latin, CAST(k AS BIGINT) AS gbif_taxon_key, NULLIF(b, '') AS baidu_url, NULLIF(w, '') AS zh_wiki_url FROM " + values([tuple("" if x is None else x for x in r) for r in literals.SPECIES], "name, latin, k, b, w"),
        "source_type_dimension": "SELECT key, label FROM " + values(literals.SOURCE_TYPES, "key, label"),
        "relation_dimension": "SELECT relation, default_target FROM " + values(literals.RELATIONS, "relation, default_target"),
        "suggestion_fallback": f"SELECT position, label, prompt FROM {QUESTIONS} WHERE position < 3",
        "admin_levels": f"{LEVELS} SELECT event_id, province, city FROM pl",
        "points_with_admin": f"{LEVELS} SELECT event_id, province, CASE WHEN event_id % 10 = 0 THEN 'stored' ELSE city END AS city FROM pl",
        "geocoded_admin": f"WITH {GZ}, a AS (SELECT s_suppkey, {asked} AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey), {E}, {CITIES}, v AS (SELECT s_suppkey AS event_id, gz.lng, gz.lat + 1 AS lat FROM a LEFT JOIN gz ON x = name WHERE trim(x) <> ''), "
        f"{HITS}, {CITY_HITS} SELECT v.event_id AS s_suppkey, lng, lat, (SELECT MIN(region) FROM hit WHERE hit.event_id = v.event_id) AS province, (SELECT MIN(region) FROM chit WHERE chit.event_id = v.event_id) AS city FROM v",
        "merged_points": f"WITH {P}, {V} SELECT species_label, lng, lat, year, CASE WHEN year % 2 = 0 THEN 'even' END AS province, 'GBIF' AS data_source, CAST(3 * COUNT(*) AS BIGINT) AS count FROM v GROUP BY 1, 2, 3, 4, 5",
        "resolved_places": f"WITH {G}, a AS (SELECT DISTINCT src_name AS species, dst_name AS place FROM g WHERE rel = 'REPORTED_IN'), b AS (SELECT DISTINCT src_name AS place, dst_name AS parent FROM g WHERE rel = 'LOCATED_IN') SELECT species, a.place, parent FROM a LEFT JOIN b ON a.place = b.place",
        "intent_habitat": f"WITH {G} {intent('habitat', ['THRIVES_IN'])}",
        "intent_alias": f"WITH {G} {intent('alias', ['HAS_ALIAS'])}",
        "canned_harm": f"WITH {G} {intent('harm', ['CAUSES', 'AFFECTS', 'PREYS_ON', 'COMPETES_WITH'])}",
        "canned_control": f"WITH {G} {intent('control', ['MITIGATES'], True)}",
        "canned_taxonomy": f"WITH {G} {intent('taxonomy', ['BELONGS_TO'])}",
        "canned_origin": f"WITH {G} {intent('origin', ['NATIVE_TO'])} UNION ALL {intent('pathway', ['INTRODUCED_VIA'])}",
        "taxon_targets": "SELECT name, CAST(k AS BIGINT) AS gbif_taxon_key FROM " + values([(r[0], r[2]) for r in literals.SPECIES if r[2] is not None], "name, k"),
        "raster_bounds": "SELECT CAST(2 AS DOUBLE) AS south, CAST(1 AS DOUBLE) AS west, CAST(4 AS DOUBLE) AS north, CAST(3 AS DOUBLE) AS east",
        "simplified_regions": f"WITH {E} SELECT region, part, ring, seq, x1, y1, x2, y2 FROM e",
        "response_unpack": f"WITH {C} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN {quoted(literals.NO_QUERY)} ELSE content END AS cypher, CASE WHEN turn % 3 = 0 THEN '[]' ELSE CONCAT('[', turn, ']') END AS context FROM c",
        "chat_append": f"WITH {C} SELECT conv_id, turn, content, NULL AS image FROM c UNION ALL SELECT conv_id, turn + 100, NULL, 'x' FROM c",
        "spotted_either": f"WITH {C} SELECT conv_id, turn, COALESCE({first_name('content')}, 'idiot') AS species FROM c",
        "species_images": "SELECT '福寿螺' AS species",
        "random_question": "SELECT CAST(1 AS BIGINT) AS n",
        "report_checks_now": f"WITH {P} SELECT event_id, CASE WHEN lng IS NULL THEN 'lng' WHEN lat IS NULL THEN 'lat' WHEN year + 15 > year(current_date) THEN 'year' END AS reason FROM p",
        "source_points": f"WITH {P} SELECT species_label, lng, lat, year, NULL AS province, NULL AS city, NULL AS district, CONCAT('at \"', event_id, '\",', chr(10)) AS address, CAST(1 AS INT) AS count, 'GBIF' AS data_source, NULL AS message FROM p",
        "source_missing": "SELECT CAST(0 AS BIGINT) AS n, true AS told",
        "source_triples": f"WITH {T} SELECT Entity1, Relationship, Entity2, Property, CASE WHEN row_index % 2 = 0 THEN species_source END AS species_source FROM t",
        "source_rejects": "SELECT 'too many fields' AS reason, COUNT(*) AS n FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'no column Entity2', 1",
        "source_regions": f"WITH {E} SELECT region, part, ring, seq, x1, y1, x2, y2 FROM e",
        "source_raster": f"WITH {R}, b AS (SELECT MIN(row) AS lo FROM r) SELECT row - lo AS row, col, value FROM r, b",
        "sink_graph": f"{GRAPHED} SELECT 'node' AS kind, label, COUNT(*) AS n FROM nd GROUP BY 2 UNION ALL SELECT 'edge', rel, COUNT(*) FROM ed GROUP BY 2",
        "sink_append": f"WITH {P} SELECT species_label, CAST(COUNT(*) + COUNT(*) FILTER (lng > 30) AS BIGINT) AS n, CAST(COUNT(lng) + COUNT(*) FILTER (lng > 30) AS BIGINT) AS n_lng FROM p GROUP BY 1",
        "streamed_reports": f"WITH {P}, {V} SELECT species_label, year, COUNT(*) AS n FROM v WHERE lng * 4 <= 180 GROUP BY 1, 2",
    }
