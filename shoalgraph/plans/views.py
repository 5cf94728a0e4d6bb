"""Views of the driver tables in the shapes that the operators take.

Each is one SQL text that both Spark and the oracle's engine run; only whole tables are read. Table names stand in
braces. Integers are computed first and divided once, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalgraph import literals


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({columns}))"


POINTS = """SELECT event_id, event_type AS species_label,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(event_id * 7919 % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) END AS lng,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST((event_id * 31 + CAST(FLOOR(event_id / 7) AS BIGINT)) % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) END AS lat,
  CAST(2000 + event_id % 25 AS INT) AS year, user_id, ts
FROM {events}"""

RINGS = {
    0: [[(0, 0), (10, 0), (10, 10), (0, 10)]],
    1: [[(0, 0), (10, 0), (0, 10)]],
    2: [[(0, 0), (12, 0), (12, 10), (0, 10)]],
    3: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 6), (3, 6)]],
    4: [[(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)]],
}
SIDES = [(kind, ring, k, *pts[k], *pts[(k + 1) % len(pts)]) for kind, rings in RINGS.items() for ring, pts in enumerate(rings) for k in range(len(pts))]
REGION_EDGES = (
    "SELECT n_name AS region, 0 AS part, t.ring AS ring, t.seq AS seq, CAST(10 * (n_nationkey % 5) + t.x1 AS DOUBLE) AS x1, CAST(10 * CAST(FLOOR(n_nationkey / 5) AS INT) + t.y1 AS DOUBLE) AS y1, "
    "CAST(10 * (n_nationkey % 5) + t.x2 AS DOUBLE) AS x2, CAST(10 * CAST(FLOOR(n_nationkey / 5) AS INT) + t.y2 AS DOUBLE) AS y2 "
    f"FROM {{nation}} JOIN {values(SIDES, 'kind, ring, seq, x1, y1, x2, y2')} t ON t.kind = n_nationkey % 5"
)
#: Every nation's square in an eastern and a western half.
HALVES = [(half, k, *pts[k], *pts[(k + 1) % 4]) for half, pts in (("west", [(0, 0), (5, 0), (5, 10), (0, 10)]), ("east", [(5, 0), (10, 0), (10, 10), (5, 10)])) for k in range(4)]
CITY_EDGES = (
    "SELECT CONCAT(n_name, ' ', t.half) AS region, 0 AS part, 0 AS ring, t.seq AS seq, CAST(10 * (n_nationkey % 5) + t.x1 AS DOUBLE) AS x1, CAST(10 * CAST(FLOOR(n_nationkey / 5) AS INT) + t.y1 AS DOUBLE) AS y1, "
    "CAST(10 * (n_nationkey % 5) + t.x2 AS DOUBLE) AS x2, CAST(10 * CAST(FLOOR(n_nationkey / 5) AS INT) + t.y2 AS DOUBLE) AS y2 "
    f"FROM {{nation}} CROSS JOIN {values(HALVES, 'half, seq, x1, y1, x2, y2')} t"
)
GAZETTEER = "SELECT n_name AS name, CAST(10 * (n_nationkey % 5) + 5 AS DOUBLE) AS lng, CAST(10 * CAST(FLOOR(n_nationkey / 5) AS INT) + 5 AS DOUBLE) AS lat FROM {nation}"
ENDINGS = [(0, "省"), (1, "市"), (2, "区"), (3, "自治区"), (4, "县"), (5, "洲"), (6, "江"), (7, "地区"), (8, "")]
RELS = [(k, r) for k, (r, _) in enumerate(literals.RELATIONS)] + [(27, "located_in"), (28, "  Causes　"), (29, "UNKNOWN_REL")]
_SUPPLIED = "SELECT s_suppkey AS k, s_name AS a, n_name AS b FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey UNION ALL SELECT 1000000 + c_custkey AS k, c_name AS a, n_name AS b FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"
TRIPLES = (
    "SELECT CASE WHEN k % 101 = 0 THEN NULL WHEN k % 5 = 0 THEN CONCAT('  ', b, e.word, '　') WHEN k % 7 = 0 THEN CONCAT(a, '清除行动') ELSE CONCAT(b, e.word) END AS Entity1, r.rel AS Relationship, "
    "CASE WHEN k % 103 = 0 THEN NULL WHEN k % 11 = 0 THEN CONCAT(a, '治理项目') WHEN k % 13 = 0 THEN CONCAT(a, '处置') ELSE CONCAT(b, f.word) END AS Entity2, "
    "CASE WHEN k % 17 = 0 THEN NULL ELSE CONCAT('year=', CAST(1990 + k % 30 AS STRING), '; status=', CASE k % 3 WHEN 0 THEN '有' WHEN 1 THEN 'None' ELSE '' END, ';bad; method = a=b ;year=', CAST(1990 + k % 7 AS STRING)) END AS Property, "
    "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '福寿螺' ELSE ' 大鳄龟 ' END AS species_source, CONCAT('part', CAST(k % 4 AS STRING), '.csv') AS file_name, k AS row_index "
    f"FROM ({_SUPPLIED}) s JOIN {values(RELS, 'i, rel')} r ON r.i = k % 30 JOIN {values(ENDINGS, 'i, word')} e ON e.i = k % 9 JOIN {values(ENDINGS, 'i, word')} f ON f.i = (k + CAST(FLOOR(k / 9) AS BIGINT)) % 9"
)
GRAPH = (
    "SELECT 'District' AS src_label, s_name AS src_name, 'LOCATED_IN' AS rel, 'City' AS dst_label, n_name AS dst_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey "
    "UNION ALL SELECT 'City', n_name, 'LOCATED_IN', 'Province', r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0 "
    "UNION ALL SELECT 'Species', c_name, 'REPORTED_IN', 'City', n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey "
    "UNION ALL SELECT 'Species', c_name, CASE c_custkey % 4 WHEN 0 THEN 'BELONGS_TO' WHEN 1 THEN 'CAUSES' WHEN 2 THEN 'PREYS_ON' ELSE 'INTRODUCED_VIA' END, CASE c_custkey % 4 WHEN 0 THEN 'Taxonomy' WHEN 1 THEN 'Impact' WHEN 2 THEN 'Target' ELSE 'Pathway' END, c_mktsegment FROM {customer} "
    "UNION ALL SELECT 'Species', c_name, 'THRIVES_IN', 'Habitat', CONCAT('waters of ', c_mktsegment) FROM {customer} WHERE c_custkey % 5 = 0 "
    "UNION ALL SELECT 'Species', c_name, 'HAS_ALIAS', 'Alias', CONCAT('alias ', CAST(c_custkey AS STRING)) FROM {customer} WHERE c_custkey % 6 = 0 "
    "UNION ALL SELECT 'Species', c_name, 'NATIVE_TO', 'Origin', n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0 "
    "UNION ALL SELECT 'Control', c_mktsegment, 'MITIGATES', 'Species', c_name FROM {customer} WHERE c_custkey % 3 = 0 "
    "UNION ALL SELECT 'Species', CONCAT('Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')), 'HAS_EVENT', 'Event', CONCAT('Order#', CAST(o_orderkey AS STRING)) FROM {orders} "
    "UNION ALL SELECT 'Event', CONCAT('Order#', CAST(o_orderkey AS STRING)), 'DURING', 'TimePeriod', o_orderpriority FROM {orders} WHERE o_orderkey % 3 <> 0 "
    "UNION ALL SELECT 'Region', r_name, 'CONTAINS', 'Region', n_name FROM {region} JOIN {nation} ON n_regionkey = r_regionkey "
    "UNION ALL SELECT 'Impact', o_orderpriority, 'CAUSES', 'Event', CONCAT('Order#', CAST(o_orderkey AS STRING)) FROM {orders} WHERE o_orderkey % 7 = 0"
)
CHAT = "SELECT conv_id, turn, role, text AS content, CASE turn % 3 WHEN 0 THEN '未获取到查询语句' WHEN 1 THEN ' ' ELSE 'MATCH (n) RETURN n' END AS cypher FROM {conversations}"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle_view(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return cells.select("row", F.col("col").cast("long").alias("col"), F.when((F.col("row") + F.col("col")) % 17 == 0, -9999.0).otherwise(F.col("v").cast("double")).alias("value"))


ORACLE_RASTER = "SELECT vec_id AS row, CAST(i AS BIGINT) AS col, CASE WHEN (vec_id + i) % 17 = 0 THEN -9999.0 ELSE CAST(embedding[i + 1] AS DOUBLE) END AS value FROM embeddings, range(64) t(i)"
