"""Golden rows for text, label and property expressions."""

import pytest
from pyspark.sql import functions as F

from shoalgraph import literals
from shoalgraph.functions import labels, props, text

GEO = {
    "江苏省": "Province", "广西壮族自治区": "Province", "香港特别行政区": "Province", "栖霞区": "District", "喀什地区": "District", "南京市": "City", "北京市": "City",
    "延边朝鲜族自治州": "City", "北美洲": "Origin", "上海": "Origin", "长江流域": "Origin", "江苏": "Habitat", "黑龙江": "Habitat", "巴西": "Origin", "": "Entity", " 南京市　": "City", "  ": "Origin",
}
ENDS = [
    ("MITIGATES", "随便", "Control", "Species"), ("MITIGATES", "清除行动", "Control", "Event"), ("CAUSES", "治理项目", "Event", "Impact"), ("CAUSES", "处置", "Species", "Event"),
    ("REPORTED_IN", "江苏", "Species", "Province"), ("REPORTED_IN", "南京市", "Species", "City"), ("NATIVE_TO", "江苏", "Species", "Habitat"), ("THRIVES_IN", "x", "Species", "Habitat"),
    ("CONTAINS", "南京市", "City", "City"), ("EVENT", "x", "Entity", "Event"), ("DURING", "x", "Event", "TimePeriod"), ("LOCATED_IN", "栖霞区", "District", "District"), ("after", "入侵", "Event", "Event"),
]
PROPS = {
    "time=1981;type=农业": {"time": "1981", "type": "农业"}, " a = 1 ; b=x=y ;c": {"a": "1", "b": "x=y"}, "a=1;a=2": {"a": "2"}, "a=1;a=none": {}, "a=;b=None;c=null": {"c": "null"}, "null": {}, "": {}, None: {},
}


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_geo_labels(spark):
    got = spark.createDataFrame([(k,) for k in [*GEO, None]], "x string").select("x", labels.geo_label(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == GEO | {None: "Entity"}


def test_end_labels(spark):
    df = spark.createDataFrame([(r, n) for r, n, _, _ in ENDS], "r string, n string")
    got = df.select(labels.source_label(F.col("n"), F.col("r")).alias("s"), labels.target_label(F.col("n"), F.col("r")).alias("t")).collect()
    assert [(g.s, g.t) for g in got] == [(s, t) for _, _, s, t in ENDS]


def test_labels_are_total(spark):
    names = ["", "南京市", "事件", "x", None]
    df = spark.createDataFrame([(r, n) for r in [*dict(literals.RELATIONS), "NEW", None] for n in names], "r string, n string")
    got = df.select(F.explode(F.array(labels.source_label(F.col("n"), F.col("r")), labels.target_label(F.col("n"), F.col("r")))).alias("l")).distinct()
    found = {r.l for r in got.collect()}
    assert found <= set(literals.LABELS)
    assert "Region" not in found


def test_props(spark):
    df = spark.createDataFrame([(k,) for k in PROPS], "p string")
    got = df.select("p", props.normalize_props(props.parse_props(F.col("p"))).alias("x")).collect()
    assert {r.p: {i.k: i.v for i in r.x} for r in got} == PROPS
    assert one(spark, "=v", props.parse_props)[0].k == ""


@pytest.mark.parametrize("raw, bare", [("　 a b ", "a b"), ("​a", "​a"), ("﻿a", "﻿a"), ("\x1ca\x1f", "a"), ("   ", "")])
def test_strip(spark, raw, bare):
    assert one(spark, raw, text.strip) == bare == raw.strip()


def test_relation_and_na(spark):
    assert [one(spark, x, text.relation) for x in (" causes　", "x", None)] == ["CAUSES", "", ""]
    assert [one(spark, x, text.na_to_null) for x in ("NA", "", "na", "null", "None ")] == [None, None, "na", None, "None "]


def test_chunks(spark):
    assert one(spark, "abcdefghij", lambda c: text.chunked(c, 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, "", lambda c: text.chunked(c, 4, 1)) == []
