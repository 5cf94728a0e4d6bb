"""Fixed values of the domain: dimensions, relation and label vocabularies, suffix and keyword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Species with Latin name, taxon key, encyclopedia pages.
SPECIES = [
    ("非洲大蜗牛", "Achatina fulica", 10928934, None, None),
    ("福寿螺", "Pomacea canaliculata", 2292582, "https://baike.baidu.com/item/福寿螺/4201051", None),
    ("鳄雀鳝", "Atractosteus spatula", 2346754, None, None),
    ("豹纹翼甲鲶", "Pterygoplichthys pardalis", 2339971, None, None),
    ("齐氏罗非鱼", "Coptodon zillii", 2370703, None, "https://zh.wikipedia.org/wiki/罗非鱼"),
    ("美洲牛蛙", "American bullfrog", 2427091, None, None),
    ("大鳄龟", "Macrochelys temminckii", 5220318, None, None),
    ("红耳彩龟", "Trachemys scripta elegans", 2443002, None, None),
]
# Source types.
SOURCE_TYPES = [("baidu", "百度百科"), ("zh_wiki", "中文维基"), ("en_wiki", "英文维基")]
# Relations and the label their target has unless a rule says otherwise.
RELATIONS = [
    ("HAS_ALIAS", "Species"), ("BELONGS_TO", "Taxonomy"), ("NATIVE_TO", "Origin"), ("LOCATED_IN", "Origin"), ("REPORTED_IN", "Province"),
    ("THRIVES_IN", "Habitat"), ("INTRODUCED_VIA", "Pathway"), ("PREYS_ON", "Target"), ("COMPETES_WITH", "Target"), ("CAUSES", "Impact"),
    ("SUPPRESSED_BY", "Control"), ("INVADES", "Province"), ("HAS_MORPHOLOGY", "Morphology"), ("HAS_HABIT", "Habit"), ("ADJACENT_TO", "Region"),
    ("CONTAINS", "Region"), ("INTERSECTS", "Region"), ("SPREAD_RISK_TO", "Region"), ("LEADS_TO", "Event"), ("MITIGATES", "Event"),
    ("AFFECTS", "Target"), ("BEFORE", "Event"), ("AFTER", "Event"), ("DURING", "TimePeriod"), ("OVERLAPS", "Event"), ("EVENT", "Event"), ("HAS_EVENT", "Event"),
]
# Labels a node may have.
LABELS = ["Species", "Taxonomy", "Origin", "Province", "City", "District", "Habitat", "Pathway", "Target", "Impact", "Control", "Morphology", "Habit", "Entity", "Region", "Event", "TimePeriod"]
# Name endings of places, in the order in which they are tried, and hints of habitats.
PLACE_ENDINGS = [
    ("Province", ["省", "自治区", "特别行政区"]),
    ("District", ["区", "县", "旗", "林区", "自治县", "市辖区", "镇", "乡", "村"]),
    ("City", ["市", "盟", "州", "地区", "自治州"]),
    ("Origin", ["洲", "国", "流域", "盆地", "大陆", "岛", "海", "洋"]),
]
HABITAT_HINTS = ["稻田", "水库", "河流", "湖泊", "湿地", "池塘", "沟渠", "沼泽", "海岸", "河口", "静水", "浅水", "水域", "塘", "渠", "溪", "江", "海湾"]
# Words that make a source or a target an event.
SOURCE_EVENT_WORDS = ["事件", "行动", "防治", "入侵", "治理", "整治", "清除"]
TARGET_EVENT_WORDS = ["事件", "行动", "防治", "整治", "清除", "处置"]
# Texts that a CSV reader takes for null.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Patterns (start label, relation, end label) of the question schema.
GRAPH_SCHEMA = [
    ("Species", "HAS_ALIAS", "Species"), ("Species", "BELONGS_TO", "Taxonomy"), ("Species", "NATIVE_TO", "Origin"), ("Species", "HAS_MORPHOLOGY", "Morphology"),
    ("Species", "HAS_HABIT", "Habit"), ("Species", "REPORTED_IN", "Province"), ("Species", "REPORTED_IN", "City"), ("Species", "REPORTED_IN", "District"),
    ("Species", "HAS_EVENT", "Event"), ("District", "LOCATED_IN", "City"), ("City", "LOCATED_IN", "Province"), ("Origin", "LOCATED_IN", "Origin"),
    ("Region", "LOCATED_IN", "Region"), ("Species", "THRIVES_IN", "Habitat"), ("Species", "INTRODUCED_VIA", "Pathway"), ("Species", "PREYS_ON", "Target"),
    ("Species", "COMPETES_WITH", "Target"), ("Species", "CAUSES", "Impact"), ("Species", "AFFECTS", "Target"), ("Species", "AFFECTS", "Region"),
    ("Event", "AFFECTS", "Target"), ("Event", "AFFECTS", "Region"), ("Control", "MITIGATES", "Species"), ("Control", "MITIGATES", "Impact"),
    ("Control", "MITIGATES", "Event"), ("Event", "DURING", "TimePeriod"), ("Event", "CAUSES", "Impact"), ("Event", "CAUSES", "Event"),
    ("Event", "CONTAINS", "Event"), ("Region", "CONTAINS", "Region"), ("Region", "SPREAD_RISK_TO", "Region"),
]
# Question labels and prompts; %s is the species.
QUESTIONS = [
    ("介绍一下 %s", "请全面介绍一下%s，包括分类、危害和防治手段。"),
    ("问问 %s 的危害", "请详细介绍一下%s的危害是什么？"),
    ("如何防治 %s？", "针对%s，有哪些有效的防治手段？"),
    ("%s 属于什么分类？", "%s在生物学上属于什么分类？"),
    ("%s 的原产地在哪？", "%s的原产地是哪里？它是怎么入侵的？"),
]
# The text that stands for "no query", legend colours from low to high, map centre without points.
NO_QUERY = "未获取到查询语句"
LEGEND = ["#ffffcc", "#fd8d3c", "#e31a1c"]
DEFAULT_CENTRE = (35.0, 105.0)


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def species(spark: SparkSession) -> DataFrame:
    return table(spark, SPECIES, "name string, latin string, gbif_taxon_key long, baidu_url string, zh_wiki_url string")


def source_types(spark: SparkSession) -> DataFrame:
    return table(spark, SOURCE_TYPES, "key string, label string")


def relations(spark: SparkSession) -> DataFrame:
    return table(spark, RELATIONS, "relation string, default_target string")


def graph_schema(spark: SparkSession) -> DataFrame:
    return table(spark, GRAPH_SCHEMA, "start string, type string, end string")


def questions(spark: SparkSession, name: str) -> DataFrame:
    rows = [(k, label.replace("%s", name), prompt.replace("%s", name)) for k, (label, prompt) in enumerate(QUESTIONS)]
    return table(spark, rows, "position int, label string, prompt string")


def taxon_targets(spark: SparkSession) -> DataFrame:
    """Names with a taxon key."""
    return species(spark).where("gbif_taxon_key is not null").select("name", "gbif_taxon_key")
