"""From raw documents to packed training sequences: five stages over all that the one before kept.

Quality rules drop bad texts, line deduplication deletes repeated line blocks from later documents (rows stay,
a whole copy becomes an empty text), near-duplicate removal keeps one document of each class (empty texts are one
class), decontamination drops documents that hold benchmark items, and packing returns the token pieces of
what is left with their places in sequences of 2,048.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoalgraph.llm.bagminhash import drop_near_duplicates
from shoalgraph.llm.line_dedup import dedup_lines
from shoalgraph.llm.lsa_decontam import drop_contaminated
from shoalgraph.llm.packing import pack
from shoalgraph.llm.quality_rules import keep_good
from shoalgraph.llm.runtime import prepare, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer="byte_bpe_50k.json", length=2048, end=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL has neither the tokenizer nor the signatures; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written as Parquet into the shared checkpoint folder and read again.

    Null and empty texts are base_failed and go in the first stage, repeated rows in the third; an empty table gives no rows. A
    stage's table is deleted once the next one is written.
    """
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        last = name
    return docs
