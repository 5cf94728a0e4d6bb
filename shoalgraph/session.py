"""A session with the settings that the operators expect: adaptive execution, UTC, ANSI as Spark has it."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def session(name: str = "shoalgraph", **more: str) -> SparkSession:
    """A session of the cluster that the environment names (spark-submit, spark-defaults); without one, a local session of
    BENCH_CPUS cores with as many shuffle partitions."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(name)
    if not SparkConf().contains("spark.master"):
        cores = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(f"local[{cores}]")
        conf |= {"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "8g"}
    for k, v in (conf | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shoalgraph-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()
