"""Reports that arrive as files, appended to the occurrence table (an addition to the batch sink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shoalgraph import schemas
from shoalgraph.operators.reports import checked


def stream_reports(spark: SparkSession, incoming: str, table: str, state: str) -> StreamingQuery:
    """Takes what has arrived since the last run, checks ranges, and appends good rows; each file counts once.

    A batch is written to a folder of its own number, so one that is tried again after a failure replaces what it had written.
    """
    source = spark.readStream.schema(schemas.OCCURRENCES).parquet(incoming)

    def write(batch: DataFrame, number: int) -> None:
        checked(batch).where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
