"""Appending scored records as their files arrive: the missing partitions only, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.calls import parsed, score


def score_arrivals(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *partition_by: str) -> StreamingQuery:
    """Parse and score generated texts in new files under ``source`` into a Parquet table, then stop.

    Columns: gen, candidates (array of (id, name)), gold, split and any others. A file is scored once, also when the job
    is run again; there is no state between records.
    """
    arrivals = spark.readStream.schema(schema).json(source)

    def write(batch: DataFrame, epoch: int) -> None:
        score(parsed(batch)).drop("calls").write.mode("append").partitionBy(*partition_by).parquet(target)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
