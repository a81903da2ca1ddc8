"""Streaming counterparts (an extension): merged spans, and an incremental cache of answers.

The batch operators define the results; these keep them up to date as rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.session import exists
from loomspan.streaming.sessions import merged


def merge_stream(spans: DataFrame, gap: float, late: str = "10 minutes") -> DataFrame:
    """Merged spans (media, start, end, n) of a stream (media, start, end in seconds), each given out once it can't grow any more.

    Spans may come in any order within the watermark's delay; see sessions.merged.
    """
    return merged(spans, gap, late)


def append_missing(answers: DataFrame, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows whose key the table (a Parquet folder) lacks: an incremental cache of answers.

    It reads the keys of the whole folder for each batch; sources.caches.Cache reads nothing to append.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if exists(spark, table):
            fresh = fresh.join(spark.read.parquet(table).select(key), key, "left_anti")
        fresh.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
