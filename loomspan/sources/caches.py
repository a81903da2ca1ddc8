"""Append-only caches of transcripts and answers in partitioned Parquet folders.

A cache is partitioned by what its entries depend on (a file's fingerprint, a stream, settings), so that a look reads only the folders
asked for. Rows are appended by numbered batches, each in folders of its own: a batch that runs again replaces what it wrote before, so it
adds nothing. Of rows with one key the last batch counts. Compaction writes those once more, in one generation named by
the last batch in it; reads take the newest whole generation and the batches after it. Nothing is read to append.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from loomspan.session import delete, listed


@dataclass(frozen=True)
class Cache:
    """A cache's folder, the columns of its entries, and which of them are partitions and which name an entry within one."""

    path: str
    schema: StructType
    parts: Sequence[str] = ("fingerprint", "stream", "settings")
    keys: Sequence[str] = ("key",)

    @property
    def _stored(self) -> StructType:
        own = [f for f in self.schema.fields if f.name not in self.parts]
        return StructType([*own, *(self.schema[p] for p in self.parts), StructField("batch", LongType())])

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write rows as a batch, numbered from 0. Written again, it replaces itself, so call it with the same rows."""
        numbered = rows.select(*self.schema.names, F.lit(batch).cast("long").alias("batch"))
        spread = numbered.repartition(*self.parts)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts, "batch").parquet(f"{self.path}/batches")

    def read(self, spark: SparkSession) -> DataFrame:
        """The entries, the last of each key. Filters on parts reach the folders: only those asked for are listed and read."""
        upto = self._generation(spark)
        rows = self._batches(spark).where(F.col("batch") > upto) if upto is not None else self._batches(spark)
        if upto is not None:
            old = spark.read.schema(self._stored).parquet(f"{self.path}/whole/upto={upto}")
            rows = rows.unionByName(old)
        last = Window.partitionBy(*self.parts, *self.keys).orderBy(F.desc("batch"), *(F.col(c).desc_nulls_last() for c in self.schema.names if c not in (*self.parts, *self.keys)))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*self.schema.names)

    def compact(self, spark: SparkSession) -> int | None:
        """Write the last row of each key as a new generation, and return its number; then drop what it replaces. None for an empty cache.

        The generation counts only once it is whole; a compaction that is lost leaves the cache as it was.
        """
        newest = self._batches(spark).agg(F.max("batch")).first()[0]
        before = self._generation(spark)
        if newest is None or newest == before:
            return before
        rows = self.read(spark).withColumn("batch", F.lit(newest).cast("long"))
        rows.repartition(*self.parts).write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.path}/whole/upto={newest}")
        for old in listed(spark, f"{self.path}/whole/upto=*"):
            if int(old.rsplit("=", 1)[1]) < newest:
                delete(spark, old)
        for old in listed(spark, f"{self.path}/batches/{'/'.join(f'{p}=*' for p in self.parts)}/batch=*"):
            if int(old.rsplit("=", 1)[1]) <= newest:
                delete(spark, old)
        return newest

    def append_stream(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Append each micro-batch of a stream under its number; what a restart runs again adds nothing."""
        return rows.writeStream.foreachBatch(lambda batch, number: self.append(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _batches(self, spark: SparkSession) -> DataFrame:
        if not listed(spark, f"{self.path}/batches"):
            return spark.createDataFrame([], self._stored)
        return spark.read.schema(self._stored).parquet(f"{self.path}/batches")

    def _generation(self, spark: SparkSession) -> int | None:
        """The newest generation that is whole."""
        return max((int(f.rsplit("=", 2)[1].split("/")[0]) for f in listed(spark, f"{self.path}/whole/upto=*/_SUCCESS")), default=None)
