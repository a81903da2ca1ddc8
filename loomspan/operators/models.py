"""Models as table functions: one model a worker, full batches, several rows out for an input, and a memo of what is known.

A model is made in the worker by a factory that is sent there, and called with a list of inputs; it returns a list of
rows for each. Batches have a fixed number of inputs and go over the bounds of Arrow batches. What a model says of
an input must depend on nothing else, so results don't depend on how rows lie in partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, StringType, StructType

from loomspan.session import durable

Model = Callable[[list], Sequence[Sequence[tuple]]]
Factory = Callable[[], Model]


def _typed(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def apply_model(inputs: DataFrame, key: str, value: str, factory: Factory, schema: str | StructType, size: int = 64) -> DataFrame:
    """(key, place, schema's columns): what a model says of each input, a row for each thing said; place numbers an input's rows from 0.

    The model sees `size` inputs at once, but for the last ones of a partition. An input of which it says nothing has no row.
    Null inputs are not given to it. A model that returns another number of results than it got inputs is an error.
    """
    fields = _typed(schema).fields
    kind: DataType = inputs.schema[key].dataType
    out = StructType().add(key, kind).add("place", IntegerType())
    for f in fields:
        out.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, types = None, None
        rows = ((k, v, b.schema) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        while batch := list(islice(rows, size)):
            if model is None:
                model = factory()
            if types is None:
                types = [batch[0][2].field(0).type, pa.int32(), *arrow]
            said = model([v for _, v, _ in batch])
            if len(said) != len(batch):
                raise ValueError(f"the model gave {len(said)} results for {len(batch)} inputs")
            found = [(k, i, *row) for (k, _, _), rows_ in zip(batch, said, strict=True) for i, row in enumerate(rows_)]
            columns = list(zip(*found, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names, arrow = [f.name for f in out.fields], [to_arrow_type(f.dataType) for f in fields]
    return inputs.where(F.col(value).isNotNull()).select(key, value).mapInArrow(run, out)


def content_key(value: str) -> Any:
    """A hash of an input's content, by which it is remembered."""
    return F.sha2(F.to_json(F.struct(F.col(value).alias("v"))).cast("binary"), 256)


def remembered(inputs: DataFrame, key: str, value: str, factory: Factory, schema: str | StructType, memo: str, size: int = 64) -> DataFrame:
    """apply_model through a memo: each distinct input reaches the model once, ever, and all rows that have it get what it said.

    memo: a folder of (content, place, schema's columns), with a row of place -1 for an input of which nothing was said. New
    inputs are those that the memo lacks (an anti join on the hash of their content); what the model says of them is
    appended in one write, and the result is read from the memo. Change the folder with the model.
    """
    spark = inputs.sparkSession
    fields = _typed(schema).fields
    kept = StructType().add("content", StringType()).add("place", IntegerType())
    for f in fields:
        kept.add(f)
    hashed = durable(inputs.where(F.col(value).isNotNull()).select(key, value, content_key(value).alias("content")), "hashed")
    distinct = hashed.groupBy("content").agg(F.any_value(value).alias("input"))
    spark.createDataFrame([], kept).write.mode("append").parquet(memo)  # so that it can be read the first time
    new = durable(distinct.join(spark.read.schema(kept).parquet(memo).select("content"), "content", "left_anti"), "new")
    said = durable(apply_model(new, "content", "input", factory, schema, size), "said")
    silent = new.select("content").join(said, "content", "left_anti").select("content", F.lit(-1).alias("place"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    said.select(*kept.names).unionByName(silent).write.mode("append").parquet(memo)
    known = spark.read.schema(kept).parquet(memo).where("place >= 0")
    return hashed.select(key, "content").join(known, "content").drop("content")


class LoudParts:
    """A toy detector of speech: the runs of frames that are louder than a share of the loudest."""

    def __init__(self, frame: int = 4, share: float = 0.5) -> None:
        self.frame, self.share = frame, share

    def __call__(self, clips: list) -> list[list[tuple[int, int]]]:
        return [self._runs(c) for c in clips]

    def _runs(self, clip: list) -> list[tuple[int, int]]:
        loud = [max(abs(x or 0.0) for x in clip[i : i + self.frame]) for i in range(0, len(clip), self.frame)]
        over = [x > 0 and x >= self.share * max(loud) for x in loud]
        edges = [i for i, (a, b) in enumerate(zip([False, *over], [*over, False], strict=True)) if a != b]
        return [(a * self.frame, min(b * self.frame, len(clip))) for a, b in zip(edges[::2], edges[1::2], strict=True)]
