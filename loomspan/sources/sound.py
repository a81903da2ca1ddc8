"""Sound as a table of slices: media, slice number, samples; every slice of a media but its last has the same size.

A span of sound is put together from the slices that it reaches, so a task holds spans and slices, never a media. A join on
media and slice number brings them together; spans are long or short, at, over and beyond the bounds of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import signals as G


def sliced(sound: DataFrame, size: int, media: str = "media", samples: str = "samples") -> DataFrame:
    """(media, slice, samples) of rows with whole arrays. An empty or null array has no slice."""
    count = F.ceil(F.size(samples) / size).cast("int")
    rows = sound.where(F.size(samples) > 0).select(media, samples, F.explode(F.sequence(F.lit(0), count - 1)).alias("slice"))
    return rows.select(media, F.col("slice").cast("long").alias("slice"), F.slice(samples, F.col("slice") * size + 1, F.lit(size)).alias(samples))


def places(start: Column, end: Column, rate: float, origin: Column | None = None) -> tuple[Column, Column]:
    """(first, last): the samples of a span of seconds, last exclusive; none before 0."""
    at = lambda t: F.greatest(F.lit(0), F.floor(t * rate + 0.5)).cast("long")
    first = at(start)
    return first, F.greatest(first, at(end))


def read(slices: DataFrame, spans: DataFrame, id: str, size: int, media: str = "media", first: str = "first", last: str = "last", samples: str = "samples") -> DataFrame:
    """spans (media, id, first, last, ...) with samples: the media's samples from first up to last, as slices of its whole array would be.

    id is unique. What lies beyond the end of a media is cut, and a span without any sample has an empty array; bounds that are
    null give null. A slice that is missing inside a span ends it there, so that samples never move to another time.
    """
    wanted = spans.where(F.col(last) > F.col(first)).select(media, id, first, last, F.explode(F.sequence(F.floor(F.col(first) / size), F.floor((F.col(last) - 1) / size))).alias("slice"))
    met = wanted.join(slices.select(media, "slice", F.col(samples).alias("_own")), [media, "slice"])
    low = F.greatest(F.col(first) - F.col("slice") * size, F.lit(0)).cast("int")
    high = F.least(F.col(last) - F.col("slice") * size, F.lit(size)).cast("int")
    parts = met.select(id, F.floor(F.col(first) / size).alias("_from"), F.struct("slice", F.slice("_own", low + 1, F.greatest(high - low, F.lit(0))).alias("part")).alias("_p"))
    whole = parts.groupBy(id).agg(F.array_sort(F.collect_list("_p")).alias("_parts"), F.first("_from").alias("_from"))
    joined = F.filter("_parts", lambda p, i: p["slice"] == F.col("_from") + i)
    whole = whole.select(id, F.flatten(F.transform(joined, lambda p: p["part"])).alias(samples))
    empty = F.array().cast(slices.schema[samples].dataType)
    return spans.join(whole, id, "left").withColumn(samples, F.when(F.col(first).isNotNull() & F.col(last).isNotNull(), F.coalesce(samples, empty)))


def refined(slices: DataFrame, spans: DataFrame, id: str, size: int, rate: int, duration: Column, gap: float, frame: float = 0.01, media: str = "media") -> DataFrame:
    """(media, start, end): signals.refine_edges for spans (media, id, start, end in seconds) of sliced sound.

    Only the samples that the edges can move over are read: eight frames around each edge, as two short spans.
    """
    reach = 9 * frame
    around = spans.select(media, id, "start", "end", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("edge"))
    at = F.when(F.col("edge") == "start", F.col("start")).otherwise(F.col("end"))
    first, last = places(at - reach, at + reach, rate)
    around = around.select(media, F.struct(id, "edge").alias("_id"), "start", "end", "edge", first.alias("first"), last.alias("last"))
    heard = read(slices, around, "_id", size, media).withColumn("origin", F.col("first") / rate)
    step = round(frame * rate)
    place = lambda c: F.bround((F.col(c) - F.col("origin")) * rate).cast("int")
    moved = heard.select(media, "_id", "start", "end", "edge", F.when(F.col("edge") == "start", G.quietest(F.col("samples"), place("start"), -step)).otherwise(G.quietest(F.col("samples"), place("end"), step)).alias("by"))
    both = moved.groupBy(media, F.col(f"_id.{id}").alias(id)).agg(F.first("start").alias("start"), F.first("end").alias("end"), F.max(F.when(F.col("edge") == "start", F.col("by"))).alias("down"), F.max(F.when(F.col("edge") == "end", F.col("by"))).alias("up"))
    edges = both.select(media, F.greatest(F.lit(0.0), F.col("start") + F.col("down") / rate).alias("start"), F.least(duration, F.col("end") + F.col("up") / rate).alias("end"))
    return G.merge_spans(edges, [media], gap)


def compared(ours: DataFrame, theirs: DataFrame, spans: DataFrame, id: str, size: int, rate: int, most: int, context: float = 1.0, media: str = "media", least: float = 0.5) -> DataFrame:
    """(media, same, correlation, lag, compared): signals.same_dialogue for spans (media, id, start, end) of two sliced streams, with some seconds around."""
    first, last = places(F.col("start") - context, F.col("end") + context, rate)
    asked = spans.select(media, id, first.alias("first"), last.alias("last"))
    a = read(ours, asked, id, size, media).select(media, id, F.col("samples").alias("a"))
    b = read(theirs, asked, id, size, media).select(id, F.col("samples").alias("b"))
    return G.same_dialogue(a.join(b, id), [media], most, rate, least)
