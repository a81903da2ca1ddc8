"""Mixing sources to target weights along a time-varying curriculum.

A source's weight in training changes with progress from 0 to 1, linearly between knots. Its share of the words is its
base weight's, capped at some epochs of its size, the excess being shared by weight among the others. Its schedule,
integrated and scaled to that share, is the number of its words wanted up to each moment. A document's words hold a range
of the source's stream (documents in the order of a hash of their contents, over again for a second epoch); inverting the
wanted number at the range's start gives its training position, and rows are range-sorted by it.

All of it are DataFrame functions. The stream's running sums are made in two steps, in buckets of the hash and over the
buckets' totals, so that no task holds a source; equal rows are counted first, and share a range.

Defined results: a null text has no words; a null source is a source of its own, after all others; documents that the mix
does not take have no position and come last; equal rows (source, doc_id, text) are interchangeable; rows that differ get
the same result in every run, however the input is split; texts of any length are counted whole; an empty table gives an
empty one. Columns other than doc_id, source and text are only carried by training_rows, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import durable

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (3, 1, 2)  #: of sources by code point, null last; repeats
    total: float = 1.5  #: words of the mix, in those of all sources
    epochs: float = 2.0  #: words of a source at most, in its own
    #: factors of the weight at equally spaced moments from 0 to 1, for sources by code point; repeats
    schedules: tuple[tuple[float, ...], ...] = ((1.0, 1.0), (0.25, 1.0, 2.0), (2.0, 1.0, 0.5))
    bucket: int = 50_000  #: documents of a bucket, about
    seed: int = 17


def targets(sizes: DataFrame, o: MixOptions) -> DataFrame:
    """sizes (source, source_size: one row for each source) with number, target and schedule.

    The windows here run over sources, not over documents: one task sorts them, a row of a few numbers for each, which
    holds for millions of sources.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("number", F.row_number().over(order) - 1)
    weights = F.array(*(F.lit(float(w)) for w in o.weights))
    schedules = F.array(*(F.array(*(F.lit(float(f)) for f in s)) for s in o.schedules))
    rows = rows.withColumn("weight", F.get(weights, (F.col("number") % len(o.weights)).cast("int")))
    rows = rows.withColumn("schedule", F.get(schedules, (F.col("number") % len(o.schedules)).cast("int")))
    rows = rows.withColumn("cap", o.epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # the sources that reach their cap first are capped while the level of the others is not below theirs
    by_ratio = Window.orderBy("ratio", "number")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (o.total * F.sum("source_size").over(everything) - before) / left
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    open_ = F.when(F.col("level") < F.col("ratio"), F.struct("place", "level"))
    rows = rows.withColumn("level", F.min(open_).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return rows.withColumn("target", target).select("source", "source_size", "number", "target", "schedule")


def position(schedule: Column, share: Column) -> Column:
    """The moment at which a schedule has asked for a share (0 to 1) of all its words."""
    steps = F.size(schedule) - 1
    width = 1 / steps
    areas = F.transform(F.sequence(F.lit(1), steps), lambda i: (F.get(schedule, i - 1) + F.get(schedule, i)) / 2 * width)
    sums = F.aggregate(areas, F.array(F.lit(0.0)), lambda s, a: F.concat(s, F.array(F.element_at(s, -1) + a)))
    wanted = share * F.element_at(sums, -1)
    k = F.least(F.greatest(F.size(F.filter(sums, lambda s: s <= wanted)) - 1, F.lit(0)), steps - 1)
    rest = wanted - F.get(sums, k)
    w = F.get(schedule, k)
    slope = (F.get(schedule, k + 1) - w) / width
    root = F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * rest))
    return F.least(F.lit(1.0), k * width + F.when(rest > 0, 2 * rest / (w + root)).otherwise(0.0))


def clamp(x: Column, high: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(high, x))


def mix(docs: DataFrame, options: MixOptions = MixOptions(), row: Column | None = None) -> DataFrame:
    """One row for each row of docs, sorted by position.

    Columns: doc_id, source, size, source_size, target, taken, position (of the first placement), placements, the hashes
    that order a source's stream (_a, _b), and the row's number (_row: row of docs if given, else a new one). placements:
    (epoch, words, position) for each time that the mix takes words of the document. Where a source's stream ends inside a document, its first words
    are meant.
    """
    o = options
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), number.alias("_row"))
    same = [F.col("source").isNull(), "source", F.col("doc_id").isNull(), "doc_id", "crc", "size"]
    rows = rows.withColumns({"_a": F.xxhash64(F.lit(o.seed), *same), "_b": F.xxhash64(F.lit(o.seed + 1), *same)}).drop("crc")
    rows = durable(rows, "sizes")
    groups = durable(rows.groupBy("_a", "_b", "source", "size").agg(F.count(F.lit(1)).alias("n")), "groups")
    sizes = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count(F.lit(1)).alias("held"))
    bits = F.least(F.lit(40), F.greatest(F.lit(1), F.ceil(F.log2(F.col("held") / o.bucket)))).cast("int")
    known = durable(targets(sizes.drop("held"), o).join(sizes.select("source", bits.alias("bits")).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "targets")
    groups = groups.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    groups = groups.withColumns({"bucket": F.expr("shiftright(_a, 64 - bits)"), "words": F.col("n") * F.col("size")})
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("number", "bucket").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("number", "bucket").agg(F.sum("words").alias("all")).select("number", "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    groups = groups.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(starts, ["number", "bucket"])
    groups = groups.select("_a", "_b", "n", "source_size", "target", "schedule", (F.col("offset") + F.col("inside")).alias("start"))
    # equal rows: each gets its place among them, counted in two steps
    part = F.shiftright("_row", 33)
    counts = rows.groupBy("_a", "_b", part.alias("part")).agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("_a", "_b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    many = groups.where("n > 1").select("_a", "_b")
    counts = counts.join(many, ["_a", "_b"], "left_semi").withColumn("earlier", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    twins = rows.select("_a", "_b", "_row", part.alias("part")).join(counts, ["_a", "_b", "part"])
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("_a", "_b", "part").orderBy("_row")) - 1
    places = twins.withColumn("place", place).select("_row", "place")
    out = rows.join(groups, ["_a", "_b"]).join(places, "_row", "left").withColumn("begin", F.col("start") + F.coalesce("place", F.lit(0)) * F.col("size"))
    wanted = F.round("target").cast("long")
    epochs = []
    for epoch in range(-int(-o.epochs // 1)):
        stream = F.col("begin") + epoch * F.col("source_size")
        words = clamp(wanted - stream, F.col("size"))
        epochs.append(F.struct(F.lit(epoch + 1).alias("epoch"), words.alias("words"), position(F.col("schedule"), F.try_divide(stream.cast("double"), F.col("target"))).alias("position")))
    out = out.withColumn("placements", F.filter(F.array(*epochs), lambda p: p["words"] > 0))
    out = out.withColumn("taken", F.aggregate("placements", F.lit(0).cast("long"), lambda s, p: s + p["words"])).withColumn("position", F.get("placements", F.lit(0))["position"])
    out = durable(out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "placements", "_a", "_b", "_row"), "mix")
    return out.orderBy(F.asc_nulls_last("position"), "_a", "_b")


def training_rows(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The rows of docs as training reads them: once for each placement, in the order of positions, with docs' columns.

    Where a placement takes a part of a document, text holds its first words with single spaces, and n_chars, if there is
    one, the length of that. Rows are numbered once and written with their numbers, so both sides of the join read the same ones.
    """
    o = options
    columns = docs.columns
    # all of a row in one column, so that no name of docs can clash
    held = durable(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_doc")), "numbered")
    of = held.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), F.col("_doc.text").alias("text"))
    placed = mix(of, o, F.col("_row")).where("taken > 0").select("_row", F.explode("placements").alias("_p"), F.col("size").alias("_size"), "_a", "_b")
    rows = held.join(placed, "_row")
    part = F.col("_p.words") < F.col("_size")
    whole = F.coalesce(F.col("_doc.text").cast("string"), F.lit(""))
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), 1, F.col("_p.words").cast("int")), " ")
    rows = rows.withColumn("_text", F.when(part, cut).otherwise(F.col("_doc.text")))
    new = {"text": F.col("_text"), "n_chars": F.when(part, F.length("_text").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in columns else None}
    return rows.orderBy("_p.position", "_a", "_b").select(*((F.col("_doc")[c] if new.get(c) is None else new[c]).alias(c) for c in columns))
