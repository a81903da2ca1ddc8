"""Interval algebra on timelines: spans (keys, start, end) of any numeric type, keyed by a media id.

Closed tests let spans that touch meet (a.start <= b.end and b.start <= a.end); open ones do not. Every operator works
within its keys; joins are equi-joins on keys and time bins with the exact test behind them, never products.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

Keys = Sequence[str]


def _bucketed(df: DataFrame, keys: Keys, start: str, bucket: float) -> DataFrame:
    """df with _k: its keys and the time bucket in which a row starts. Null starts are a bucket of their own, before the others."""
    return df.withColumn("_k", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.floor(F.col(start) / bucket).alias("bucket")))


def _carry(rows: DataFrame, n_keys: int, summaries: dict[str, tuple[Column, Callable[[str], Column]]], backwards: bool = False) -> DataFrame:
    """rows (with _k) with what the earlier buckets of their keys hand on; with backwards, the later ones.

    summaries: of each new column, the aggregate that sums up a bucket, and how those of buckets are put together, given the
    column of bucket sums. Only one row a bucket is ever sorted by keys; the rows meet it by the key that they are dealt by.
    """
    sums = rows.groupBy("_k").agg(*(each.alias(name) for name, (each, _) in summaries.items()))
    order = F.col("_k.bucket").desc_nulls_last() if backwards else F.col("_k.bucket").asc_nulls_first()
    before = Window.partitionBy(*(f"_k.k{i}" for i in range(n_keys))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums.select("_k", *(together(name).over(before).alias(name) for name, (_, together) in summaries.items())), "_k")


def islands(df: DataFrame, keys: Keys, gap: float = 0, closed: bool = False, reach: str = "max", start: str = "start", end: str = "end", tie: Keys = (), out: str = "island", bucket: float | None = None) -> DataFrame:
    """df with the number of each row's island in its keys.

    A row joins the one before if start - reached is below gap (closed: not above it). reached is the largest end so far
    (reach = "max") or the end of the row before ("last"). Rows are taken by start, end and the columns of tie.

    bucket: a length of time, for timelines of any length. Each task then sorts the rows that start in one bucket; what has been
    reached before a bucket, and how many islands begin before it, come from summaries of the buckets. The result is the same.
    """
    order = Window.partitionBy(*(["_k"] if bucket else keys)).orderBy(start, end, *tie)
    rows = _bucketed(df, keys, start, bucket) if bucket else df
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(end).over(before) if reach == "max" else F.lag(end).over(order)
    if bucket:
        last = (F.max(end), F.max) if reach == "max" else (F.max_by(end, F.struct(start, end, *tie)), lambda c: F.last(c))
        rows = _carry(rows.withColumns({"_own": reached, "_first": F.row_number().over(order) == 1}), len(keys), {"_carried": last})
        reached = F.greatest("_own", "_carried") if reach == "max" else F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own"))
    away = F.col(start) - reached
    rows = rows.withColumn(out, F.coalesce(reached.isNull() | (away > gap if closed else away >= gap), F.lit(False)).cast("int"))
    if bucket:
        rows = _carry(rows, len(keys), {"_before": (F.sum(out), F.sum)})
    number = F.sum(out).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if not bucket:
        return rows.withColumn(out, number)
    return rows.withColumn(out, number + F.coalesce("_before", F.lit(0))).drop("_k", "_own", "_first", "_carried", "_before")


def merge_spans(df: DataFrame, keys: Keys, gap: float = 0, closed: bool = False, reach: str = "max", start: str = "start", end: str = "end", aggregates: Sequence[Column] = (), bucket: float | None = None) -> DataFrame:
    """(keys, start, end, aggregates): one row for each island. bucket: as in islands."""
    rows = islands(df, keys, gap, closed, reach, start, end, out="_island", bucket=bucket)
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates).drop("_island")


def repeated(df: DataFrame, keys: Keys, text: str, gap: float, start: str = "start", end: str = "end", tie: Keys = (), bucket: float | None = None) -> DataFrame:
    """(keys, text, start, end, n): neighbours of equal text become one where no more than a gap parts them. bucket: as in islands."""
    rows = _bucketed(df, keys, start, bucket) if bucket else df
    order = Window.partitionBy(*(["_k"] if bucket else keys)).orderBy(start, end, *tie)
    rows = rows.withColumns({"_reach": F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_text": F.lag(F.struct(text)).over(order)})
    if bucket:
        last = F.max_by(F.struct(text), F.struct(start, end, *tie))
        rows = _carry(rows, len(keys), {"_c_reach": (F.max(end), F.max), "_c_text": (last, lambda c: F.last(c))})
        rows = rows.withColumns({"_reach": F.greatest("_reach", "_c_reach"), "_text": F.coalesce("_text", "_c_text")})
    before = F.col(f"_text.{text}")
    new = before.isNull() | (before != F.col(text)) | (F.col(start) > F.col("_reach") + gap)
    rows = rows.withColumn("_new", new.cast("int"))
    number = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    if bucket:
        rows = _carry(rows, len(keys), {"_before": (F.sum("_new"), F.sum)})
        number = number + F.coalesce("_before", F.lit(0))
    rows = rows.withColumn("_g", number)
    return rows.groupBy(*keys, text, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_g")


def runs(df: DataFrame, keys: Keys, pos: str) -> DataFrame:
    """(keys, first, last, n): runs of neighbouring places; last is exclusive."""
    rows = df.withColumn("_run", F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
    return rows.groupBy(*keys, "_run").agg(F.min(pos).alias("first"), (F.max(pos) + 1).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def runs_within(holds: Column) -> Column:
    """runs of one row's places, array<struct<first,last,n>>: of the places of an array of booleans those that hold. No row leaves its task."""

    @F.arrow_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("n", LongType())])))
    def found(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(begins[-1] + len(sizes), np.int8)  # a place that does not hold stands behind each row
        row = np.repeat(np.arange(len(sizes)), sizes)
        flat[np.arange(begins[-1]) + row] = lists.flatten().fill_null(False).to_numpy(zero_copy_only=False)
        step = np.diff(flat, prepend=np.int8(0))
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        of = np.searchsorted(begins[1:] + np.arange(1, len(sizes) + 1), first, "right")
        base = (begins[:-1] + np.arange(len(sizes)))[of]
        fields = [pa.array(first - base, pa.int32()), pa.array(last - base, pa.int32()), pa.array(last - first, pa.int64())]
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["first", "last", "n"]))

    return found(holds)


def running_reach(df: DataFrame, keys: Keys, tie: Keys = (), start: str = "start", end: str = "end", bucket: float | None = None) -> DataFrame:
    """df with the largest end so far (reach) and a number from 1, in order of time. bucket: as in islands."""
    rows = _bucketed(df, keys, start, bucket) if bucket else df
    order = Window.partitionBy(*(["_k"] if bucket else keys)).orderBy(start, end, *tie)
    rows = rows.withColumns({"reach": F.max(end).over(order.rowsBetween(Window.unboundedPreceding, 0)), "number": F.row_number().over(order)})
    if not bucket:
        return rows
    rows = _carry(rows, len(keys), {"_reach": (F.max(end), F.max), "_n": (F.count(F.lit(1)), F.sum)})
    return rows.withColumns({"reach": F.greatest("reach", "_reach"), "number": F.col("number") + F.coalesce("_n", F.lit(0))}).drop("_k", "_reach", "_n")


def fade_of(start: Column, end: Column, most: float) -> Column:
    """A fade of a span: a third of it at most."""
    return F.least(F.lit(most), (end - start) / 3)


def core(df: DataFrame, margin: float, least: float, start: str = "start", end: str = "end") -> DataFrame:
    """Spans without a margin at either end, where so much is left."""
    rows = df.withColumns({start: F.col(start) + margin, end: F.col(end) - margin})
    return rows.where(F.col(end) - F.col(start) >= least)


def lengths(df: DataFrame, keys: Keys, runtime: Column, *reasons: tuple[str, Column], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, seconds, coverage, one count for each reason): how long spans are together, and what share of the runtime."""
    total = F.sum(F.col(end) - F.col(start))
    return df.groupBy(*keys).agg(total.alias("seconds"), (total / F.max(runtime)).alias("coverage"), *(F.count_if(c).alias(name) for name, c in reasons))


def touching(pieces: DataFrame, spans: DataFrame, keys: Keys, size: float, id: str, collected: Sequence[Column], b: Keys = ("r_start", "r_end")) -> DataFrame:
    """(id, collected): what of spans (keys, *b, ...) overlaps each piece, aggregated."""
    return overlap_join(pieces, spans, keys, size, b=b).groupBy(id).agg(*collected)


def pad_interval(start: Column, end: Column, before: float, after: float, least: float, limit: Column | None = None) -> tuple[Column, Column]:
    """A padded span of at least `least`, grown around its middle; at the edges of 0..limit it is shifted, then cut."""
    low, high = start - before, F.greatest(end, start) + after
    lack = F.greatest(F.lit(least) - (high - low), F.lit(0))
    low = low - lack / 2
    high = high + lack / 2
    shift = F.greatest(-low, F.lit(0))
    low, high = low + shift, high + shift
    if limit is not None:
        over = F.greatest(high - limit, F.lit(0))
        low, high = F.greatest(low - over, F.lit(0)), F.least(high, limit)
    return low, high


def split_spans(df: DataFrame, most: float, overlap: float, start: str = "start", end: str = "end", piece: str = "piece") -> DataFrame:
    """Spans longer than `most` become equal pieces of at most that length that overlap; the last end is exact."""
    shared = min(overlap, most / 4)
    length = F.col(end) - F.col(start)
    count = F.when(length <= most, 1).otherwise(F.ceil((length - shared) / (most - shared))).cast("int")
    step = (length - shared) / F.col("_n")
    rows = df.withColumn("_n", count).withColumn(piece, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low = F.col(start) + F.col(piece) * step
    rows = rows.withColumns({"_low": F.when(F.col("_n") == 1, F.col(start)).otherwise(low), "_high": F.when(F.col(piece) == F.col("_n") - 1, F.col(end)).otherwise(low + step + shared)})
    return rows.drop(start, end, "_n").withColumnsRenamed({"_low": start, "_high": end})


def _level(low: str, high: str, size: float, base: int) -> Column:
    """The power of base by which size must grow to hold a span."""
    above = F.log(F.greatest(F.col(high) - F.col(low), F.lit(size)) / size) / math.log(base)
    return F.ceil(above - 1e-9).cast("int")


def dealt(df: DataFrame, low: str, high: str, size: float, base: int, role: int, others: Column, from_: int) -> DataFrame:
    """df with (_role, _level, _bin): spans in the bins of their own level, in a role, and in the other role (3 - role) in those
    of each level of others (an array) that is at least from_ above their own. Two bins a level at most."""
    rows = df.withColumns({"_own": _level(low, high, size, base), "_others": others})
    levels = F.transform(F.filter("_others", lambda x: x >= F.col("_own") + from_), lambda x: F.struct(F.lit(3 - role).alias("role"), x.alias("level")))
    rows = rows.withColumn("_at", F.explode(F.concat(F.array(F.struct(F.lit(role).alias("role"), F.col("_own").alias("level"))), levels)))
    width = size * F.pow(F.lit(float(base)), F.col("_at.level"))
    rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.greatest(low, high) / width).cast("long"))))
    return rows.withColumns({"_role": F.col("_at.role"), "_level": F.col("_at.level")}).drop("_at", "_own", "_others")


def overlap_join(left: DataFrame, right: DataFrame, keys: Keys, size: float, closed: bool = False, a: Keys = ("start", "end"), b: Keys = ("r_start", "r_end"), base: int = 4) -> DataFrame:
    """Pairs of overlapping spans; the right side's other columns must not clash with the left's.

    Spans are dealt to time bins near their own length: size for those up to size (level 0), else size times the power
    of base (the level) that is not below it, so a span reaches two bins of its level at most. Two spans meet at the level
    of the longer one, where the shorter one is dealt to two bins at most as well; only levels that the other side has
    are used (a set of some small numbers, found by a subquery). So rows grow with the number of spans, whatever their
    lengths, and a pair comes from the first bin that both reach. size should be about the length of usual spans.
    A bin of a very long span may hold very many short ones; adaptive execution splits it.
    """
    levels = lambda df, low, high: F.coalesce(df.agg(F.collect_set(_level(low, high, size, base)).alias("levels")).scalar(), F.array().cast("array<int>"))
    lows = dealt(left, *a, size, base, 1, levels(right, *b), 1)
    rows = dealt(right, *b, size, base, 2, levels(left, *a), 0)
    meets = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) if closed else (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    width = size * F.pow(F.lit(float(base)), F.col("_level"))
    once = F.col("_bin") == F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    return lows.join(rows, [*keys, "_role", "_level", "_bin"]).where(meets & once).drop("_role", "_level", "_bin")


def overlap_filter(left: DataFrame, right: DataFrame, keys: Keys, size: float, id: str, closed: bool = False, anti: bool = False, a: Keys = ("start", "end"), b: Keys = ("r_start", "r_end")) -> DataFrame:
    """Rows of left (unique by id) that some span of right meets; with anti, those that none does."""
    hit = overlap_join(left.select(*keys, id, *a), right.select(*keys, *b), keys, size, closed, a, b).select(id).distinct()
    return left.join(hit, id, "left_anti" if anti else "left_semi")


def difference(regions: DataFrame, cover: DataFrame, keys: Keys, id: str, least: float = 0, size: float = 3600, start: str = "start", end: str = "end", bucket: float | None = None) -> DataFrame:
    """(keys, id, start, end): what of each region (unique by id) no span of cover covers, in pieces of at least `least`.

    The cover is merged, and what it leaves free between two spans, before the first and behind the last (as far as the keys'
    regions reach) is joined with the regions. bucket: as in islands.
    """
    plain = {k: f"_k{i}" for i, k in enumerate(keys)}
    merged = merge_spans(cover.select(*keys, start, end), keys, 0, True, "max", start, end, bucket=bucket)
    reach = regions.groupBy(*keys).agg(F.min(start).alias("_low"), F.max(end).alias("_high"))
    if bucket:
        rows = _bucketed(merged, keys, start, bucket)
        rows = rows.withColumn("_next", F.lead(start).over(Window.partitionBy("_k").orderBy(start)))
        rows = _carry(rows, len(keys), {"_later": (F.min(start), F.min)}, backwards=True).withColumn("_next", F.coalesce("_next", "_later")).drop("_k", "_later")
    else:
        rows = merged.withColumn("_next", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))
    first = merged.groupBy(*keys).agg(F.min(start).alias("_first"))
    same = lambda other: reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(p)) for k, p in plain.items()))
    ends = first.withColumnsRenamed(plain)
    leading = reach.join(ends, same(ends), "left").select(*keys, F.col("_low").alias("_gs"), F.coalesce("_first", "_high").alias("_ge"))
    bounds = reach.withColumnsRenamed(plain)
    between = rows.join(bounds, same(bounds)).select(*keys, F.col(end).alias("_gs"), F.coalesce("_next", "_high").alias("_ge"))
    free = leading.unionByName(between).where("_ge > _gs")
    pieces = overlap_join(regions.select(*keys, id, start, end), free, keys, size, False, (start, end), ("_gs", "_ge"))
    pieces = pieces.select(*keys, id, F.greatest(start, "_gs").alias(start), F.least(end, "_ge").alias(end))
    return pieces.where((F.col(end) - F.col(start) >= least) & (F.col(end) > F.col(start)))


def nearest(left: DataFrame, right: DataFrame, keys: Keys, id: str, at: str, to: str, within: float, tie: str) -> DataFrame:
    """left joined to the row of right in its keys whose `to` is nearest to `at`, not further than `within`; ties by `tie`.

    Bins of `within` make it an equi-join with three bins of the right side.
    """
    size = within if within > 0 else 1
    lows = left.withColumn("_bin", F.floor(F.col(at) / size))
    near = right.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(to) / size) + i)))
    away = F.abs(F.col(at) - F.col(to))
    pairs = lows.select(*keys, id, at, "_bin").join(near, [*keys, "_bin"]).where(away <= within)
    rest = [c for c in right.columns if c not in keys]
    best = pairs.groupBy(id).agg(F.min_by(F.struct(*rest), F.struct(away, F.col(tie))).alias("_best"))
    return left.join(best.select(id, "_best.*"), id, "left")


def next_start(left: DataFrame, right: DataFrame, keys: Keys, at: str, to: str, out: str, bucket: float | None = None) -> DataFrame:
    """left with the smallest `to` of right in its keys that is above `at`: a forward as-of join in one sorted pass.

    bucket: as in islands; a row without a later `to` in its bucket takes the smallest of the buckets behind.
    """
    rows = left.withColumns({"_t": F.col(at), "_mark": F.lit(None).cast(right.schema[to].dataType)})
    marks = right.select(*keys, F.col(to).alias("_t"), F.col(to).alias("_mark"))
    both = rows.withColumn("_left", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    both = _bucketed(both, keys, "_t", bucket) if bucket else both
    ahead = Window.partitionBy(*(["_k"] if bucket else keys)).orderBy(F.desc("_t"), F.col("_mark").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(out, F.last("_mark", True).over(ahead))
    if bucket:
        both = _carry(both, len(keys), {"_later": (F.min("_mark"), F.min)}, backwards=True).withColumn(out, F.coalesce(out, "_later")).drop("_k", "_later")
    return both.where("_left").drop("_t", "_mark", "_left")


def dedupe(df: DataFrame, keys: Keys, confidence: str, start: str = "start", end: str = "end", tie: str = "id") -> DataFrame:
    """Greedy in order of time: a row that meets (closed) a kept row of its keys is dropped, or replaces it if surer.

    Rows alone in their island are kept at once. The rows of an island come one after the other; kept rows that end
    before the present one starts can't be met any more and leave, so a task holds those that reach this far.
    """
    rows = islands(df, keys, 0, True, "max", start, end, [tie], "_island")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_island")))
    alone = rows.where("_n = 1").select(*df.columns)
    rest = rows.where("_n > 1").withColumn("_key", F.struct(*keys, "_island")).drop("_n", "_island")
    rest = rest.repartition("_key").sortWithinPartitions("_key", start, end, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, open_ = None, []  # of each kept row: end, start, confidence, the row
        for batch in batches:
            out = []
            for i, (key, a, b, sure) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", start, end, confidence)), strict=True)):
                if key != island:
                    out += [k[3] for k in open_]
                    island, open_ = key, []
                out += [k[3] for k in open_ if k[0] < a]
                open_ = [k for k in open_ if k[0] >= a]
                hit = next((k for k in open_ if k[1] <= b), None)
                if hit is None:
                    open_.append([b, a, sure, batch.slice(i, 1)])
                elif sure > hit[2]:
                    hit[:] = [b, a, sure, batch.slice(i, 1)]
            yield from out
        yield from (k[3] for k in open_)

    kept = rest.mapInArrow(run, rest.schema).select(*df.columns)
    return alone.unionByName(kept)
