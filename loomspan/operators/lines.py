"""Lines of dialogue against words, sounds and cached spans; times in any numeric type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.spans import difference, merge_spans, overlap_filter, overlap_join


def to_media(time: Column, scale: Column, offset: Column) -> Column:
    return scale * time + offset


def grow(start: Column, end: Column, least: float, limit: Column) -> tuple[Column, Column]:
    """A window of at least `least` around its middle, shifted at the edges of 0..limit, then cut."""
    lack = F.greatest(F.lit(least) - (end - start), F.lit(0))
    low = start - lack / 2
    high = low + F.greatest(end - start, F.lit(least))
    high = high + F.greatest(-low, F.lit(0))
    low = F.greatest(low, F.lit(0))
    low = low - F.greatest(high - limit, F.lit(0))
    return F.greatest(low, F.lit(0)), F.least(high, limit)


def fill_gap(low: Column, high: Column, start: Column, end: Column, margin: float, least: float) -> tuple[Column, Column]:
    """A gap of a window start..end with a margin, of at least `least`, shifted to stay inside the window."""
    a, b = F.greatest(low - margin, start), F.least(high + margin, end)
    short = F.greatest(F.lit(least) - (b - a), F.lit(0))
    a = F.greatest(a - short / 2, start)
    b = F.least(F.greatest(b, a + least), end)
    return F.greatest(F.least(a, b - least), start), b


def estimates(cues: DataFrame, pad: float, confidence: float = 0.2) -> DataFrame:
    """cues (media, cue, start, end, text, words: array<struct<first,last,term>>): a padded span by share of characters for each word."""
    rows = cues.withColumn("_w", F.explode("words"))
    size = F.greatest(F.length("text"), F.lit(1))
    at = lambda c: F.col("start") + (F.col("end") - F.col("start")) * F.col(c) / size
    return rows.select("media", "cue", F.col("_w.term").alias("term"), (at("_w.first") - pad).alias("start"), (at("_w.last") + pad).alias("end"), F.lit(confidence).alias("confidence"))


def with_sounds(cues: DataFrame, sounds: DataFrame, keys: Sequence[str], id: str, size: float) -> DataFrame:
    """cues with their sounds in order, and a line of its own (no id, no text) for each sound that no cue meets.

    sounds: keys, sound_id, r_start, r_end, sound.
    """
    pairs = overlap_join(cues, sounds, keys, size).groupBy(id).agg(F.array_sort(F.collect_list(F.struct("r_start", "sound_id", "sound"))).alias("_s"))
    heard = cues.join(pairs, id, "left").withColumn("sounds", F.array_distinct(F.transform(F.coalesce("_s", F.array().cast("array<struct<r_start:double,sound_id:long,sound:string>>")), lambda s: s["sound"]))).drop("_s")
    alone = overlap_filter(sounds, cues, keys, size, "sound_id", anti=True, a=("r_start", "r_end"), b=("start", "end"))
    own = alone.select(*keys, F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.array("sound").alias("sounds"))
    return heard.unionByName(own, allowMissingColumns=True)


def uncovered_words(words: DataFrame, cues: DataFrame, keys: Sequence[str], id: str, margin: float, size: float) -> DataFrame:
    """Words whose middle lies in no cue, give or take a margin."""
    middle = words.withColumn("_m", (F.col("start") + F.col("end")) / 2)
    wide = cues.select(*keys, (F.col("start") - margin).alias("r_start"), (F.col("end") + margin).alias("r_end"))
    return overlap_filter(middle, wide, keys, size, id, closed=True, anti=True, a=("_m", "_m")).drop("_m")


def line_words(lines: DataFrame, words: DataFrame, keys: Sequence[str], id: str, margin: float, size: float) -> DataFrame:
    """lines with the span of the words whose middle lies in them, give or take a margin; their own span where there are none."""
    middle = words.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("_m"), F.col("start").alias("_ws"), F.col("end").alias("_we"))
    wide = lines.select(*keys, id, (F.col("start") - margin).alias("_ls"), (F.col("end") + margin).alias("_le"))
    found = overlap_join(wide, middle, keys, size, True, ("_ls", "_le"), ("_m", "_m")).groupBy(id).agg(F.min("_ws").alias("_a"), F.max("_we").alias("_b"))
    return lines.join(found, id, "left").withColumns({"heard": F.col("_a").isNotNull(), "start": F.coalesce("_a", "start"), "end": F.coalesce("_b", "end")}).drop("_a", "_b")


def sentences(words: DataFrame, keys: Sequence[str], pause: float, tie: str, ends: str = r"[.!?…]$") -> DataFrame:
    """(keys, start, end, text, n): words cut where a pause lasts or the word before ends a sentence."""
    order = Window.partitionBy(*keys).orderBy("start", "end", tie)
    last, said = F.lag("end").over(order), F.lag("text").over(order)
    new = last.isNull() | (F.col("start") - last >= pause) | F.rlike(said, F.lit(ends))
    rows = words.withColumn("_new", new.cast("int")).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", F.col(tie).alias("_tie"), "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*keys, "_s").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end", F.col(tie).alias("_tie"))).alias("end"), text.alias("text"), F.count(F.lit(1)).alias("n")).drop("_s")


def inner_words(words: DataFrame, start: str, end: str, margin: float, clean_start: Column, clean_end: Column) -> DataFrame:
    """Words (with their window's bounds) that do not lie at an unclean edge of it."""
    low = F.when(clean_start, F.col(start)).otherwise(F.col(start) + margin)
    high = F.when(clean_end, F.col(end)).otherwise(F.col(end) - margin)
    return words.where((F.col("start") >= low) & (F.col("end") <= high))


def middles(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pieces with keep_from and keep_to: words belong to the piece up to the middle of each overlap with its neighbours."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    return pieces.withColumns({"keep_from": (F.lag("end").over(order) + F.col("start")) / 2, "keep_to": (F.col("end") + F.lead("start").over(order)) / 2})


def cached(windows: DataFrame, spans: DataFrame, keys: Sequence[str], id: str, size: float, slack: float = 0) -> tuple[DataFrame, DataFrame]:
    """(pieces, gaps) of windows: what cached spans give, clipped, and what is still to be computed."""
    right = spans.select(*keys, F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    pieces = overlap_join(windows.select(*keys, id, "start", "end"), right, keys, size, False, ("start", "end"), ("_cs", "_ce"))
    pieces = pieces.select(*keys, id, F.greatest("start", "_cs").alias("start"), F.least("end", "_ce").alias("end"))
    return pieces, difference(windows, spans, keys, id, slack, size)


def containing(windows: DataFrame, spans: DataFrame, keys: Sequence[str], id: str, size: float, slack: float, order: str) -> DataFrame:
    """windows with the first span (by order) that contains them, give or take a slack; null where none does."""
    right = spans.select(*keys, F.col("start").alias("_cs"), F.col("end").alias("_ce"), F.col(order).alias("_o"))
    hits = overlap_join(windows.select(*keys, id, "start", "end"), right, keys, size, True, ("start", "end"), ("_cs", "_ce"))
    best = hits.where((F.col("_cs") <= F.col("start") + slack) & (F.col("_ce") >= F.col("end") - slack)).groupBy(id).agg(F.min("_o").alias("source"))
    return windows.join(best, id, "left")


def evenly(df: DataFrame, keys: Sequence[str], most: int, *order: str) -> DataFrame:
    """At most so many rows of each group, evenly spaced from the first to the last; halves go to the even place."""
    rows = df.withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    step = (F.col("_n") - 1) / (most - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * step))
    return rows.where((F.col("_n") <= most) | F.array_contains(wanted, F.col("_i").cast("double"))).drop("_i", "_n")


def normalized(spans: DataFrame, keys: Sequence[str], gap: float = 0.05, least: float = 0.06) -> DataFrame:
    """Spans lengthened to a least length, then merged where less than a gap parts them."""
    return merge_spans(spans.withColumn("end", F.greatest("end", F.col("start") + least)), keys, gap)


def widen(start: Column, end: Column, aligned_start: Column, aligned_end: Column, most: float = 0.5) -> tuple[Column, Column]:
    """A word with its aligned times: they may only widen it, by so much at most."""
    return F.greatest(F.least(start, aligned_start), start - most), F.least(F.greatest(end, aligned_end), end + most)


def trim(start: Column, end: Column, first: Column, last: Column, pad: float = 0.1, least: float = 0.1) -> tuple[Column, Column, Column, Column]:
    """(start, end, clean start, clean end) of a clip without the silence at its ends, where that saves enough.

    first and last are where speech begins and ends, null without speech: then the clip stays whole.
    """
    low, high = F.greatest(start, first - pad), F.least(end, last + pad)
    cut_low = F.coalesce(low - start >= least, F.lit(False))
    cut_high = F.coalesce(end - high >= least, F.lit(False))
    return F.when(cut_low, low).otherwise(start), F.when(cut_high, high).otherwise(end), cut_low, cut_high


def utterances(detections: DataFrame, words: DataFrame, keys: Sequence[str], id: str, near: float = 6.0, pause: float = 1.0, slack: float = 0.05, ends: str = r"[.!?…]$") -> DataFrame:
    """(id, start, end, original, before, heard, after): the sentence that each detection was said in.

    detections: keys, id, start, end; words: keys, start, end, text. Words count whose middle lies within `near` seconds; a
    pause or a sentence's end cuts them; the first sentence with a word inside the detection is meant. Detections without
    such a word have no row.
    """
    middle = (F.col("_ws") + F.col("_we")) / 2
    said = words.select(*keys, F.col("start").alias("_ws"), F.col("end").alias("_we"), F.trim("text").alias("_w")).withColumn("_m", middle)
    wide = detections.select(*keys, id, F.col("start").alias("_ds"), F.col("end").alias("_de"), (F.col("start") - near).alias("_ls"), (F.col("end") + near).alias("_le"))
    rows = overlap_join(wide, said, keys, 4 * near, True, ("_ls", "_le"), ("_m", "_m"))
    order = Window.partitionBy(id).orderBy("_ws", "_we", "_w")
    new = F.lag("_we").over(order).isNull() | (F.col("_ws") - F.lag("_we").over(order) >= pause) | F.rlike(F.lag("_w").over(order), F.lit(ends))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_in", (F.col("_m") >= F.col("_ds") - slack) & (F.col("_m") <= F.col("_de") + slack))
    rows = rows.withColumn("_k", F.when(F.col("_in"), F.col("_s")))
    rows = rows.withColumn("_k", F.min("_k").over(Window.partitionBy(id))).where("_s = _k")
    low = F.min(F.when(F.col("_in"), F.struct("_ws", "_we", "_w"))).over(Window.partitionBy(id))
    place = F.when(F.col("_in"), "heard").when(F.struct("_ws", "_we", "_w") < low, "before").otherwise("after")
    rows = rows.withColumn("_p", place)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_ws", "_we", "_w")))), lambda x: x["_w"]), " ")
    of = lambda name: joined(F.col("_p") == name).alias(name)
    return rows.groupBy(id).agg(F.min("_ws").alias("start"), F.max_by("_we", F.struct("_ws", "_we", "_w")).alias("end"), joined(F.lit(True)).alias("original"), of("before"), of("heard"), of("after"))
