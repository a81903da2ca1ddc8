"""The guided plan: which stretches of a film to listen to, from flagged lines and speech that no line covers.

Lines and speech are tables; what is heard there comes back as one. Times are seconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import lines as L
from loomspan.operators.spans import difference, islands, overlap_filter, overlap_join, split_spans


@dataclass(frozen=True)
class GuidedOptions:
    padding: float = 2.0  #: of a flagged line's window
    least: float = 6.0  #: length of a window
    most: float = 28.0
    gap: float = 3.0  #: windows nearer than that are one
    overlap: float = 2.0  #: of the pieces of a long window
    margin: float = 1.0  #: around lines that cover speech
    uncovered: float = 0.5  #: length of uncovered speech that is worth a window
    coverage: float = 0.6  #: share of the runtime from which listening to all of it is cheaper
    flags: int = 3  #: strong flags that can call a plan off
    bin: float = 600.0


def padding(base: Column, error: Column) -> Column:
    """How far around a line to listen: what is set, and three times the timing's error."""
    return base + 3 * error


def windows(flags: DataFrame, keys: Sequence[str], pad: Column, scale: Column | None = None, offset: Column | None = None) -> DataFrame:
    """(keys, start, end, reasons, cues): the window of each flagged line (keys, cue, start, end, reasons), on the media's clock."""
    at = lambda c: L.to_media(F.col(c), F.lit(1.0) if scale is None else scale, F.lit(0.0) if offset is None else offset)
    return flags.select(*keys, (at("start") - pad).alias("start"), (at("end") + pad).alias("end"), "reasons", F.array("cue").alias("cues"))


def uncovered(speech: DataFrame, cues: DataFrame, keys: Sequence[str], id: str, margin: float, least: float, size: float) -> DataFrame:
    """(keys, start, end, reasons, cues): windows for speech (keys, id, start, end) that no line covers, of a least length."""
    wide = cues.select(*keys, (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    found = long_enough(difference(speech, wide, keys, id, 0, size), least)
    return found.select(*keys, "start", "end", F.array(F.lit("uncovered")).alias("reasons"), F.array().cast("array<int>").alias("cues"))


def long_enough(pieces: DataFrame, least: float) -> DataFrame:
    return pieces.where(F.col("end") - F.col("start") >= least)


def plan(raw: DataFrame, keys: Sequence[str], duration: Column, o: GuidedOptions = GuidedOptions()) -> DataFrame:
    """(keys, island, piece, start, end, reasons, cues): the windows to listen to.

    raw: keys, start, end, reasons, cues. Windows outside 0..duration go; the others grow to a least length and are shifted
    at the edges; near ones merge; long ones are split; a piece has the reasons and lines of the windows that it touches.
    """
    inside = raw.where((F.col("end") > 0) & (F.col("start") < duration))
    low, high = L.grow(F.col("start"), F.col("end"), o.least, duration)
    grown = inside.withColumns({"start": low, "end": high}).where("end > start")
    grown = islands(grown, keys, o.gap)
    merged = grown.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    pieces = split_spans(merged, o.most, o.overlap)
    own = grown.select(*keys, "island", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "reasons", "cues")
    met = overlap_join(pieces, own, [*keys, "island"], max(o.bin, o.most))
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return met.groupBy(*keys, "island", "piece", "start", "end").agg(distinct("reasons"), distinct("cues"))


def confirmed(flags: DataFrame, detections: DataFrame, keys: Sequence[str], id: str, size: float) -> DataFrame:
    """flags (keys, id, start, end, reasons: on the media's clock) with whether each is strong, and whether a detection meets it."""
    hit = overlap_filter(flags.select(*keys, id, "start", "end"), detections.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")), keys, size, id, closed=True).select(id, F.lit(True).alias("confirmed"))
    return flags.join(hit, id, "left").withColumns({"confirmed": F.coalesce("confirmed", F.lit(False)), "strong": strong(F.col("reasons"))})


def strong(reasons: Column) -> Column:
    """Whether a line is flagged for a listed or masked word, not for a hint alone."""
    return F.arrays_overlap(reasons, F.array(F.lit("lexicon"), F.lit("masked")))


def confirmation(flags: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """(keys, strong, confirmed, doubtful) of flags (strong, confirmed): doubtful where under half of enough strong ones is confirmed."""
    rows = flags.groupBy(*keys).agg(F.count_if("strong").alias("strong"), F.count_if(F.col("strong") & F.col("confirmed")).alias("confirmed"))
    return rows.withColumn("doubtful", (F.col("strong") >= least) & (2 * F.col("confirmed") < F.col("strong")))


def fallback(has_lines: Column, coverage: Column, doubtful: Column, allowed: Column, most: float) -> Column:
    """Why all of a film is to be listened to instead, else null."""
    return F.when(~has_lines, "no subtitles").when(allowed & (coverage > most), "coverage").when(allowed & doubtful, "not confirmed")


def guided(flags: DataFrame, speech: DataFrame, cues: DataFrame, media: DataFrame, key: str = "media", o: GuidedOptions = GuidedOptions()) -> tuple[DataFrame, DataFrame]:
    """(windows, media): the plan of each film, and its counts, coverage and reason to fall back.

    flags: key, cue, start, end, reasons; speech: key, id, start, end; cues: key, start, end; media: key, duration,
    error. Films without lines keep no windows.
    """
    known = media.select(key, "duration", F.coalesce("error", F.lit(0.0)).alias("error"))
    raw = windows(flags.join(known, key), [key, "duration"], padding(F.lit(o.padding), F.col("error")))
    more = uncovered(speech, cues, [key], "id", o.margin, o.uncovered, o.bin).join(known.drop("error"), key)
    planned = plan(raw.unionByName(more), [key, "duration"], F.col("duration"), o)
    sums = planned.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count(F.lit(1)).alias("windows"))
    held = cues.select(key).distinct().withColumn("_lines", F.lit(True))
    out = known.join(sums, key, "left").join(held, key, "left")
    share = F.coalesce(F.try_divide(F.coalesce("seconds", F.lit(0.0)), F.col("duration")), F.lit(0.0))
    out = out.select(key, "duration", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("windows", F.lit(0)).alias("windows"), share.alias("coverage"), F.coalesce("_lines", F.lit(False)).alias("_lines"))
    return planned.drop("duration"), out.withColumn("fallback", fallback(F.col("_lines"), F.col("coverage"), F.lit(False), F.lit(True), o.coverage)).drop("_lines")
