"""The whole scan: words and lines against a word list, to merged spans, counts and reports for each media."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import matching as M
from loomspan.operators import spans as S
from loomspan.sources import sinks as K


@dataclass(frozen=True)
class ScanOptions:
    pad_before: float = 0.12
    pad_after: float = 0.2
    least: float = 0.25
    gap: float = 0.25


def scan(words: DataFrame, terms: Sequence[M.Term], allow: Sequence[str] = (), options: ScanOptions = ScanOptions(), disabled: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(detections, spans) of words (media, pos, text, start, end, probability): what is heard, and what to mute.

    Masked words count as what they seem to hide, unless a disabled category alone explains them.
    """
    raw = words.select("media", "pos", F.col("text").alias("raw"), "start", "end", "probability")
    tokens = raw.withColumn("token", X.normalize(F.col("raw"), compose=True))
    heard = M.detections(M.match_words(tokens, "media", terms, allow, disabled), tokens, ["media"])
    o = options
    low, high = S.pad_interval(F.col("start"), F.col("end"), o.pad_before, o.pad_after, o.least)
    padded = heard.select("media", low.alias("start"), high.alias("end"))
    return heard, S.merge_spans(padded, ["media"], o.gap)


def scan_reports(words: DataFrame, terms: Sequence[M.Term], options: ScanOptions = ScanOptions()) -> DataFrame:
    """(media, json): a report for each media with something to mute."""
    return K.reports(scan(words, terms, options=options)[1])
