"""Texts of results: edit lists, subtitles, mute commands, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import srt_time


def _joined(df: DataFrame, line: str, divider: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("start", "end", F.col(line).alias("x"))))
    return df.groupBy("media").agg(F.array_join(F.transform(rows, lambda r: r["x"]), divider).alias("content"))


def edit_list(spans: DataFrame) -> DataFrame:
    """(media, content): a line with start, end and 1 for each span."""
    return _joined(spans.withColumn("_x", F.format_string("%.3f\t%.3f\t1\n", "start", "end")), "_x", "")


def subtitles(lines: DataFrame) -> DataFrame:
    """(media, content): numbered SRT blocks of lines (media, start, end in seconds, text)."""
    number = F.row_number().over(Window.partitionBy("media").orderBy("start", "end", "text"))
    stamp = lambda c: srt_time(F.bround(F.col(c) * 1000))
    block = F.concat(number.cast("string"), F.lit("\n"), stamp("start"), F.lit(" --> "), stamp("end"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(lines.withColumn("_x", block), "_x", "\n")


def mute_commands(spans: DataFrame, fade: float = 0.01) -> DataFrame:
    """(media, start, end, previous, fade): each span with the end before it and its fade, a third of it at most."""
    order = Window.partitionBy("media").orderBy("start", "end")
    return spans.withColumns({"previous": F.lag("end", 1, 0.0).over(order), "fade": F.least(F.lit(fade), (F.col("end") - F.col("start")) / 3)})


def _number(x: Column) -> Column:
    """A double as JSON without an exponent, as to_json writes those of 10 million and more; to_json's own from 1e15 on."""
    plain = F.regexp_replace(F.when(F.abs(x) < 1e15, x).try_cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    own = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(x.cast("string"))
    return F.coalesce(plain, own)


def _field(name: str, value: Column) -> Column:
    """"name":value for a value that is JSON; null for null."""
    return F.concat(F.lit(f'"{name}":'), value)


def _text(name: str, value: Column) -> Column:
    """"name":value for any value that to_json writes; null for null."""
    json = F.to_json(F.struct(value.alias(name)))
    return F.when(value.isNotNull(), F.substr(json, F.lit(2), F.length(json) - 2))


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ","), F.lit("")), F.lit("]"))


def _span(s: Column) -> list[Column]:
    return [_field(c, _number(s[c])) for c in ("start", "end")]


def reports(spans: DataFrame, version: int = 1) -> DataFrame:
    """(media, json): one report for each media."""
    sec = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    rows = F.array_sort(F.collect_list(F.struct(sec("start"), sec("end"))))
    whole = _object(_text("schema_version", F.lit(version)), _field("intervals", _list(F.transform(rows, lambda s: _object(*_span(s))))))
    return spans.groupBy("media").agg(whole.alias("json"))


def full_reports(files: DataFrame, spans: DataFrame, detections: DataFrame, settings: dict[str, str] | None = None, version: int = 1) -> DataFrame:
    """(media, json): a report for each row of files, with what identifies it, its sound, settings, detections and intervals.

    files: media (unique), path, size, oshash, duration, index, codec, channels, language; spans: media, start, end;
    detections: media, start, end, text, term, category, confidence. Lists are in order of time, empty where there is
    nothing; times have three decimals; null fields stay out. read_reports reads it back.
    """
    sec = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    own = F.struct(sec("start"), sec("end"))
    found = F.struct(sec("start"), sec("end"), "text", "term", "category", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))
    intervals = spans.groupBy("media").agg(F.array_sort(F.collect_list(own)).alias("intervals"))
    heard = detections.groupBy("media").agg(F.array_sort(F.collect_list(found)).alias("detections"))
    rows = files.join(intervals, "media", "left").join(heard, "media", "left")
    fixed = F.create_map(*(F.lit(x) for pair in (settings or {}).items() for x in pair)) if settings else F.create_map().cast("map<string,string>")
    detection = lambda d: _object(*_span(d), *(_text(c, d[c]) for c in ("text", "term", "category")), _field("confidence", _number(d["confidence"])))
    whole = _object(
        _text("schema_version", F.lit(version)),
        _field("input", _object(*(_text(c, F.col(c)) for c in ("path", "size", "oshash")), _field("duration", _number(sec("duration"))))),
        _field("audio_stream", _object(*(_text(c, F.col(c)) for c in ("index", "codec", "channels", "language")))),
        _text("settings", fixed),
        _field("detections", _list(F.transform("detections", detection))),
        _field("intervals", _list(F.transform("intervals", lambda s: _object(*_span(s))))),
    )
    return rows.select("media", whole.alias("json"))
