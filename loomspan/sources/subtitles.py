"""Subtitle files, word lists, transcripts and reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.charset import decode_text
from loomspan.functions.text import clean_text, descriptions, is_sung

LARGEST = 20 << 20  #: bytes of a subtitle file at most


def read_files(spark: SparkSession, path: str, language: str = "en", most: int = LARGEST) -> DataFrame:
    """(media, content) of the subtitle files in a folder and its subfolders that are not too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).select(F.col("path").alias("media"), decode_text(F.col("content"), F.lit(language)).alias("content"))


def _seconds(stamp: Column) -> Column:
    part = lambda i: F.regexp_extract(stamp, r"(?:(\d+):)?(\d+):(\d+)[.,](\d{1,3})", i)
    whole = lambda i: F.coalesce(part(i).try_cast("double"), F.lit(0.0))
    return whole(1) * 3600 + whole(2) * 60 + whole(3) + F.rpad(part(4), 3, "0").try_cast("double") / 1000


TIMING = r"(?m)^[ \t]*(\d+:)?\d+:\d+[,.]\d+[ \t]*-->"  #: begins the timing line of SRT and WebVTT


def subtitle_format(content: Column) -> Column:
    """vtt, ass, srt or microdvd; null for anything else."""
    body = F.regexp_replace(content, r"^\x{FEFF}+", "")
    ass = F.rlike(body, F.lit(r"(?im)^\s*\[events\]\s*$")) & F.rlike(body, F.lit(r"(?im)^\s*dialogue:"))
    return F.when(F.startswith(body, F.lit("WEBVTT")), "vtt").when(ass, "ass").when(F.rlike(body, F.lit(TIMING)), "srt").when(F.rlike(body, F.lit(r"(?m)^\{\d+\}\{\d+\}")), "microdvd")


def blocks(files: DataFrame, fps: float | None = None) -> DataFrame:
    """(media, block, start, end, text): timed texts of SRT, WebVTT, ASS/SSA and, with a frame rate, MicroDVD contents.

    Spans without length, comments and drawings are dropped; text has line ends where a viewer sees them.
    """
    body = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"^\x{FEFF}+", "")
    # each step's columns are made once: a list of one, taken apart, keeps them from being put into every use of them
    once = lambda rows, kept, **columns: rows.select(*kept, F.explode_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_r")).select(*kept, "_r.*")
    known = once(files, ["media"], content=body, _kind=subtitle_format(F.col("content")))
    known = known.where(F.col("_kind").isin("srt", "vtt", "ass", *(["microdvd"] if fps else [])))
    # one pass for all formats: a union of theirs would read each file once for each format, and may run in one task
    by = lambda timed, events, frames: F.when(F.col("_kind") == "ass", events).when(F.col("_kind") == "microdvd", frames).otherwise(timed)
    names, lines = _lines()
    parts = by(_paragraphs(), lines, F.split("content", "\n"))
    rows = known.select("media", "_kind", F.when(F.col("_kind") == "ass", names).alias("_names"), F.posexplode_outer(parts).alias("block", "part"))
    rows = rows.where(by(F.rlike("part", F.lit(TIMES)), F.rlike("part", F.lit(r"(?i)^\s*dialogue:")), F.rlike("part", F.lit(FRAMES))))
    rows = once(rows, ["media", "block", "_kind", "_names", "part"], _parts=F.when(F.col("_kind") == "ass", F.split(F.regexp_replace("part", r"(?i)^\s*dialogue:\s*", ""), ",", -1)))
    made = zip(("start", "end", "text", "_shown"), (*_timed(), F.lit(True)), _events(), (*_frames(fps), F.lit(True)), strict=True)
    rows = once(rows, ["media", "block"], **{name: by(*x) for name, *x in made})
    return rows.where("_shown and end > start").drop("_shown")


TIMES = r"((?:\d+:)?\d+:\d+[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d{1,3})"  #: of a block of SRT or WebVTT
FRAMES = r"^\{(\d+)\}\{(\d+)\}(.*)$"  #: a line of MicroDVD


def _paragraphs() -> Column:
    """Blocks of SRT and WebVTT contents."""
    content = F.regexp_replace("content", r"(?s)^WEBVTT.*?(\n[ \t]*\n|\z)|(?m)^(NOTE|STYLE|REGION)\b(?s:.*?)(\n[ \t]*\n|\z)", "")
    return F.split(content, r"\n[ \t]*\n")


def _timed() -> tuple[Column, Column, Column]:
    """(start, end, text) of a block."""
    return _seconds(F.regexp_extract("part", TIMES, 1)), _seconds(F.regexp_extract("part", TIMES, 2)), F.regexp_replace("part", r"(?s)^.*?-->[^\n]*\n?", "")


def _lines() -> tuple[Column, Column]:
    """(names of fields, lines) of the events of ASS and SSA, as their format line names them."""
    section = F.regexp_extract("content", r"(?ims)^\s*\[events\]\s*$(.*?)(?=^\s*\[|\z)", 1)
    return F.transform(F.split(F.lower(F.regexp_extract(section, r"(?im)^\s*format:(.*)$", 1)), ","), lambda x: F.trim(x)), F.split(section, "\n")


def _events() -> tuple[Column, Column, Column, Column]:
    """(start, end, text, whether it is shown) of a dialogue line's fields; the last field is the text."""
    field = lambda name: F.try_element_at("_parts", F.nullif(F.array_position("_names", name), F.lit(0)).cast("int"))
    text = F.array_join(F.slice("_parts", F.size("_names"), F.greatest(F.size("_parts") - F.size("_names") + 1, F.lit(0))), ",")
    drawing = F.rlike(text, F.lit(r"\{[^}]*\\p[1-9][^}]*\}"))
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\{[^{}]*\}", ""), r"\\[Nn]", "\n"), r"\\h", " ")
    return _seconds(field("start")), _seconds(field("end")), shown, (F.size("_parts") >= F.size("_names")) & ~drawing


def _frames(fps: float | None) -> tuple[Column, Column, Column]:
    """(start, end, text) of a line of MicroDVD."""
    part = lambda i: F.regexp_extract("part", FRAMES, i)
    second = lambda i: F.nullif(part(i), F.lit("")).cast("double") / (fps or 1.0)
    return second(1), second(2), F.replace(F.regexp_replace(part(3), r"\{[^{}]*\}", ""), F.lit("|"), F.lit("\n"))


def cues(files: DataFrame, fps: float | None = None) -> DataFrame:
    """(media, cue, start, end, text, lyrics): cleaned lines in order of time; repeats that touch are one; numbered from 1."""
    rows = blocks(files, fps).withColumns({"lyrics": is_sung(F.col("text")), "text": clean_text(F.col("text"))}).where("text <> ''")
    order = Window.partitionBy("media").orderBy("start", "end", "text")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reached.isNull() | (F.lag("text").over(order) != F.col("text")) | (F.col("start") > reached + 0.05)
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("media", "_g", "text").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("lyrics").alias("lyrics"))
    return merged.select("media", F.row_number().over(Window.partitionBy("media").orderBy("start", "end", "text")).alias("cue"), "start", "end", "text", "lyrics")


def sounds(files: DataFrame, fps: float | None = None) -> DataFrame:
    """(media, start, end, text): bracketed descriptions with their line's times."""
    return blocks(files, fps).select("media", "start", "end", F.explode(descriptions(F.col("text"))).alias("text"))


def speech(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(media, id, start, end): speech that was found before, from JSON lines (media, version, regions) of one version."""
    rows = spark.read.schema("media string, version int, regions array<array<double>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where((F.col("version") == version) & F.col("_bad").isNull())
    rows = rows.select("media", F.posexplode("regions").alias("id", "_r")).where((F.size("_r") == 2) & (F.get("_r", F.lit(1)) > F.get("_r", F.lit(0))))
    return rows.select("media", "id", F.get("_r", F.lit(0)).alias("start"), F.get("_r", F.lit(1)).alias("end"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """(media, id, start, end, word): true spans from JSON lines; lines that are no JSON, or spans without length, are left out."""
    rows = spark.read.schema("media string, words array<struct<start:double,end:double,word:string>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad is null").select("media", F.posexplode("words").alias("id", "_w")).select("media", "id", "_w.*")
    return rows.where("end > start")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): one a line; # begins a comment."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(^|\s)#.*", "")).alias("term")).where("term <> ''")


TRANSCRIPT = "media string, start double, end double, clean_start boolean, clean_end boolean, words array<struct<text:string,start:double,end:double,probability:double>>, written long"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Cached spans from JSON lines; lines that are no JSON are skipped; of equal spans the last written stays."""
    rows = spark.read.schema(f"{TRANSCRIPT}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad is null and end > start").drop("_bad")
    keys = ["media", F.round(F.col("start") * 1000).alias("_s"), F.round(F.col("end") * 1000).alias("_e")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "written").alias("_r"))
    return last.select("_r.*")


REPORT = "schema_version int, intervals array<struct<start:double,end:double>>"


def report_intervals(reports: DataFrame) -> DataFrame:
    """(media, start, end) of reports (media, json): finite, not empty, from 0 on. Reports that are no JSON have none."""
    rows = reports.select("media", F.explode(F.from_json("json", REPORT)["intervals"]).alias("i")).select("media", F.greatest(F.lit(0.0), "i.start").alias("start"), F.col("i.end").alias("end"))
    return rows.where(~F.isnan("start") & ~F.isnan("end") & (F.abs("start") < float("inf")) & (F.abs("end") < float("inf")) & (F.col("end") > F.col("start")))


FULL = "schema_version int, input struct<path:string,size:long,oshash:string,duration:double>, audio_stream struct<index:int,codec:string,channels:int,language:string>, settings map<string,string>, intervals array<struct<start:double,end:double>>"


def read_reports(reports: DataFrame, version: int = 1) -> DataFrame:
    """(media, path, size, oshash, duration, index, settings, n_intervals, problem) of reports (media, json), also edited ones.

    problem says why a report can't be used: it is no JSON object, of another version, or lacks its input or sound. Intervals are read by
    report_intervals, which leaves out those that are no spans; n_intervals counts those listed.
    """
    r = F.from_json("json", FULL)
    rows = reports.select("media", r.alias("r"))
    empty = F.col("r").isNull() | F.coalesce(*(F.col(f"r.{c}").cast("string") for c in ("schema_version", "input", "audio_stream", "settings", "intervals"))).isNull()
    problem = F.when(empty, "no report").when(~F.col("r.schema_version").eqNullSafe(F.lit(version)), "another version").when(F.col("r.input.path").isNull() | F.col("r.audio_stream.index").isNull(), "incomplete")
    return rows.select("media", "r.input.path", "r.input.size", "r.input.oshash", "r.input.duration", "r.audio_stream.index", "r.settings", F.coalesce(F.size("r.intervals"), F.lit(0)).alias("n_intervals"), problem.alias("problem"))
