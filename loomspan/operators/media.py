"""Streams and candidates of media: parsing, choosing, filtering, comparing names, placing outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import let, rate

PROBE = "streams array<struct<index:int,codec_type:string,codec_name:string,channels:int,r_frame_rate:string,duration:string,tags:map<string,string>,disposition:map<string,int>>>, format struct<duration:string,format_name:string>"

#: fixed values: codes of languages with their longer codes, and names that files use
LANGUAGES = {
    "ar": ("ara",), "cs": ("ces", "cze"), "da": ("dan",), "de": ("deu", "ger"), "el": ("ell", "gre"), "en": ("eng",), "es": ("spa",), "fi": ("fin",), "fr": ("fra", "fre"), "he": ("heb",),
    "hi": ("hin",), "hu": ("hun",), "id": ("ind",), "it": ("ita",), "ja": ("jpn",), "ko": ("kor",), "nl": ("nld", "dut"), "no": ("nor", "nob", "nno"), "pl": ("pol",), "pt": ("por",),
    "ro": ("ron", "rum"), "ru": ("rus",), "sv": ("swe",), "th": ("tha",), "tr": ("tur",), "uk": ("ukr",), "vi": ("vie",), "zh": ("zho", "chi"),
}
NAMES = {
    "arabic": "ar", "czech": "cs", "danish": "da", "german": "de", "deutsch": "de", "greek": "el", "english": "en", "spanish": "es", "espanol": "es", "finnish": "fi", "french": "fr",
    "francais": "fr", "hebrew": "he", "hindi": "hi", "hungarian": "hu", "indonesian": "id", "italian": "it", "japanese": "ja", "korean": "ko", "dutch": "nl", "norwegian": "no",
    "polish": "pl", "portuguese": "pt", "brazilian": "pt", "romanian": "ro", "russian": "ru", "swedish": "sv", "thai": "th", "turkish": "tr", "ukrainian": "uk", "vietnamese": "vi", "chinese": "zh",
}
#: fixed values: what names and titles say of a subtitle, and the files and folders that hold subtitles
HEARING, FORCED = ("sdh", "cc", "hearing", "impaired"), ("forced", "foreign")
HEARING_TITLE, FORCED_TITLE, COMMENT_TITLE = r"(?i)\bSDH\b|\bCC\b|hearing|closed.?caption", r"(?i)forced|foreign|signs", r"(?i)comment"
TEXT_CODECS = ("subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "text", "microdvd")
SUFFIXES, FOLDERS, REVIEW = ("srt", "ass", "ssa", "vtt"), ("subs", "subtitles"), ".review.srt"


def _known() -> Column:
    pairs = [*((c, c) for c in LANGUAGES), *((t, c) for c, tags in LANGUAGES.items() for t in tags), *NAMES.items()]
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def probe(rows: DataFrame) -> DataFrame:
    """(media, duration, index, kind, codec, language, title, channels, fps, disposition) of rows (media, json), one a stream.

    Unknown languages are null; the duration is the container's, else the longest stream's; rows without any are left out.
    """
    longest = lambda p: F.array_max(F.transform(p["streams"], lambda s: s["duration"].try_cast("double")))
    duration = lambda p: F.coalesce(p["format"]["duration"].try_cast("double"), longest(p))
    each = lambda p: let(duration(p), lambda d: F.transform(p["streams"], lambda s: F.struct(d.alias("duration"), s.alias("s"))))
    # outer, and filtered behind it: a filter before it would read the JSON again for each of its terms
    s = rows.select("media", F.explode_outer(let(F.from_json("json", PROBE), each)).alias("_s")).where("_s.duration > 0").select("media", "_s.duration", "_s.s")
    tag = lambda name: F.lower(F.get(F.map_values(F.map_filter("s.tags", lambda k, v: F.lower(k) == name)), F.lit(0)))
    language = F.when(tag("language") != "und", tag("language"))
    return s.select("media", "duration", F.col("s.index").alias("index"), F.col("s.codec_type").alias("kind"), F.col("s.codec_name").alias("codec"), language.alias("language"), tag("title").alias("title"), F.col("s.channels").alias("channels"), rate(F.col("s.r_frame_rate")).alias("fps"), F.col("s.disposition").alias("disposition"))


def dialogue_stream(streams: DataFrame, language: str) -> DataFrame:
    """Of each media's sound streams the one for dialogue: no commentary if there is a choice, then language, default, channels."""
    sound = streams.where("kind = 'audio'")
    flag = lambda name: F.coalesce(F.try_element_at("disposition", F.lit(name)), F.lit(0)) == 1
    other = flag("comment") | flag("visual_impaired") | F.coalesce(F.rlike("title", F.lit("comment|descri")), F.lit(False))
    order = Window.partitionBy("media").orderBy(other, F.coalesce(F.col("language") != language_code(language), F.lit(True)), ~flag("default"), F.desc("channels"), "index")
    return sound.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def language_code(name: str) -> str:
    """The first longer code of a language's code or name, else itself."""
    name = name.lower()
    code = name if name in LANGUAGES else NAMES.get(name, next((c for c, tags in LANGUAGES.items() if name in tags), None))
    return LANGUAGES[code][0] if code else name


def language_of(tag: Column) -> Column:
    """The two-letter code of a code or name; null if it is none that is known."""
    return F.try_element_at(_known(), F.lower(tag))


def same_language(tag: Column, code: Column) -> Column:
    """Whether a tag (eng, en-US) and a code (en) are one language; unknown ones are compared as they are."""
    base = lambda c: F.get(F.split(F.lower(c), "-"), F.lit(0))
    short = lambda c: F.coalesce(language_of(base(c)), base(c))
    return F.coalesce((tag != "") & (short(tag) == short(code)), F.lit(False))


def name_flags(tokens: Column) -> Column:
    """(language, hearing, forced) from the tokens of a file's name; hi is a language only where no other token is one."""
    lower = F.transform(tokens, lambda t: F.lower(t))
    named = F.filter(lower, lambda t: language_of(t).isNotNull())
    hearing = F.exists(lower, lambda t: t.isin(*HEARING))
    hindi = (F.size(named) > 1) & F.array_contains(named, "hi")
    first = F.get(F.when(hindi, F.filter(named, lambda t: t != "hi")).otherwise(named), F.lit(0))
    return F.struct(language_of(first).alias("language"), (hearing | hindi).alias("hearing"), F.exists(lower, lambda t: t.isin(*FORCED)).alias("forced"))


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"(?U)[^\s._\-\[\]()]+"), F.lit(0))


def embedded(streams: DataFrame) -> DataFrame:
    """(media, source, index, language, hearing, forced, bonus): the text subtitles in files (probe's rows), without commentaries."""
    flag = lambda name: F.coalesce(F.try_element_at("disposition", F.lit(name)), F.lit(0)) == 1
    title = F.coalesce("title", F.lit(""))
    rows = streams.where((F.col("kind") == "subtitle") & F.col("codec").isin(*TEXT_CODECS) & ~(flag("comment") | F.rlike(title, F.lit(COMMENT_TITLE))))
    return rows.select(
        "media", F.lit("embedded").alias("source"), "index", language_of(F.col("language")).alias("language"), (flag("hearing_impaired") | F.rlike(title, F.lit(HEARING_TITLE))).alias("hearing"),
        (flag("forced") | F.rlike(title, F.lit(FORCED_TITLE))).alias("forced"), F.when(flag("default"), 5.0).otherwise(0.0).alias("bonus"),
    )


def above(path: Column) -> tuple[Column, Column]:
    """(folder, name): what stands before and behind the last slash."""
    name = F.substring_index(path, "/", -1)
    return F.left(path, F.length(path) - F.length(name) - 1), name


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """(folder, stem, suffix) of a path with slashes; the suffix is without its dot, in small letters."""
    folder, name = above(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return folder, stem, F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))


def sidecars(files: DataFrame, videos: DataFrame) -> DataFrame:
    """(media, source, path, language, hearing, forced, bonus): subtitle files that belong to videos.

    files and videos: path. A file belongs to a video whose stem its name begins with (up to the end or one of . _ -), in its
    folder or a folder for subtitles in that; to one that its folder in such a folder is named for; or, in such a folder,
    to the only video beside it. Joins are on folder and stem: each name is cut at every mark, so no folder's files meet
    all its videos.
    """
    # a path's parts are made once: a list of one, taken apart, keeps them from being put into every use of them
    once = lambda rows, *new: rows.select("*", F.explode_outer(F.array(F.struct(*new))).alias("_r")).select(*rows.columns, "_r.*")
    folder, stem, suffix = path_parts(F.col("path"))
    subs = once(files.select("path"), folder.alias("_f"), stem.alias("_s"), suffix.alias("_x")).where(F.col("_x").isin(*SUFFIXES) & ~F.endswith(F.lower("path"), F.lit(REVIEW)))
    parent, name = above(F.col("_f"))
    subs = once(subs, parent.alias("_up"), F.lower(name).alias("_in")).withColumn("_aside", F.col("_in").isin(*FOLDERS))
    marks = F.filter(F.sequence(F.lit(1), F.length("_s")), lambda i: (i == F.length("_s")) | F.substr("_s", i + 1, F.lit(1)).isin(".", "_", "-"))
    named = subs.where("_s <> ''").withColumn("_n", F.explode(marks)).withColumns({"_key": F.lower(F.substr("_s", F.lit(1), F.col("_n"))), "_rest": F.substr("_s", F.col("_n") + 1)})
    homes = F.explode(F.array_compact(F.array(F.col("_f"), F.when(F.col("_aside"), F.col("_up")))))
    named = named.withColumn("_home", homes).select("path", "_home", "_key", "_rest", (F.col("_home") == F.col("_f")).alias("_beside"))
    grand, outer = above(F.col("_up"))
    packs = subs.where(F.lower(outer).isin(*FOLDERS)).select("path", grand.alias("_home"), F.col("_in").alias("_key"), F.col("_s").alias("_rest"), F.lit(False).alias("_beside"))
    vf, vs, _ = path_parts(F.col("path"))
    known = videos.select(F.col("path").alias("media"), vf.alias("_home"), F.lower(vs).alias("_key"))
    found = named.unionByName(packs).join(known, ["_home", "_key"]).drop("_key")
    only = known.groupBy("_home").agg(F.count(F.lit(1)).alias("_v"), F.first("media").alias("media"), F.first("_key").alias("_key")).where("_v = 1").drop("_v")
    # a loose file is found by its name already where the only video's stem is one of its cuts
    again = (F.col("_s") != "") & F.exists(marks, lambda i: F.lower(F.substr("_s", F.lit(1), i)) == F.col("_key"))
    loose = subs.where("_aside").select("path", F.col("_up").alias("_home"), "_s").join(only, "_home").where(~again)
    found = found.unionByName(loose.select("path", "_home", F.col("_s").alias("_rest"), F.lit(False).alias("_beside"), "media"))
    flags = name_flags(name_tokens(F.col("_rest")))
    return found.select("media", F.lit("sidecar").alias("source"), "path", flags.alias("_l"), F.when(F.col("_beside"), 5.0).otherwise(0.0).alias("bonus")).select("media", "source", "path", "_l.*", "bonus")


def explicit(choices: DataFrame) -> DataFrame:
    """(media, source, path, language, hearing, forced): subtitles that a user names (media, path)."""
    _, stem, _ = path_parts(F.col("path"))
    return choices.select("media", F.lit("explicit").alias("source"), "path", name_flags(name_tokens(stem)).alias("_l")).select("media", "source", "path", "_l.*")


def paths(path: Column, backup: Column | None = None) -> dict[str, Column]:
    """Where the report, the review and the edit list of a video go; the edit list goes beside the original."""
    folder, stem, _ = path_parts(path)
    beside = lambda f, s, end: F.concat(F.when(f == "", "").otherwise(F.concat(f, F.lit("/"))), s, F.lit(end))
    original = path if backup is None else F.coalesce(backup, path)
    of, os_, _ = path_parts(original)
    return {"report": beside(folder, stem, ".report.json"), "review": beside(folder, stem, REVIEW), "edl": beside(of, os_, ".edl")}


def from_template(path: Column, template: Column) -> Column:
    """A path from a template with {stem}, {ext} and {dir}; what is not absolute lies in the video's folder."""
    folder, stem, suffix = path_parts(path)
    dot = F.when(suffix == "", "").otherwise(F.concat(F.lit("."), suffix))
    named = F.replace(F.replace(F.replace(template, F.lit("{stem}"), stem), F.lit("{ext}"), dot), F.lit("{dir}"), folder)
    return F.when(F.startswith(named, F.lit("/")) | (folder == ""), named).otherwise(F.concat(folder, F.lit("/"), named))


def machine_translated(flag: Column, translator: Column) -> Column:
    """Whether a subtitle was translated by a machine: it is marked so, or names no person."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(translator, F.lit(False))


def too_short(found: Column, wanted: Column, seconds: float = 2.0, share: float = 0.01) -> Column:
    """Whether an output is shorter than it should be by more than some seconds and a share of it."""
    return found < wanted - F.greatest(F.lit(seconds), share * wanted)


def cached_and_found(found: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What is found, and cached entries that are not among it."""
    return found.unionByName(cached.join(found.select(*keys), keys, "left_anti"))


def withdrawn(results: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """results with whether some failure calls each back."""
    bad = failed.select(*keys).distinct().withColumn("withdrawn", F.lit(True))
    return results.join(bad, keys, "left").withColumn("withdrawn", F.coalesce("withdrawn", F.lit(False)))


def from_cache(rows: DataFrame, keys: list[str], cached: Column) -> DataFrame:
    """(keys, cached): whether all, some or none of a group comes from the cache."""
    n, total = F.count_if(cached), F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.when(n == total, "all").when(n == 0, "none").otherwise("some").alias("cached"))


def cache_usage(entries: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, files, bytes) of cached entries."""
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def candidate_score(language: Column, wanted: list[str], forced: Column, hearing: Column, prefer_hearing: bool, bonus: Column) -> Column:
    """Null for candidates that are left out: forced ones and those of languages that are not wanted.

    wanted: codes in the order of preference. The first is worth 100, each later one 10 less, an unknown language 50; 20 are
    added where the candidate is for the hearing impaired as preferred, or not as preferred. Tags are languages without
    their region, in short or long codes (same_language); one that fits several wanted codes counts for the first.
    """
    places = [F.when(same_language(language, F.lit(code)), F.lit(100 - 10 * i)) for i, code in enumerate(wanted)]
    base = F.when(language.isNull(), 50).otherwise(F.coalesce(*places, F.lit(None).cast("int")))
    return F.when(~forced, base + F.when(hearing == F.lit(prefer_hearing), 20).otherwise(0) + bonus)


def release_similarity(fields: list[tuple[Column, Column, int]]) -> Column:
    """The sum of weights of fields that agree, without case."""
    total = F.lit(0)
    for a, b, weight in fields:
        total = total + F.when(F.lower(a) == F.lower(b), weight).otherwise(0)
    return total


def mismatch(*checks: tuple[str, Column]) -> Column:
    """The first check that differs, else null."""
    return F.coalesce(*(F.when(differs, F.lit(name)) for name, differs in checks))


def placement(mode: Column, explicit: Column, path: Column) -> Column:
    """(output, backup, problem) by mode: new, backup, in_place."""
    stem, end = F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"\.[^./]*$", 0)
    clean, kept = F.concat(stem, F.lit(".clean"), end), F.concat(stem, F.lit(".original"), end)
    none = F.lit(None).cast("string")
    row = lambda a, b, c: F.struct(a.alias("output"), b.alias("backup"), c.alias("problem"))
    return (
        F.when(explicit.isNotNull() & (mode != "new"), row(none, none, F.lit("an output path needs mode new")))
        .when(explicit.isNotNull(), row(explicit, none, none))
        .when(mode == "new", row(clean, none, none))
        .when(mode == "backup", row(path, kept, none))
        .when(mode == "in_place", row(path, none, none))
        .otherwise(row(none, none, F.lit("unknown mode")))
    )


def clashes(outputs: DataFrame) -> DataFrame:
    """outputs (path, output, order) with whether an earlier row has the same output already."""
    return outputs.withColumn("clash", F.row_number().over(Window.partitionBy("output").orderBy("order")) > 1)


def own_outputs(inputs: DataFrame) -> DataFrame:
    """inputs (path, output) that are no other input's output."""
    made = inputs.select(F.col("output").alias("path"), F.col("path").alias("_by")).where("path <> _by").select("path").distinct()
    return inputs.join(made, "path", "left_anti")
