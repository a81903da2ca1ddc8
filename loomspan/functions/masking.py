"""Masking words in texts and files."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomspan.functions import text as T
from loomspan.operators.matching import Term, match
from loomspan.session import durable
from loomspan.sources.subtitles import subtitle_format

#: markup, which a viewer does not see: override blocks, tags and times
SKIPPED = r"\{[^{}]*\}|</?[a-zA-Z][^<>]*>|<\d[\d:.]*>"


def mask_words(text: Column, words: list[str], mark: str = "[...]") -> Column:
    """Whole words or phrases, the longest first, without case, replaced by a mark."""
    if not words:
        return text
    either = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_'])(?:{either})(?![\p{{L}}\p{{N}}_'])", mark.replace("$", r"\$"))


def visible(text: Column) -> Column:
    """A text as a viewer sees it: no markup, and spaces for the breaks \\N, \\n and \\h."""
    return F.regexp_replace(F.regexp_replace(text, SKIPPED, ""), r"\\[Nnh]", " ")


_SKIPPED = re.compile(SKIPPED, re.ASCII)
_UNIT = re.compile(rf"(?:{SKIPPED})*+(?:\\[Nnh]|.)|(?:{SKIPPED})++\Z", re.ASCII | re.DOTALL)  #: one visible character with the markup before it; or the markup at the end
_LETTER = re.compile(r"(?:\\[Nnh]|.)\Z", re.DOTALL)  #: the visible part of a unit; a break of two characters is one
_WHITE = re.compile(f"[{T.WHITE}]")


def mask_text(text: Column, spans: Column, mode: str) -> Column:
    """A text with spans (array<struct<first,last>> of visible characters, in order, not overlapping) masked; markup and breaks stay.

    asterisks: letters and digits become stars; first_letter: all but the first of each word do; remove: the span goes, but
    for its line ends. Of the two spaces around what was removed one goes too: the one behind it where it stood at the
    beginning or behind white space, else the one before it if no word follows directly. Null spans leave the text.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if t is None or s is None else _masked(t, [(x["first"], x["last"]) for x in s], mode) for t, s in rows], pa.string())

    return masked(text, spans)


def _masked(text: str, spans: list[tuple[int, int]], mode: str) -> str:
    """mask_text for one text: what stands before each span and the span as masked, in turns, and what stands behind the last."""
    if not spans:
        return text
    units = _UNIT.findall(text)
    letters = [_LETTER.search(u)[0] for u in units]
    size = len(_seen(text))
    inside = [(max(a, 0), min(b, size)) for a, b in spans]
    inside = [(a, b) for a, b in inside if a < b]
    out, at, behind = [], 0, False
    for first, last in inside:
        before = False
        between = units[at:first]
        if mode == "remove":
            drop = behind
            space = letters[last : last + 1] == [" "]
            behind = space and (first == 0 or letters[first - 1] in ("\\N", "\\n", "\\h") or _WHITE.fullmatch(letters[first - 1]) is not None)
            before = not behind and first > 0 and letters[first - 1] == " " and not (last < len(letters) and _wordlike(letters[last]))
            between = _without_edges(between, drop, before)
            hidden = [u if c in ("\r", "\n", "\\N", "\\n", "\\h") else u[: len(u) - len(c)] for u, c in zip(units[first:last], letters[first:last], strict=True)]
        else:
            hidden = _stars(units[first:last], letters[first:last], mode == "first_letter")
        out += between
        out += hidden
        at = last
    out += _without_edges(units[at:], behind, False)
    return "".join(out)


def _wordlike(letter: str) -> bool:
    """Whether a visible part is a letter or a digit."""
    return len(letter) == 1 and unicodedata.category(letter)[0] in "LN"


def _without_edges(units: list[str], first: bool, last: bool) -> list[str]:
    """Units without the visible parts of the first or the last."""
    n = len(units)
    return [u[: len(u) - len(_LETTER.search(u)[0])] if (first and i == 0) or (last and i == n - 1) else u for i, u in enumerate(units)]


def _stars(units: list[str], letters: list[str], first_stays: bool) -> list[str]:
    out, inside = [], False  # inside: a letter or digit stands before in this word
    for u, c in zip(units, letters, strict=True):
        word = _wordlike(c)
        out.append(u[: len(u) - len(c)] + "*" if word and (inside or not first_stays) else u)
        inside = word or (inside and len(c) == 1 and _WHITE.fullmatch(c) is None)
    return out


def _seen(text: str) -> str:
    """visible for one text in Python."""
    return re.sub(r"\\[Nnh]", " ", _SKIPPED.sub("", text))


def mask_lines(lines: DataFrame, spans: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """lines (keys, text) with the spans of each (keys, first, last) masked; lines left empty are dropped."""
    found = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_s"))
    rows = lines.join(found, keys, "left").withColumn("text", mask_text(F.col("text"), F.col("_s"), mode)).drop("_s")
    return rows.where(F.trim("text") != "")


def _cores(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words in a text without the punctuation at their ends; words of punctuation only are left out."""
    found = []
    for first, last in words:
        word = text[first:last].lstrip(T.EDGE + T.QUOTES)
        if word:
            found.append((last - len(word), last - len(word) + len(word.rstrip(T.EDGE + T.QUOTES))))
    return found


def _censored(text: str, runs: list[tuple[int, int]], mode: str) -> tuple[str, int]:
    """A text with runs of words (the first, the last) masked, and how many words these are."""
    seen = _seen(text)
    words = T.word_places(seen)
    cores = [c for c in (_cores(seen, words[a : b + 1]) for a, b in runs) if c]
    spans = [(c[0][0], c[-1][1]) for c in cores] if mode == "remove" else [x for c in cores for x in c]
    return _masked(text, spans, mode), sum(map(len, cores))


def censor(texts: DataFrame, keys: list[str], terms: Sequence[Term], mode: str, allow: Sequence[str] = (), text: str = "text") -> DataFrame:
    """texts (keys, text) with listed and masked words masked as mode says, and `masked`: how many there are.

    Words are found as a viewer sees them. In mode remove, the words of a match that follow one another go together.
    """
    rows = texts.withColumns({"_id": F.struct(*keys), "_seen": visible(F.col(text))})
    found = match(rows.select("_id", F.col("_seen").alias("text")), "_id", terms, allow)
    runs = found.select("_id", "first", "term", F.posexplode("targets").alias("_k", "_t"))
    runs = runs.groupBy("_id", "first", "term", (F.col("_t") - F.col("_k")).alias("_r")).agg(F.min(F.col("first") + F.col("_t")).alias("_a"), F.max(F.col("first") + F.col("_t")).alias("_b"))
    runs = runs.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_a", "_b"))).alias("_runs"))
    kind = StructType([StructField("text", StringType()), StructField("masked", IntegerType())])

    @F.arrow_udf(kind)
    def censored(whole: pa.Array, runs: pa.Array) -> pa.Array:
        rows = zip(whole.to_pylist(), runs.to_pylist(), strict=True)
        done = [(t, 0) if t is None or not r else _censored(t, [(x["_a"], x["_b"]) for x in r], mode) for t, r in rows]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["text", "masked"])

    rows = rows.join(runs, "_id", "left").withColumn("_done", censored(F.col(text), F.col("_runs")))
    return rows.withColumns({text: F.col("_done.text"), "masked": F.col("_done.masked")}).drop("_id", "_seen", "_runs", "_done")


def mask_files(files: DataFrame, terms: Sequence[Term], mode: str, allow: Sequence[str] = ()) -> DataFrame:
    """(media, content, masked): subtitle files (SRT, WebVTT, ASS/SSA; others are left out) with listed words masked.

    All but the masked words stays as it is, line ends too. A line of SRT and WebVTT that is left empty goes, and so does a
    cue without any line, as an empty line ends a cue. The rows of a file are cues; a file is put together from its rows.
    """
    kind = subtitle_format(F.col("content"))
    known = files.select("media", "content", kind.alias("_kind")).where(F.col("_kind").isin("srt", "vtt", "ass"))
    # SRT and WebVTT: a block of lines, then the empty lines after it
    block = F.regexp_extract_all("content", F.lit(r"(?:[^\r\n]*\S[^\r\n]*(?:\r?\n|\z))+|(?:[^\S\r\n]*\r?\n)+|[^\S\r\n]+\z"), F.lit(0))
    cue = known.where("_kind <> 'ass'").select("media", F.posexplode(block).alias("n", "_b"))
    head = F.regexp_extract("_b", r"(?s)^(?:(?!(?:^|(?<=\n))\s*(?:\d+:)?\d+:\d+[,.]\d+\s*-->).)*?(?<![^\n])[ \t]*(?:\d+:)?\d+:\d+[,.]\d+[ \t]*-->[^\n]*\n?", 0)
    cue = cue.select("media", "n", head.alias("head"), F.substr("_b", F.length(head) + 1).alias("text"), (head != "").alias("_cue"), F.col("_b"))
    # ASS: a line; the text is the last field of a dialogue line
    fields = F.size(F.split(F.regexp_extract("content", r"(?ims)^\s*\[events\]\s*$.*?^\s*format:([^\r\n]*)", 1), ",", -1))
    count = F.when(F.rlike("content", F.lit(r"(?ims)^\s*\[events\]\s*$.*?^\s*format:")), fields).otherwise(10)
    parts = F.struct(count.alias("_f"), F.regexp_extract_all("content", F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0)).alias("_l"))
    line = known.where("_kind = 'ass'").select("media", parts.alias("_p")).select("media", F.col("_p._f").alias("_f"), F.posexplode("_p._l").alias("n", "_b"))
    commas = F.concat(F.lit(r"(?i)^\s*dialogue:(?:[^,]*,){"), (F.col("_f") - 1).cast("string"), F.lit("}"))
    begin = F.call_function("regexp_extract", F.col("_b"), commas, F.lit(0))
    line = line.withColumn("head", F.coalesce(begin, F.lit("")))
    line = line.select("media", "n", "head", F.substr("_b", F.length("head") + 1).alias("text"), F.lit(False).alias("_cue"), "_b", (F.col("head") != "").alias("_say"))
    rows = cue.withColumn("_say", F.col("_cue")).unionByName(line)
    rows = durable(rows.withColumn("_new", F.when(F.col("_say"), F.col("text"))), "cues")  # read for the search and for the masking
    rows = censor(rows, ["media", "n"], terms, mode, allow, "_new")
    lines = lambda c: F.regexp_extract_all(c, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))
    shown = lambda x: F.trim(F.regexp_replace(visible(x), r"\s+", " ")) != ""
    both = F.arrays_zip(lines(F.col("text")).alias("old"), lines(F.col("_new")).alias("new"))
    kept = F.array_join(F.transform(F.filter(both, lambda z: shown(z["new"]) | ~shown(z["old"])), lambda z: z["new"]), "")
    text = F.when(F.col("_cue") & (F.col("text") != ""), kept).otherwise(F.col("_new"))
    whole = F.when(~F.col("_say"), F.col("_b")).when(F.col("_cue") & (F.col("text") != "") & (kept == ""), "").otherwise(F.concat("head", text))
    rows = rows.select("media", "n", whole.alias("x"), F.coalesce("masked", F.lit(0)).alias("masked"))
    # the empty lines after a cue that is gone go with it
    gone = F.lag("x").over(Window.partitionBy("media").orderBy("n")) == ""
    rows = rows.withColumn("x", F.when(F.coalesce(gone, F.lit(False)) & (F.trim(F.regexp_replace("x", r"\s+", "")) == ""), "").otherwise(F.col("x")))
    parts = F.array_sort(F.collect_list(F.struct("n", "x")))
    return rows.groupBy("media").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "").alias("content"), F.sum("masked").alias("masked"))
