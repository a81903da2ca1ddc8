"""Text functions on columns: normalising tokens, cleaning subtitle lines, times, ratios and answers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: fixed values: quote characters that are straightened, and what they become
QUOTES = "‘’‚‛′´`“”„″"
STRAIGHT = "'''''''\"\"\"\""
#: fixed values: characters stripped from both ends of a token
EDGE = "\"'.,!?;:()[]{}<>«»¿¡…—–-_/\\|~^♪"
_EDGE_CLASS = "[" + "".join("\\" + c if not c.isalnum() else c for c in EDGE) + "]"


def _odd(c: str) -> bool:
    new = unicodedata.ucd_3_2_0.category(c) == "Cn"  # Java may not know its case
    folds = c not in "ßς" and c.lower() != c.casefold()
    return unicodedata.normalize("NFKC", c) != c or unicodedata.category(c)[0] == "M" or folds or (new and (c.lower() != c or c.upper() != c))


@cache
def recomposed() -> str:
    """A Java pattern for characters that compatibility composition may change, or that case folding and Java's
    lower-casing may treat differently, found by asking for each. Sharp s and final sigma are left to fold."""
    wanted = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and _odd(chr(c))]
    ranges, low = [], None
    for c, following in zip(wanted, [*wanted[1:], None], strict=True):
        low = c if low is None else low
        if following != c + 1:
            ranges.append(f"\\u{low:04X}-\\u{c:04X}")
            low = None
    return f"[{''.join(ranges)}\\x{{10000}}-\\x{{10FFFF}}]"


#: runs of Latin letters and signs that composition leaves as they are
SETTLED = r"[\x00-\x7F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž]+"


@pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, for texts that may hold full-width or composed characters."""
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@pandas_udf(StringType())
def nfkc_folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, straight quotes and case folding."""
    straight = str.maketrans(QUOTES, STRAIGHT)
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t).translate(straight).casefold(), na_action="ignore")


def _is_odd(text: Column) -> Column:
    odd = F.regexp_replace(text, SETTLED, "")  # few are left to be tested one by one
    return (odd != "") & F.rlike(odd, F.lit(recomposed()))


def composed(text: Column) -> Column:
    """A text in compatibility composition. Only texts that it may change leave the JVM. Not for use in a lambda."""
    return F.coalesce(nfkc(F.when(_is_odd(text), text)), text)


def fold(text: Column, compose: bool = False) -> Column:
    """Straight quotes and case folding; with compose, compatibility characters first (not in a lambda).

    Folding differs from lower-casing in sharp s, which becomes ss, in the sigma at a word's end, which becomes a usual
    one, and in letters that composition changes too or that are rare; texts with those are folded in Python, with compose
    only.
    """
    plain = F.replace(F.translate(F.lower(F.translate(text, QUOTES, STRAIGHT)), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return F.coalesce(nfkc_folded(F.when(_is_odd(text), text)), plain) if compose else plain


def collapse(text: Column) -> Column:
    """Three or more of the same letter become one."""
    return F.regexp_replace(text, r"([\p{L}\p{Nl}\p{No}])\1{2,}", "$1")


def normalize(token: Column, compose: bool = False) -> Column:
    """A token folded, without white space and punctuation at its ends, its runs collapsed."""
    bare = F.regexp_replace(F.trim(fold(token, compose)), f"^{_EDGE_CLASS}+|{_EDGE_CLASS}+$", "")
    return collapse(F.trim(bare))


def normal(word: str) -> str:
    """normalized_words for one word in Python: for the distinct words of a batch."""
    bare = unicodedata.normalize("NFKC", word).translate(_STRAIGHTENED).casefold().strip(_ENDS)
    return _RUNS.sub(r"\1", bare)


_STRAIGHTENED = str.maketrans(QUOTES, STRAIGHT)
_ENDS = EDGE + " \t\n\x0b\f\r"
_RUNS = re.compile(r"([^\W\d_])\1\1+")


def forms(normalized: Column) -> Column:
    """The spellings under which a token is matched: as it is, and without hyphens."""
    return F.filter(F.array_distinct(F.array(normalized, F.replace(normalized, F.lit("-"), F.lit("")))), lambda x: x != "")


WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  #: white space as Java tells it, for a class of characters


def split_words(text: Column) -> Column:
    """Words of a line: dashes and ellipses divide too. One pass; classes of named characters take a fraction of the time of (?U)."""
    return F.array_remove(F.split(text, rf"[{WHITE}–—…]+|-{{2,}}|\.{{3,}}"), "")


def has_words(text: Column) -> Column:
    """Whether split_words finds any: only texts of dashes, dots and white space need be split."""
    return F.rlike(text, F.lit(rf"[^{WHITE}\-.–—…]")) | (F.size(split_words(text)) > 0)


_BREAK = "\u0001"  #: stands between the words of a text while all are worked on at once


def folded_words(words: Column, compose: bool = True) -> Column:
    """fold of each word of an array, in one pass over all of them."""
    return F.when(F.size(words) > 0, F.split(fold(F.array_join(words, _BREAK), compose), _BREAK, -1)).otherwise(F.array().cast("array<string>"))


def normalized_words(words: Column, compose: bool = True) -> Column:
    """normalize of each word of an array, in one pass over all of them; a word of punctuation becomes empty."""
    text = fold(F.array_join(words, _BREAK), compose)
    edge = f"[\\s{_EDGE_CLASS[1:-1]}]+"
    bare = F.regexp_replace(text, f"(?<![^{_BREAK}]){edge}|{edge}(?![^{_BREAK}])", "")
    return F.when(F.size(words) > 0, F.split(collapse(bare), _BREAK, -1)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; in a lambda, a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_DIVIDER = re.compile(rf"[{WHITE}–—…]+|-{{2,}}|\.{{3,}}")


def word_places(text: str) -> list[tuple[int, int]]:
    """word_spans of one text in Python: what stands between dividers."""
    found, at = [], 0
    for m in _DIVIDER.finditer(text):
        first, last = m.span()
        if first > at:
            found.append((at, first))
        at = last
    if at < len(text):
        found.append((at, len(text)))
    return found


@arrow_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])))
def word_spans(texts: pa.Array) -> pa.Array:
    """Where the words of split_words stand in a text: array<struct<first,last>>, the first character and the one after the last."""
    found = [None if t is None else word_places(t) for t in texts.to_pylist()]
    return span_arrays(found)


def span_arrays(found: list[list[tuple[int, int]] | None]) -> pa.Array:
    """Lists of (first, last) as an Arrow array of lists of structs."""
    flat = np.array([p for of in found if of for p in of], np.int32).reshape(-1, 2)
    ends = np.cumsum([len(of) if of else 0 for of in found], dtype=np.int32)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["first", "last"])
    begins = pa.array([0, *ends.tolist()], pa.int32())
    return pa.ListArray.from_arrays(begins, spans, mask=pa.array([of is None for of in found], pa.bool_()))


def is_masked(token: Column, marks: str = "[*#]") -> Column:
    """Whether a token looks masked: two characters or more, a mark, and a letter or a third character."""
    return (F.length(token) >= 2) & F.rlike(token, F.lit(marks)) & (F.rlike(token, F.lit(r"\p{L}")) | (F.length(token) >= 3))


#: fixed values: signs of a song
NOTES = "♪♫♬"


def clean_text(text: Column) -> Column:
    """A subtitle's words in one line: no tags, overrides, bracketed descriptions, song signs, dashes or speaker labels.

    A label is in capitals, of four words at most, without ? ! , or quotes. Descriptions may go over a line end.
    """
    plain = F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>|<\d[\d:.]*>", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\{[^{}]*\}", ""), r"\[[^\[\]]*\]|\([^()]*\)", " ")
    dash = r"^[-‐‑‒–—]+(?U:\s)*"

    def line(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        x = F.when(F.rlike(x, F.lit(SONG_LINE)), F.regexp_replace(x, r"^#+|#+$", "")).otherwise(x)
        x = F.regexp_replace(x, dash, "")
        label = F.regexp_extract(x, r"^([^\s:][^:]{0,29}):(?=\s|$)", 1)
        spoken = (label != "") & (label == F.upper(label)) & (label != F.lower(label)) & (F.size(F.split(F.trim(label), r"\s+")) <= 4) & ~F.rlike(label, F.lit('[?!,"]'))
        x = F.regexp_replace(F.when(spoken, F.substr(x, F.length(label) + 2)).otherwise(x), dash, "")
        return F.trim(F.regexp_replace(F.regexp_replace(x, f"[{NOTES}]", " "), r"(?U)\s+", " "))

    lines = F.transform(F.split(plain, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), line)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


SONG_LINE = r"^#\s.*\s#$|^#$"  #: a line that is sung, where # stands for a song sign


def is_sung(text: Column) -> Column:
    """Whether a subtitle is sung: a song sign anywhere, or a line between signs #."""
    plain = F.regexp_replace(F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>|<\d[\d:.]*>|\{[^{}]*\}", ""), r"\[[^\[\]]*\]|\([^()]*\)", " ")
    return F.rlike(text, F.lit(f"[{NOTES}]")) | F.exists(F.split(plain, r"\r?\n"), lambda x: F.rlike(F.trim(x), F.lit(SONG_LINE)))


def descriptions(text: Column) -> Column:
    """Bracketed sounds of a subtitle, in small letters, with single spaces."""
    plain = F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>|<\d[\d:.]*>|\{[^{}]*\}", "")
    found = F.regexp_extract_all(plain, F.lit(r"\[[^\[\]]*\]|\([^()]*\)"), F.lit(0))
    bare = F.transform(found, lambda x: F.lower(F.trim(F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"(?U)\s+", " "))))
    return F.filter(bare, lambda x: x != "")


def srt_time(millis: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds, 0 at least."""
    ms = F.greatest(millis.cast("long"), F.lit(0))
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3))


def rate(text: Column) -> Column:
    """A number written as a fraction: 24000/1001."""
    parts = F.split(text, "/")
    over = F.get(parts, F.lit(1)).try_cast("double")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.when(F.size(parts) == 1, 1.0).otherwise(over))


#: fixed values: what sounds tell of a line's delivery, the first that is found, and what sounds are sexual
DELIVERIES = (
    ("shouted", r"\b(shout\w*|yell\w*|scream\w*|screech\w*|bellow\w*|roar\w*)\b"),
    ("whispered", r"\b(whisper\w*|murmur\w*|mutter\w*|under (his|her|their|my) breath)\b"),
    ("tearful", r"\b(sob\w*|cry|cries|crying|weep\w*|tearful\w*)\b"),
)
SEXUAL_SOUNDS = r"\b(moan\w*|kiss\w*|sexual\w*|orgasm\w*|climax\w*|pant(s|ing)|breath(es|ing) heavily|bed ?springs|bed creak\w*|making love|having sex|sex)\b"


def delivery(sounds: Column, text: Column) -> Column:
    """How a line is said: by its sounds, else shouted where it has four letters or more, all capitals."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    loud = (F.length(letters) >= 4) & ~F.rlike(letters, F.lit(r"\P{Lu}"))
    says = lambda pattern: F.exists(sounds, lambda s: F.rlike(s, F.lit("(?U)" + pattern)))
    found = [F.when(says(pattern), name) for name, pattern in DELIVERIES]
    return F.coalesce(*found, F.when(loud, "shouted"))


def sexual_sounds(sounds: Column) -> Column:
    """The sounds of a line that are sexual, in order."""
    return F.filter(sounds, lambda s: F.rlike(s, F.lit("(?U)" + SEXUAL_SOUNDS)))


def intensity(said: Column, text: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return F.when(F.coalesce(said == "shouted", F.lit(False)) | (marks >= 2), "high").when(marks == 1, "medium").otherwise("low")


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substr(F.sha2(text, 256), F.lit(1), F.lit(digits))


def parse_answer(text: Column, field: str, allowed: list[str]) -> Column:
    """A field of the first JSON object in a text, if its value is one of those allowed."""
    first = F.regexp_extract(text, r"(?s)\{.*?\}", 0)
    value = F.get_json_object(first, f"$.{field}")
    return F.when(value.isin(allowed), value)


@pandas_udf(DoubleType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * common subsequence / total length; 100 for two empty texts. Null if either is.

    A text's places of each character are the bits of one number, so a character of the other text is a few operations.
    """
    known = a.notna() & b.notna()
    result = pd.Series(np.nan, index=a.index)
    result[known] = _ratios(a[known].tolist(), b[known].tolist())
    return result.astype(object).where(known, None).astype("float64")


def _ratios(x: list[str], y: list[str]) -> np.ndarray:
    """200 * length of the longest common subsequence / both lengths, of each pair. Equal first texts best stand together."""
    out = np.full(len(x), 100.0)
    last, places, whole = None, {}, 0
    for i, (first, second) in enumerate(zip(x, y, strict=True)):
        if not first and not second:
            continue
        if first != last:
            last, places, whole = first, {}, (1 << len(first)) - 1
            for place, c in enumerate(first):
                places[c] = places.get(c, 0) | 1 << place
        rest = whole  # bits that are 0 are places where the subsequence grows by one
        for c in second:
            if hit := rest & places.get(c, 0):
                rest = (rest + hit | rest - hit) & whole
        out[i] = 200 * (len(first) - rest.bit_count()) / (len(first) + len(second))
    return out


def sorted_words(text: Column) -> Column:
    """A text's words in order, for a ratio that does not mind their order."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.size(samples))


def decibels(level: Column) -> Column:
    return 20 * F.log10(level + 1e-12)


def matching_lines(texts: DataFrame, id: str, pattern: str, text: str = "text") -> DataFrame:
    """(id, line, l): the lines of each text that a pattern matches, numbered from 0."""
    rows = texts.select(id, F.posexplode(F.split(text, "\n", -1)).alias("line", "l"))
    return rows.where(F.rlike("l", F.lit(pattern)))
