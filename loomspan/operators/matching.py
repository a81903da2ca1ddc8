"""Finding terms of a word list in lines of words.

Lines are split by column functions and walked once by the list's automaton (wordlist.WordList), which names every place
where a term or a masked word stands. These few places are written, and all that follows works on them:
lines without conflicts need no order, and nothing is joined with the words of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomspan.functions import text as T
from loomspan.operators.spans import islands
from loomspan.operators.wordlist import MASKED, SEARCH, Part, Samples, Term, WordList, listed, part, parts, targets
from loomspan.session import durable

__all__ = ["MASKED", "SEARCH", "Part", "Term", "WordList", "listed", "part", "parts", "targets"]


def tokens(lines: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, pos, raw, token): the words of each line.

    An outer explode, as for a plain one Spark first filters by the array's size, and works all words out twice for it.
    """
    rows = lines.select(id, T.split_words(F.col(text)).alias("_raw"))
    rows = rows.select(id, "_raw", T.normalized_words(F.col("_raw")).alias("_token"))
    return rows.select(id, F.posexplode_outer(F.arrays_zip("_raw", "_token")).alias("pos", "_w")).where("pos IS NOT NULL").select(id, "pos", F.col("_w._raw").alias("raw"), F.col("_w._token").alias("token"))


def _schema(df: DataFrame, id: str) -> StructType:
    fields = [StructField(c, t) for c, t in (("first", IntegerType()), ("last", IntegerType()), ("term_order", IntegerType()), ("term", StringType()), ("category", StringType()), ("targets", ArrayType(IntegerType())))]
    return StructType([df.schema[id], *fields])


def _places(ids: pa.Array, found: list[tuple[int, int, int, int, str]], words: WordList, token: Callable[[int, int], str], names: list[str]) -> pa.RecordBatch:
    """The rows of a walk: row, first, last, order, category; order -1 for masked words, named by their token."""
    rows, first, last, order, category = zip(*found, strict=True) if found else ((),) * 5
    masked = lambda r, p, c: token(r, p) if c == MASKED else f"masked:{token(r, p)}"
    term = [words.terms[o][0] if o >= 0 else masked(r, p, c) for r, p, o, c in zip(rows, first, order, category, strict=True)]
    columns = [ids.take(pa.array(rows, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array([o if o >= 0 else None for o in order], pa.int32()), pa.array(term, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(category, pa.string()), pa.array([words.targets[o] if o >= 0 else [0] for o in order], pa.list_(pa.int32()))], names)


SLICE = 1 << 16  #: words of lines that are worked on at once; a longer line stays whole


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of SLICE words in all, so that what a task holds does not grow with the batch."""
    ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    row = 0
    while row < batch.num_rows:
        done = ends[row - 1] if row else 0
        after = max(row + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        yield batch.slice(row, after - row)
        row = after


def find(lines: DataFrame, id: str, words: WordList, text: str = "text", characters: bool = False) -> DataFrame:
    """(id, first, last, term_order, term, category, targets): every place of lines where a term or a masked word stands; last is exclusive.

    Single words that are allowed are left out; phrases may hold them. Masked words, if the list looks for marks, have no
    term_order. Each distinct word of a batch is normalised and looked up once; a line is walked over the words that fit something.
    characters: with begin and end, the characters of the line where a place begins and ends.
    """
    shared = lines.sparkSession.sparkContext.broadcast(words)
    rows = lines.select(id, T.split_words(F.col(text)).alias("_raw"), *([F.col(text).alias("_text")] if characters else []))
    schema = _schema(rows, id)
    names = list(schema.names)
    if characters:
        schema = schema.add("begin", IntegerType()).add("end", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in _slices(whole)):
            lists = batch.column(1)
            flat = lists.flatten()
            begins = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            distinct = flat.dictionary_encode()
            heard = distinct.dictionary.to_pylist()
            known = [own.read(t) for t in heard]
            useful = np.array([k is not None for k in known], bool)
            codes = distinct.indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(useful[codes]) if len(codes) else np.zeros(0, np.int64)
            row = np.searchsorted(begins, at, "right") - 1
            found = list(own.walk(zip(row.tolist(), (at - begins[row]).tolist(), [known[c] for c in codes[at].tolist()], strict=True)))
            places = _places(batch.column(0), found, own, lambda r, p: T.normal(heard[codes[begins[r] + p]]), names)
            if characters:
                stand = {r: T.word_places(batch.column(2)[r].as_py()) for r in {f[0] for f in found}}
                at_text = [pa.array([stand[r][first][0] for r, first, *_ in found], pa.int32()), pa.array([stand[r][last - 1][1] for r, _, last, *_ in found], pa.int32())]
                places = pa.RecordBatch.from_arrays([*places.columns, *at_text], [*names, "begin", "end"])
            yield places

    return rows.mapInArrow(run, schema)


def find_words(words: DataFrame, id: str, terms: WordList) -> DataFrame:
    """find for words that lie as rows: id, pos, token.

    A row that fits something goes on; words of phrases then meet within their line, so only lines with hits are sorted.
    """
    shared = words.sparkSession.sparkContext.broadcast(terms)
    rows = words.select(id, F.col("pos").cast("int").alias("pos"), "token")

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            distinct = batch.column(2).dictionary_encode()
            keep = np.array([own.look(t) is not None for t in distinct.dictionary.to_pylist()] + [False], bool)
            yield batch.filter(pa.array(keep[distinct.indices.fill_null(len(keep) - 1).to_numpy(zero_copy_only=False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, line, now = shared.value, [], 0, None
        for batch in batches:
            ids, pos, heard = (batch.column(i).to_pylist() for i in range(3))
            numbers = []
            for key in ids:
                line, now = (line, now) if key == now else (line + 1, key)
                numbers.append(line)
            at = {place: i for i, place in enumerate(zip(numbers, pos, strict=True))}
            found = own.walk(zip(numbers, pos, map(own.look, heard), strict=True), state)
            by_row = [(at[n, last - 1], first, last, order, category) for n, first, last, order, category in found]
            yield _places(batch.column(0), by_row, own, lambda r, p: heard[r], schema.names)

    hit = rows.mapInArrow(useful, rows.schema)
    schema = _schema(rows, id)
    return hit.repartition(id).sortWithinPartitions(id, "pos").mapInArrow(run, schema)


def greedy(found: DataFrame, id: str) -> DataFrame:
    """Of overlapping candidates the longest, then the first listed, then the first in the line, are kept.

    Only candidates of one island compete. Those alone in theirs are kept at once; the others come one after the other,
    best first, and a task holds the taken places of one island only.
    """
    rows = islands(found, [id], 0, False, "max", "first", "last", ["term_order"], "_i")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(id, "_i")))
    alone = rows.where("_n = 1").drop("_i", "_n")
    rest = rows.where("_n > 1").drop("_n").withColumn("_key", F.struct(id, "_i"))
    rest = rest.repartition(id, "_i").sortWithinPartitions(id, "_i", F.col("first") - F.col("last"), "term_order", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, taken = None, set()
        for batch in batches:
            keep = []
            for key, first, last in zip(*(batch.column(c).to_pylist() for c in ("_key", "first", "last")), strict=True):
                if key != island:
                    island, taken = key, set()
                places = range(first, last)
                keep.append(taken.isdisjoint(places))
                if keep[-1]:
                    taken.update(places)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = rest.mapInArrow(run, rest.schema).drop("_i", "_key")
    return alone.unionByName(kept)


def settle(found: DataFrame, id: str) -> DataFrame:
    """The matches among places: of terms the greedy choice, and masked words at places that it leaves free."""
    return _settled(durable(found, "places"), id)


def _settled(found: DataFrame, id: str) -> DataFrame:
    kept = greedy(found.where("term_order IS NOT NULL"), id)
    used = kept.select(id, F.explode(F.sequence("first", F.col("last") - 1)).alias("first"))
    return kept.unionByName(found.where("term_order IS NULL").join(used, [id, "first"], "left_anti").select(*kept.columns))


def word_list(terms: Sequence[Term], allow: Sequence[str] = (), disabled: Sequence[str] = (), marks: str | None = "[*#]") -> WordList:
    """The list of the terms that are not disabled; masked words are compared with all of them."""
    return WordList([t for t in terms if t.category not in disabled], allow, marks, terms, disabled)


def match(lines: DataFrame, id: str, terms: Sequence[Term], allow: Sequence[str] = (), text: str = "text", disabled: Sequence[str] = (), marks: str | None = "[*#]") -> DataFrame:
    """All matches of lines: listed terms, the longest first, then masked words at places that these leave (marks null: none).

    Terms of disabled categories are not looked for; a masked word that only they explain is left out.
    """
    return settle(find(lines, id, word_list(terms, allow, disabled, marks), text), id)


def match_words(words: DataFrame, id: str, terms: Sequence[Term], allow: Sequence[str] = (), disabled: Sequence[str] = (), marks: str | None = "[*#]") -> DataFrame:
    """match for words: id, pos, token."""
    return settle(find_words(words, id, word_list(terms, allow, disabled, marks)), id)


def detections(matches: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first, start, end, heard, term, category, confidence): one row for each run of a match's targets.

    words: keys, pos, raw, start, end, probability. The surest a run can be is its least sure word.
    """
    runs = matches.select(*keys, "first", "term", "category", F.posexplode("targets").alias("k", "t"))
    runs = runs.withColumn("run", F.col("t") - F.col("k")).withColumn("pos", F.col("first") + F.col("t"))
    rows = runs.join(words, [*keys, "pos"])
    heard = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: F.trim(x["raw"])), " ")
    return rows.groupBy(*keys, "first", "term", "category", "run").agg(
        F.min_by("start", "pos").alias("start"), F.greatest(F.max_by("end", "pos"), F.min_by("start", "pos")).alias("end"), heard.alias("heard"), run_confidence().alias("confidence")
    ).drop("run")


def run_confidence(probability: str = "probability") -> Column:
    """How sure a run of words is: as its least sure word."""
    return F.min(probability)


def masked_categories(words: DataFrame, terms: Sequence[Term], marks: str = "[*#]") -> DataFrame:
    """(token, category) of the distinct masked tokens: what each may hide (Samples.category)."""
    shared = words.sparkSession.sparkContext.broadcast(Samples(terms))
    masked = words.select("token").where(T.is_masked(F.col("token"), marks)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.category(t) for t in batch.column(0).to_pylist()], pa.string())], ["token", "category"])

    return masked.mapInArrow(run, "token string, category string")


def hints(lines: DataFrame, id: str, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """(id, pos): where a hint stands in lines, each place once."""
    found = find(lines, id, WordList([Term(p, "hint") for p in patterns]), text)
    return found.select(id, F.col("first").alias("pos")).distinct()


def flag_cues(lines: DataFrame, id: str, terms: Sequence[Term], hint_words: Sequence[str], text: str = "text") -> DataFrame:
    """(id, reasons, words): lines with a listed, masked or hint word; sorted distinct reasons.

    words: (first, last, term) of listed and masked words in order, by the line's characters.
    """
    both = WordList([*terms, *(Term(h, "hint") for h in hint_words)], marks="[*#]", samples=terms)
    found = durable(find(lines, id, both, text, characters=True), "places")  # one walk for terms, masked words and hints
    hint = F.coalesce(F.col("term_order") >= len(terms), F.lit(False))
    placed = _settled(found.where(~hint), id).select(id, F.when(F.col("term_order").isNull(), "masked").otherwise("lexicon").alias("reason"), F.struct(F.col("begin").alias("first"), F.col("end").alias("last"), "term").alias("_w"))
    flags = placed.unionByName(found.where(hint).select(id, F.lit("hint").alias("reason")).distinct(), allowMissingColumns=True)
    return flags.groupBy(id).agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_list("_w")).alias("words"))


def flag_counts(flags: DataFrame, keys: Sequence[str], reasons: Sequence[str] = ("lexicon", "masked", "hint")) -> DataFrame:
    """(keys, one column for each reason): how many flagged lines have it; a line may count for several."""
    return flags.groupBy(*keys).agg(*(F.count_if(F.array_contains("reasons", r)).alias(r) for r in reasons))


def phrases(lines: DataFrame, id: str, terms: Sequence[str], text: str = "text") -> DataFrame:
    """(id, found): the terms in each line, each once, in the order in which they first stand there."""
    found = match(lines, id, [Term(t, "phrase") for t in terms], text=text, marks=None)
    first = found.groupBy(id, "term").agg(F.min("first").alias("first"))
    return first.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "term"))), lambda x: x["term"]).alias("found"))


def broad_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """terms with `broad`: whether a word has a wildcard and fewer than three letters besides."""
    word = lambda w: F.contains(w, F.lit("*")) & (F.length(F.regexp_replace(w, r"\P{L}", "")) < 3)
    return terms.withColumn("broad", ~F.col(term).startswith(SEARCH) & F.exists(F.split(F.trim(term), r"\s+"), word))


def term_counts(terms: DataFrame, category: str = "category") -> DataFrame:
    """(category, n): how many terms each category lists."""
    return terms.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def substitutes(found: DataFrame, replacements: DataFrame, crowded: Column) -> DataFrame:
    """found (term, ...) with substitute and reason: the first rule that fails says why there is none.

    replacements: (term, substitute), one row a term, in small letters.
    """
    known = replacements.select(F.lower("term").alias("_term"), "substitute")
    rows = found.withColumn("_term", F.lower("term")).join(known, "_term", "left").drop("_term")
    reason = F.when(F.col("substitute").isNull(), "no substitute").when(crowded, "another word in the span")
    return rows.withColumn("reason", reason).withColumn("substitute", F.when(reason.isNull(), F.col("substitute")))


def fit_case(heard: Column, substitute: Column) -> Column:
    """A substitute in the case of the word that it replaces, with that word's punctuation around it."""
    trimmed = F.regexp_replace(heard, r"(?U)^\s+|\s+$", "")
    lead = F.regexp_extract(trimmed, r"(?U)^(\W*)", 1)
    core = F.regexp_replace(trimmed, r"(?U)^\W+|\W+$", "")
    trail = F.when(core == "", "").otherwise(F.regexp_extract(trimmed, r"(?U)(\W*)$", 1))
    cased = F.rlike(core, F.lit(r"\p{Lu}")) & ~F.rlike(core, F.lit(r"\p{Ll}"))
    first = F.substr(core, F.lit(1), F.lit(1))
    shown = F.when((F.length(core) > 1) & cased, F.upper(substitute)).when(F.rlike(first, F.lit(r"\p{Lu}")), F.concat(F.upper(F.substr(substitute, F.lit(1), F.lit(1))), F.substr(substitute, F.lit(2)))).otherwise(substitute)
    return F.concat(lead, shown, trail)
