"""Grouping of spelling variants: words at one edit from each other, the common form of each, and its root.

Of two words that differ by one inserted, deleted or replaced code point, the part before the error or the part after it
is the same in both. With a word of L code points cut at L // 2, either its first half stands unchanged at the front of
the other word, and the error is behind it, or its last half stands unchanged at the end. So words are dealt to groups
by their halves, once from the front and once from the back. Each group has an automaton of its words without the common
half, read forward in the groups of first halves and backward in those of last halves. A word walks it with one error;
what it meets is named by its perfect-hash number. A pair that both directions could find is left to the forward one.

The automata are minimal and acyclic, and hold a group's words, or TILE of them: a larger group is cut into tiles, and each of its
words asks each tile. Nothing but groups meets in a task, and no table of all words is ever in one place.

Defined results: a null text has no words; rows that repeat count again; a null doc_id is an empty text in the hash that
damages words; an empty table gives an empty one; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.text import LOWER, UPPER
from loomspan.session import discard, durable

RUN = r"[A-Za-zÀ-ÿ]+"
TILE = 8192  #: words of one automaton


class Automaton:
    """A minimal acyclic automaton of sorted distinct words, numbered by perfect hashing.

    The number of a word is its place in the sorted list: the sum of the offsets of the edges on its way, where an edge's
    offset counts the words that leave its state earlier: the one that ends there, and those behind smaller letters.
    """

    def __init__(self, words: list[str]) -> None:
        self._known: dict[tuple, int] = {}  # a state by its content: equal states are one
        self._sizes: list[int] = []  # words behind a state
        self.edges: list[dict[str, tuple[int, int]]] = []  # of each state: target and offset by letter
        self.final: list[bool] = []
        open_: list[list] = [[False, []]]  # states on the way of the last word: whether one ends here, closed edges
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(open_, last, same)
            open_ += [[False, []] for _ in word[same:]]
            open_[-1][0] = True
            last = word
        self._close(open_, last, 0)
        self.start = self._state(open_[0])

    def _close(self, open_: list[list], last: str, depth: int) -> None:
        """End the states of the last word that lie below depth; their letters become edges."""
        while len(open_) > depth + 1:
            state = self._state(open_.pop())
            open_[-1][1].append((last[len(open_) - 1], state))

    def _state(self, content: list) -> int:
        key = (content[0], *content[1])
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.edges)
            edges, before = {}, int(content[0])
            for letter, target in content[1]:
                edges[letter] = (target, before)
                before += self._sizes[target]
            self.edges.append(edges)
            self.final.append(content[0])
            self._sizes.append(before)
        return found

    def exact(self, word: str, state: int, number: int) -> int:
        """The number of the word that goes on with these letters from a state, or -1."""
        for letter in word:
            step = self.edges[state].get(letter)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str) -> set[int]:
        """Numbers of the words that differ from word by exactly one inserted, deleted or replaced letter."""
        found, state, number = set(), self.start, 0
        for i in range(len(word) + 1):
            letter = word[i : i + 1]  # empty behind the last one
            if letter:
                found.add(self.exact(word[i + 1 :], state, number))  # deleted
            for other, (target, offset) in self.edges[state].items():
                if letter and other != letter:
                    found.add(self.exact(word[i + 1 :], target, number + offset))  # replaced
                found.add(self.exact(word[i:], target, number + offset))  # inserted before it
            step = self.edges[state].get(letter)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found - {-1, self.exact(word, self.start, 0)}


def damaged_words(docs: DataFrame, rule: int = 97, least: int = 5) -> DataFrame:
    """(word): every run of letters of each text, with A-Z lower-cased, of least code points at least.

    If the CRC-32 of `doc_id:run` is a multiple of rule, the run loses the code point at that number modulo its length.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    runs = docs.select(doc, F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.where(F.length("run") >= least).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return hashed.select(F.when(F.col("h") % rule == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n): each ordered pair of words that differ by exactly one code point, once. words: (word, n), distinct."""
    size = F.length("word")
    first, last = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
    # words of size - 1 and size + 1 cut off halves of these sizes; one of the two is the word's own
    other_first = F.when(size % 2 == 0, first - 1).otherwise(first + 1)
    other_last = F.when(size % 2 == 0, last + 1).otherwise(last - 1)
    groups = [
        F.struct(F.lit(front).alias("front"), (F.substring("word", F.lit(1), n) if front else F.right("word", n)).alias("half"), F.lit(asks).alias("asks"))
        for front, n, asks in ((True, first, True), (True, other_first, False), (False, last, True), (False, other_last, False))
    ]
    dealt = words.select("word", "n", F.explode(F.array(*groups)).alias("g")).select("word", "n", "g.*")
    large = durable(dealt.groupBy("front", "half").count().where(F.col("count") > tile), "large")
    tiled = dealt.join(large.select("front", "half", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), ["front", "half"], "left")
    own = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("tiles"))).cast("int")
    each = F.when(F.col("asks") & F.col("tiles").isNotNull(), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own))
    rows = tiled.select("front", "half", "word", "n", "asks", own.alias("own"), F.explode(each).alias("tile"))
    rows = rows.select("front", "half", "tile", (F.col("own") == F.col("tile")).alias("listed"), "word", "n", "asks")
    keys = ["front", "half", "tile"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("listed"), "word").mapInArrow(_search, "word string, near string, near_n long")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(7)), strict=True) for b in batches)
    out: list[tuple[str, str, int]] = []
    for (front, half, _), group in groupby(rows, key=lambda r: r[:3]):
        size = len(half)
        listed, guests = [], []  # the group's words, TILE at most, and the first that only asks
        for row in group:
            if not row[3]:
                guests = [row]
                break
            listed.append((row[4][size:] if front else row[4][: len(row[4]) - size][::-1], *row[4:]))
        if len(listed) + len(guests) < 2 or not listed:
            continue
        listed.sort()
        automaton = Automaton([rest for rest, *_ in listed])
        for word in chain((w for _, w, _, asks in listed if asks), (r[4] for r in chain(guests, group))):
            cut = len(word) // 2
            for number in automaton.near(word[cut:] if front else word[:cut][::-1]):
                _, near, n, _ = listed[number]
                if front or near[:cut] != word[:cut]:  # else the forward automaton finds it
                    out.append((word, near, n))
            if len(out) > 20000:
                yield _batch(out)
                out = []
    yield _batch(out)


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows of (word, form): the last word that following forms leads to.

    Each round joins the words that a word has reached with those that these have reached, so the way doubles. A form is
    at least twice as frequent as its word, so ways are short and no cycle exists.
    """
    reached = durable(forms.select("word", F.col("form").alias("root")), "reached")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "reached")
        discard(reached)
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts that is long and frequent enough.

    docs: doc_id, text. form is the near word of largest n (ties: smallest in code-point order) if that is factor times
    n at least; root is where forms lead, the word itself without one.
    """
    counts = damaged_words(docs, least=least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = durable(counts.where(F.col("n") >= least_n), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.m") >= factor * F.col("n")
    marked = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")
    )
    marked = durable(marked, "marked")
    found = roots(marked.where("form is not null"))
    return marked.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
