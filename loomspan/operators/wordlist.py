"""A word list as one automaton: words, wildcards and phrases, looked up in a single walk of a line.

A list is built once on the driver and sent to each task. A word of a line is looked up once: plain words in a table,
wildcards in a trie whose stars stay on letters, so that all wildcards are walked at once, letter by letter, and patterns
one by one. A task remembers what a word fits, so a word that comes again costs one look. Phrases are a trie of such
words; the places in it that the last word led to are carried from word to word. Ten thousand terms make neither a larger
plan nor more passes than one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as T

SEARCH = "re:"  #: begins a term that is a pattern, searched for in a word
MASKED = "masked"  #: the category of masked words that fit no listed one
LETTER = re.compile(r"[\w']")  #: what a wildcard or a mask stands for
BRACKETED = re.compile(r"\[(.+)\]")
REMEMBERED = 1 << 17  #: words that a task remembers at most

#: fixed values: endings tried when a masked token is compared with a listed word
ENDINGS = ("", "s", "es", "ed", "er", "ers", "ing", "in", "y", "ty", "head", "hole")


@dataclass(frozen=True)
class Term:
    """A listed word or phrase: `*` stands for any letters; [word] marks what a phrase is listed for; re:x is a pattern."""

    text: str
    category: str


@dataclass(frozen=True)
class Part:
    """One word of a term: its spellings, with and without hyphens, in which * is a wildcard; or a pattern to search for."""

    spellings: tuple[str, ...]
    target: bool = False
    search: bool = False

    def fits(self, token: Column) -> Column:
        """Whether a normalised token is meant, in one of its forms."""
        either = "|".join(r"[\w']*".join(rf"\Q{x}\E" if x else "" for x in s.split("*")) for s in self.spellings)
        pattern = "(?iuU)" + self.spellings[0] if self.search else f"(?U)^(?:{either})$"
        joined = F.replace(token, F.lit("-"), F.lit(""))
        return (token != "") & (F.rlike(token, F.lit(pattern)) | ((joined != "") & F.rlike(joined, F.lit(pattern))))


def listed(word: str) -> str:
    """A word of the list in the form that tokens have: only its punctuation stays."""
    plain = unicodedata.normalize("NFKC", word).translate(str.maketrans(T.QUOTES, T.STRAIGHT))
    return re.sub(r"([^\W\d_])\1\1+", r"\1", plain.casefold().strip())


def part(word: str) -> Part:
    """The Part that a word of a term stands for. Raises ValueError where it has nothing but wildcards."""
    inner = BRACKETED.fullmatch(word)
    body = listed(inner[1] if inner else word)
    spellings = tuple(s for s in dict.fromkeys((body, body.replace("-", ""))) if s.strip("*"))
    if not spellings:
        raise ValueError(f"{word!r} holds nothing but wildcards")
    return Part(spellings, target=inner is not None)


def parts(term: Term) -> tuple[Part, ...]:
    """The words of a term, in order. Raises ValueError for an empty one, and for a pattern that is none."""
    text = term.text.strip()
    if text.startswith(SEARCH):
        try:
            re.compile(text[len(SEARCH) :], re.IGNORECASE)
        except re.error as e:
            raise ValueError(f"{text!r}: {e}") from e
        return (Part((text[len(SEARCH) :],), search=True),)
    if not text:
        raise ValueError("an empty term")
    return tuple(part(w) for w in text.split())


def targets(of: Sequence[Part]) -> list[int]:
    """The places of the words that a term is listed for: those in brackets, or all."""
    return [i for i, p in enumerate(of) if p.target] or list(range(len(of)))


class Wildcards:
    """A trie of spellings with stars. A star's node stays where it is on every letter, and needs none."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.star: list[int] = [-1]  # the node behind a star
        self.stays: list[bool] = [False]
        self.ends: list[tuple[int, ...]] = [()]

    def add(self, spelling: str, name: int) -> None:
        node = 0
        for c in spelling:
            if c == "*":
                if not self.stays[node]:  # two stars are one
                    if self.star[node] < 0:
                        self.star[node] = self._node(True)
                    node = self.star[node]
            else:
                if c not in self.next[node]:
                    self.next[node][c] = self._node(False)
                node = self.next[node][c]
        self.ends[node] += (name,)

    def _node(self, stays: bool) -> int:
        for column, value in ((self.next, {}), (self.star, -1), (self.stays, stays), (self.ends, ())):
            column.append(value)
        return len(self.next) - 1

    def _reached(self, nodes: Iterable[int]) -> set[int]:
        found = set(nodes)
        return found | {self.star[n] for n in found if self.star[n] >= 0}

    def fits(self, word: str) -> set[int]:
        """The names of all spellings that a word fits."""
        nodes = self._reached([0])
        for c in word:
            letter = LETTER.match(c) is not None
            nodes = self._reached([n for n in nodes if letter and self.stays[n]] + [self.next[n][c] for n in nodes if c in self.next[n]])
            if not nodes:
                break
        return {name for n in nodes for name in self.ends[n]}


class Samples:
    """The words that masked tokens may hide, with their usual endings: a trie whose words name the first category that has them."""

    def __init__(self, terms: Sequence[Term]) -> None:
        self.categories = list(dict.fromkeys(t.category for t in terms))
        self.root: dict = {}
        for t in terms:
            of = parts(t)
            for i in targets(of):
                if not of[i].search:
                    for ending in ENDINGS:
                        node = self.root
                        for c in of[i].spellings[0].replace("*", "") + ending:
                            node = node.setdefault(c, {})
                        node[""] = min(node.get("", len(self.categories)), self.categories.index(t.category))

    def category(self, token: str) -> str:
        """The first category with a word that a masked token may hide, MASKED if none.

        A mark stands for one letter; where no sample fits so, a run of marks for any number of them. A token without a
        letter hides nothing that could be told.
        """
        if any(c.isalpha() for c in token):
            for many in (False, True):
                found = min(self._hidden(token, many), default=None)
                if found is not None:
                    return self.categories[found]
        return MASKED

    def _hidden(self, token: str, many: bool) -> Iterator[int]:
        nodes = [self.root]
        marked = False
        for c in token:
            if LETTER.match(c):
                nodes, marked = [n[c] for n in nodes if c in n], False
            elif not (many and marked):
                nodes, marked = [n[x] for n in nodes for x in n if x and LETTER.match(x)], True
                below = nodes if many else []
                while below:
                    below = [n[x] for n in below for x in n if x and LETTER.match(x)]
                    nodes = nodes + below
        return (n[""] for n in nodes if "" in n)


class WordList:
    """The terms of a list, what is allowed, and what looks masked."""

    def __init__(self, terms: Sequence[Term], allow: Sequence[str] = (), marks: str | None = None, samples: Sequence[Term] | None = None, disabled: Sequence[str] = ()) -> None:
        self.terms = [(t.text.strip(), t.category) for t in terms]
        words = [parts(t) for t in terms]
        self.sizes, self.targets = [len(w) for w in words], [targets(w) for w in words]
        self.marks = re.compile(marks) if marks else None
        self.samples, self.disabled = Samples(terms if samples is None else samples) if marks else None, frozenset(disabled)
        self.plain: dict[str, tuple[int, ...]] = {}
        self.wild, self.searched = Wildcards(), []
        self.phrases: list[dict[int, int]] = [{}]  # a trie of part names
        self.phrase_ends: list[tuple[int, ...]] = [()]
        self.singles: list[tuple[int, ...]] = []  # the terms of one word that are a part
        names: dict[tuple, int] = {}
        for order, of in enumerate(words):
            found = [self._name(p, names) for p in of]
            if len(found) == 1:
                self.singles[found[0]] += (order,)
            else:
                node = 0
                for name in found:
                    if name not in self.phrases[node]:
                        self.phrases[node][name] = len(self.phrases)
                        self.phrases.append({})
                        self.phrase_ends.append(())
                    node = self.phrases[node][name]
                self.phrase_ends[node] += (order,)
        if any(len(a.split()) != 1 for a in allow):
            raise ValueError("the allow list has single words")
        self.allowed = {self._name(part(a), names) for a in allow}
        self._known: dict[str, tuple[tuple[int, ...], bool, str | None] | None] = {}
        self._read: dict[str, tuple[tuple[int, ...], bool, str | None] | None] = {}

    def _name(self, p: Part, names: dict[tuple, int]) -> int:
        key = (p.spellings, p.search)
        if key not in names:
            names[key] = name = len(names)
            self.singles.append(())
            if p.search:
                self.searched.append((re.compile(p.spellings[0], re.IGNORECASE), name))
            for s in () if p.search else p.spellings:
                if "*" in s:
                    self.wild.add(s, name)
                else:
                    self.plain[s] = (*self.plain.get(s, ()), name)
        return names[key]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_read": {}}

    def look(self, token: str) -> tuple[tuple[int, ...], bool, str | None] | None:
        """(parts that a token fits, whether it is allowed, the category that it masks); None if it is of no use."""
        if token in self._known:
            return self._known[token]
        found: set[int] = set()
        for form in dict.fromkeys((token, token.replace("-", ""))):
            if form:
                found.update(self.plain.get(form, ()), self.wild.fits(form) if len(self.wild.next) > 1 else (), (n for p, n in self.searched if p.search(form)))
        masked = self.samples.category(token) if self.marks and len(token) >= 2 and self.marks.search(token) and (len(token) >= 3 or any(c.isalpha() for c in token)) else None
        known = (tuple(sorted(found)), not found.isdisjoint(self.allowed), masked) if found or masked else None
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        self._known[token] = known
        return known

    def read(self, word: str) -> tuple[tuple[int, ...], bool, str | None] | None:
        """look at the normal form of a word as it stands in a text."""
        if word not in self._read:
            if len(self._read) >= REMEMBERED:
                self._read.clear()
            self._read[word] = self.look(T.normal(word))
        return self._read[word]

    def walk(self, places: Iterable[tuple[int, int, tuple]], state: list | None = None) -> Iterator[tuple[int, int, int, int, str]]:
        """(row, first, last, order, category) of what stands in lines; last is exclusive, order -1 for a masked token.

        places: (row, pos, what look says) in order, without those of no use. state, [] at first, lets a line go on in
        another call. A phrase's words stand at places that follow each other.
        """
        before, open_ = state or ((-1, -1), [])
        for row, pos, (fits, allowed, masked) in places:
            if not allowed:
                for name in fits:
                    for order in self.singles[name]:
                        yield row, pos, pos + 1, order, self.terms[order][1]
            begun = [(pos, 0), *(open_ if before == (row, pos - 1) else ())]
            open_ = [(first, self.phrases[node][name]) for first, node in begun for name in fits if name in self.phrases[node]]
            before = (row, pos)
            for first, node in open_:
                for order in self.phrase_ends[node]:
                    yield row, first, pos + 1, order, self.terms[order][1]
            if masked is not None and masked not in self.disabled:
                yield row, pos, pos + 1, -1, masked
        if state is not None:
            state[:] = before, open_
