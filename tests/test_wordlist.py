"""The word list's automaton against a plain matcher that tries every term at every place."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import matching as M
from loomspan.operators.wordlist import Samples, Wildcards, WordList


def plain_fits(spelling, word):
    return re.fullmatch(r"[\w']*".join(map(re.escape, spelling.split("*"))), word) is not None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab*-", min_size=1, max_size=5), min_size=1, max_size=8), st.text("ab-'", max_size=7))
def test_wildcards_of_a_trie(spellings, word):
    trie = Wildcards()
    for i, s in enumerate(spellings):
        trie.add(s, i)
    assert trie.fits(word) == {i for i, s in enumerate(spellings) if plain_fits(s, word)}


def plain_places(tokens, terms, allow):
    """(first, last, order) of every term at every place."""
    forms = lambda t: [f for f in dict.fromkeys((t, t.replace("-", ""))) if f]
    fits = lambda p, t: any(re.search(p.spellings[0], f, re.I) if p.search else any(plain_fits(s, f) for s in p.spellings) for f in forms(t))
    spared = [M.part(a) for a in allow]
    out = []
    for order, term in enumerate(terms):
        of = M.parts(term)
        for i in range(len(tokens) - len(of) + 1):
            if all(fits(p, t) for p, t in zip(of, tokens[i:])) and not (len(of) == 1 and any(fits(p, tokens[i]) for p in spared)):
                out.append((i, i + len(of), order))
    return sorted(out)


def made(rng):
    terms = ["ab", "a*", "*b", "a*b", "*a*", "a-b", "ab a*", "ab ab ab", "[ab] ba", "re:^b+$", "ba ab", "b", "ab", "a* *b ba"]
    chosen = [M.Term(t, rng.choice("xy")) for t in rng.sample(terms, 8)]
    lines = [" ".join(rng.choices(["ab", "ba", "a", "b", "aab", "a-b", "abb", "--", "b'a", "x"], k=rng.randint(0, 14))) for _ in range(40)]
    return chosen, lines, rng.choice([[], ["aa*"], ["ab"], ["b", "a*b"]])


@pytest.mark.parametrize("seed", range(3))
def test_places_of_lines_and_of_rows_are_those_of_a_plain_matcher(spark, seed):
    terms, texts, allow = made(random.Random(seed))
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = []
    for i, text in enumerate(texts):
        words = re.sub("--+", " ", text).split()
        want += [(i, *p) for p in plain_places(words, terms, allow)]
    words = WordList(terms, allow)
    by_line = sorted((r.id, r["first"], r.last, r.term_order) for r in M.find(lines, "id", words).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # phrases go over the bounds of batches
    by_word = sorted((r.id, r["first"], r.last, r.term_order) for r in M.find_words(M.tokens(lines, "id"), "id", words).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert by_line == by_word == sorted(want)


def test_ten_thousand_terms_make_no_larger_plan(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 8)))
    terms = [M.Term(rng.choice([word(), word() + "*", "*" + word(), f"{word()} {word()}"]), "x") for _ in range(10000)]
    texts = [" ".join(rng.choice(terms).text.replace("*", "xyz") if rng.random() < 0.3 else word() for _ in range(30)) for _ in range(50)]
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    few, many = (M.find(lines, "id", WordList(t)) for t in (terms[:2], terms))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < size(few) + 200
    got = sorted((r.id, r["first"], r.last, r.term_order) for r in many.collect())
    known = {}
    for order, t in enumerate(terms):
        known.setdefault(t.text, []).append(order)
    assert len(got) > 300
    for i, first, last, order in rng.sample(got, 200):
        said = texts[i].split()[first:last]
        assert all(plain_fits(M.listed(p), X.normal(w)) for p, w in zip(terms[order].text.split(), said, strict=True))
    for i, text in enumerate(texts):
        for at, w in enumerate(text.split()):
            for order in known.get(w, ()):
                assert (i, at, at + 1, order) in got


@pytest.mark.parametrize("bad", ["", "  ", "*", "a *", "[**]", "re:("])
def test_terms_that_are_none(bad):
    with pytest.raises(ValueError):
        WordList([M.Term(bad, "x")])


@settings(max_examples=300, deadline=None)
@given(st.text("dam*#-n'g", min_size=1, max_size=7))
def test_masked_words_hide_the_first_category_that_fits(token):
    terms = [M.Term("damn", "mild"), M.Term("man*", "other"), M.Term("oh [nag]", "target"), M.Term("re:x", "none")]
    words = {"mild": ["damn"], "other": ["man"], "target": ["nag"], "none": []}
    from loomspan.operators.wordlist import ENDINGS

    want = M.MASKED
    if any(c.isalpha() for c in token):
        one = re.sub(r"[^\w']", r"[\\w']", token)
        many = re.sub(r"[^\w']+", r"[\\w']+", token)
        for pattern in (many, one):
            for category in reversed(list(words)):
                if any(re.fullmatch(pattern, w + e) for w in words[category] for e in ENDINGS):
                    want = category
        hit = [c for c in words if any(re.fullmatch(one, w + e) for w in words[c] for e in ENDINGS)] or [c for c in words if any(re.fullmatch(many, w + e) for w in words[c] for e in ENDINGS)]
        want = hit[0] if hit else M.MASKED
    assert Samples(terms).category(token) == want


def test_the_normal_form_in_python_is_that_of_columns(spark):
    rng = random.Random(7)
    letters = "aAbBßςΣéÉﬁİıĳ½Ⅷ²''\"’“.-—_*#…()[]♪1227  ǅŉ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))).replace(" ", "x").replace(" ", "y") for _ in range(3000)] + ["sooo", "ÄÄÄÄ", "1000", "...", "'"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.get(X.normalized_words(F.array("w")), F.lit(0)).alias("n"))
    bad = [(r.w, r.n, X.normal(r.w)) for r in df.collect() if r.n != X.normal(r.w)]
    assert not bad, bad[:10]
