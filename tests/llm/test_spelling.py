import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.spelling import Automaton, near_pairs, variants

SCHEMA = "doc_id long, text string, word string, n int, form double"


def near(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any(a[:i] + b[i : i + 1] + a[i + (len(a) == len(b)) :] == b for i in range(len(b)))


def plain(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    n = {w: k for w, k in found.items() if len(w) >= 5 and k >= 3}
    next_to = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in next_to.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(next_to[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def ours(spark, docs):
    out = variants(spark.createDataFrame([(d, t, "x", 1, 1.0) for d, t in docs], SCHEMA))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=6), min_size=1, max_size=60), st.text("abé", max_size=6))
def test_an_automaton_numbers_words_and_finds_those_with_one_error(words, asked):
    words = sorted(words)
    automaton = Automaton(words)
    assert [automaton.exact(w, automaton.start, 0) for w in words] == list(range(len(words)))
    assert automaton.near(asked) == {i for i, w in enumerate(words) if near(asked, w)}
    assert (automaton.exact(asked, automaton.start, 0) >= 0) == (asked in words)


def test_an_automaton_is_minimal():
    assert len(Automaton(sorted(f"{a}{b}ing" for a in "abc" for b in "xyz")).edges) == 6


def test_pairs_are_those_of_plain_python_in_tiles_too(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(400)})
    expected = sorted((a, b, i) for a in words for i, b in enumerate(words) if near(a, b))
    table = spark.createDataFrame(list(zip(words, range(len(words)), strict=True)), "word string, n long")
    for tile in (8192, 7, 1):
        assert sorted(tuple(r) for r in near_pairs(table, tile).collect()) == expected, tile


def test_variants_are_those_of_plain_python(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdéÿ", k=rng.randint(4, 9))) for _ in range(12)]
    docs = [(None, "Hello HELLO hello"), (1, None), (2, ""), (2, "same same2same"), (2, "same same2same"), (7, "Éclair éclair ÉCLAIR éclair× a÷b"), (8, "日本 hello,hellö;hello")]
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 80)):
            w = rng.choice(base[: rng.randint(1, 12)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "É", "x", "B"]) + w[at + rng.randint(0, 1) :]
            text.append(w)
        docs.append((i, " ".join(text)))
    docs.append((99, "word " * 30000 + "words " * 5 + "sword" + " stonexy" * 3 + " stonex" * 6 + " stone" * 12))  # a very long text, and a chain of forms
    expected = plain(docs)
    assert len(expected) > 60 and any(r[1] and r[2] != r[1] for r in expected)
    assert ours(spark, docs) == expected


def test_ties_take_the_smallest_word(spark):
    assert ours(spark, [(1, "abcdx " * 3 + "abcdz " * 6 + "abcdy " * 6)]) == plain([(1, "abcdx " * 3 + "abcdz " * 6 + "abcdy " * 6)])
    assert ("abcdx", "abcdy", "abcdy", 3, 2, 6) in ours(spark, [(1, "abcdx " * 3 + "abcdz " * 6 + "abcdy " * 6)])


def test_nothing(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, "a b c"), (2, None), (None, None)]) == []
