import random
import re

import pytest

from loomspan.llm.graph import components
from loomspan.llm.near_duplicates import NearDuplicateOptions, near_duplicates

SCHEMA = "doc_id long, text string, key string, bands int, h long"


def shingles(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    top = {i: i for i, _ in sets if i is not None}
    # rows of equal doc_id are one node

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=repr)


def run(spark, rows, **o):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), NearDuplicateOptions(**o)).collect()
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("options", [{}, {"tile": 8, "star": 3}])
def test_against_brute_force(spark, options):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 25 + 1))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([str.upper, str.lower])("  ".join(own)) + "\n", "k", i, 1))
    # chains: each text drifts a little from the one before, so stars alone miss links
    own = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(30):
        rows.append((len(rows), " ".join(own), "k", 0, 1))
        own[rng.randrange(60)] = rng.choice(vocabulary)
    rng.shuffle(rows)
    assert run(spark, rows, **options) == brute(rows)


def test_defined_results(spark):
    long = "word " * 40000
    rows = [(1, None, "", 1, 1), (2, "", "", 1, 1), (3, " \n\t ", "", 1, 1), (4, "Two words", "", 1, 1), (5, "two  WORDS", "", 1, 1), (6, "two", "", 1, 1), (7, long, "", 1, 1), (8, long, "", 1, 1), (7, long, "", 1, 1), (None, "two words", "", 1, 1), (9, "é ü ö ä ß", "", 1, 1)]
    got = run(spark, rows)
    want = brute(rows)
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert [r for r in got if r[0] is None] == [(None, 1, None, False)]
    assert run(spark, []) == []


def test_one_doc_id_with_several_texts_is_one_node(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey")
    rows = [(1, one, "", 1, 1), (5, one, "", 1, 1), (5, two, "", 1, 1), (7, two, "", 1, 1), (8, three, "", 1, 1), (9, three, "", 1, 1), (9, None, "", 1, 1), (6, "", "", 1, 1), (6, two, "", 1, 1)]
    assert run(spark, rows) == brute(rows)
    assert {r[0]: r[2] for r in run(spark, rows)} == {1: 1, 5: 1, 7: 1, 6: 1, 8: 8, 9: 8}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                top.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert got == top
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
