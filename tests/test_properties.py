"""Operators against plain Python on many random groups at once."""

import random

from loomspan.functions import text as X
from loomspan.operators import matching as M
from loomspan.operators import spans as S

SPANS = "media int, id int, start int, end int, conf int"


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def random_spans(groups=150, seed=1):
    rng = random.Random(seed)
    rows = []
    for m in range(groups):
        for _ in range(rng.randrange(0, 14)):
            a = rng.randrange(0, 60)
            rows.append((m, len(rows), a, a + rng.randrange(0, 12), rng.randrange(100)))
    return rows


def by_media(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def merged(rows, gap, closed, reach):
    out = []
    last = None
    for _, _, a, b, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        at = (out[-1][1] if reach == "max" else last) if out else None
        if out and (a - at <= gap if closed else a - at < gap):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
        last = b
    return out


def test_merges(spark):
    rows = random_spans()
    df = spark.createDataFrame(rows, SPANS)
    for gap in (0, 3):
        for closed in (False, True):
            for reach in ("max", "last"):
                got = S.merge_spans(df, ["media"], gap, closed, reach)
                want = sorted((m, *s) for m, r in by_media(rows).items() for s in merged(r, gap, closed, reach))
                assert sorted((r.media, r.start, r.end) for r in got.collect()) == want
                if reach == "max":
                    split = S.merge_spans(df.select("media", "start", "end"), ["media"], gap, closed, bucket=7)
                    assert sorted((r.media, r.start, r.end) for r in split.collect()) == want
                    again = S.merge_spans(got, ["media"], gap, closed)
                    assert sorted((r.media, r.start, r.end) for r in again.collect()) == want


def test_dedupe(spark):
    rows = random_spans(seed=2)
    want = []
    for own in by_media(rows).values():
        kept = []
        for r in sorted(own, key=lambda r: (r[2], r[3], r[1])):
            hit = next((i for i, k in enumerate(kept) if k[2] <= r[3] and r[2] <= k[3]), None)
            if hit is None:
                kept.append(r)
            elif r[4] > kept[hit][4]:
                kept[hit] = r
        want += kept
    got = S.dedupe(spark.createDataFrame(rows, SPANS), ["media"], "conf")
    assert sorted(tuple(r) for r in got.select("media", "id", "start", "end", "conf").collect()) == sorted(want)


def test_difference_and_joins(spark):
    rows = random_spans(60, 3)
    regions = [r for r in rows if r[1] % 3 == 0 and r[3] > r[2]]
    cover = [r for r in rows if r[1] % 3]
    df, other = spark.createDataFrame(regions, SPANS), spark.createDataFrame(cover, SPANS)
    want = []
    for m, i, a, b, _ in regions:
        free = [t for t in range(a, b) if not any(c[0] == m and c[2] <= t < c[3] for c in cover)]
        for t in free:
            if want and want[-1][1] == i and want[-1][3] == t and not any(c[0] == m and c[2] == c[3] == t for c in cover):
                want[-1][3] = t + 1
            else:
                want.append([m, i, t, t + 1])
    got = sorted((r.media, r.id, r.start, r.end) for r in S.difference(df, other.where("end > start"), ["media"], "id", 1, 10).collect())
    joined = []
    for m, i, a, b in sorted(map(tuple, want)):  # pieces that only a span without length parts are one here
        if joined and joined[-1][1] == i and joined[-1][3] == a:
            joined[-1][3] = b
        else:
            joined.append([m, i, a, b])
    assert got == [tuple(x) for x in joined]
    right = other.withColumnsRenamed({"id": "r_id", "start": "r_start", "end": "r_end"}).drop("conf")
    for closed in (False, True):
        meets = (lambda p, q: p[2] <= q[3] and q[2] <= p[3]) if closed else (lambda p, q: p[2] < q[3] and q[2] < p[3])
        want = sorted((p[1], q[1]) for p in regions for q in cover if p[0] == q[0] and meets(p, q))
        for size in (1, 7, 100):
            got = S.overlap_join(df, right, ["media"], size, closed)
            assert sorted((r.id, r.r_id) for r in got.collect()) == want


def test_greedy_matching(spark):
    rng = random.Random(4)
    terms = ["a", "b", "a b", "b a", "a b c", "c", "c a", "b c a b"]
    lines = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 15)))) for i in range(300)]
    want = []
    for i, text in lines:
        words, taken = text.split(), set()
        found = [(-len(t.split()), n, p, t) for n, t in enumerate(terms) for p in range(len(words)) if words[p : p + len(t.split())] == t.split()]
        for size, _, p, t in sorted(found):
            places = set(range(p, p - size))
            if not places & taken:
                taken |= places
                want.append((i, p, t))
    got = M.match(spark.createDataFrame(lines, "id int, text string"), "id", [M.Term(t, "x") for t in terms])
    assert sorted((r["id"], r["first"], r["term"]) for r in got.collect()) == sorted(want)


def test_fuzz_ratio(spark):
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2)) for _ in range(200)] + [("", ""), ("", "a"), ("é😀a", "😀"), ("ab" * 300, "ba" * 200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "a")], "i int, a string, b string")
    got = {r.i: r.ratio for r in df.select("i", X.fuzz_ratio("a", "b").alias("ratio")).collect()}
    assert got[-1] is None
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100)


def test_best_window_against_brute_force(spark):
    import pytest

    from loomspan.operators import sync as A

    def ratio(a, b):
        return 200 * common_length(a, b) / (len(a) + len(b))

    rng = random.Random(4)
    heard = {m: [rng.choice(["ab", "abc", "b", "cab", "dd", "e"]) for _ in range(n)] for m, n in (("a", 120), ("b", 60), ("c", 3))}
    asked = {"a": heard["a"][70:95], "b": [rng.choice(["ab", "cab", "e"]) for _ in range(6)], "c": ["ab", "b", "dd", "e", "ab", "b"]}
    words = spark.createDataFrame([(m, i, float(i), t) for m, ts in heard.items() for i, t in enumerate(ts)], "media string, pos int, start double, token string")
    anchors = spark.createDataFrame([(m, 1, " ".join(ts), 0.0, 200.0, len(ts)) for m, ts in asked.items()], "media string, cue int, text string, low double, high double, n_words int")
    got = {r.media: (r.score, r.fidelity, r.heard_at) for r in A.best_window(anchors, words, ["media"], "cue").collect()}
    for m, ts in asked.items():
        text, best = " ".join(ts), (-1.0, None, None)
        for n in sorted({max(1, min(len(heard[m]), len(ts) + k)) for k in (-1, 0, 1)}):
            for i in range(len(heard[m]) - n + 1):
                said = " ".join(heard[m][i : i + n])
                if ratio(text, said) > best[0]:
                    best = (ratio(text, said), ratio(" ".join(sorted(ts)), " ".join(sorted(said.split()))) / 100, float(i))
        assert got[m] == pytest.approx(best)
    assert got["a"] == (100.0, 1.0, 70.0)
