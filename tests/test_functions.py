"""Folding over all of Unicode, and likeness of samples, against plain Python."""

import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions import masking as W
from loomspan.functions import text as X
from loomspan.operators import matching as M
from loomspan.operators import signals as G


def test_folding_is_case_folding_for_every_character(spark):
    rows = [(c, f"a{chr(c)}b {chr(c)} x{chr(c)}") for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    straight = str.maketrans(X.QUOTES, X.STRAIGHT)
    want = {c: unicodedata.normalize("NFKC", t).translate(straight).casefold() for c, t in rows}
    got = spark.createDataFrame(rows, "c int, t string").select("c", X.fold(F.col("t"), compose=True).alias("f")).toPandas()
    bad = [(hex(c), f, want[c]) for c, f in zip(got.c, got.f, strict=True) if f != want[c]]
    assert not bad, (len(bad), bad[:20])


def test_terms_with_a_final_sigma_are_found(spark):
    lines = spark.createDataFrame([(1, "Ο ΛΌΓΟΣ λόγος λόγοσ Straße STRASSE")], "id long, text string")
    found = M.match(lines, "id", [M.Term("λόγος", "greek"), M.Term("straße", "german")]).collect()
    assert sorted(r["first"] for r in found) == [1, 2, 3, 4, 5]


def plain_likeness(x, y, most):
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    if not norm:
        return {0: 0.0}
    return {k: abs(sum(x[i] * y[i + k] for i in range(n) if 0 <= i + k < n)) / norm for k in [*range(most + 1), *range(-most, 0)]}


def test_likeness_is_the_largest_correlation_within_the_lag(spark):
    rng = random.Random(4)
    rows = [(0, [], [], 3), (1, None, [1.0], 3), (2, [0.0] * 5, [1.0] * 5, 2), (3, [1.0], [1.0], 9), (4, [1.0, 0.0], [1.0, 0.0], 0)]
    for i in range(5, 60):
        n = rng.choice([3, 10, 200, 700])
        x = [rng.gauss(0, 1) for _ in range(n)]
        k = rng.randint(-8, 8)
        rows.append((i, x, [x[(j - k) % n] * -2 + rng.gauss(0, 0.1) for j in range(n + rng.randint(0, 5))], rng.choice([0, 4, 10])))
    got = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, k int").select("i", G.likeness("a", "b", "k").alias("l")).collect()
    for r in got:
        _, a, b, k = rows[r.i]
        if a is None:
            assert r.l.score is None and r.l.lag is None
            continue
        want = plain_likeness(a, b, k)
        assert np.isclose(r.l.score, max(want.values())) and np.isclose(want[r.l.lag], max(want.values()))


def test_word_spans_are_where_words_stand(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "é", "😀", " ", "\t", "-", "-", ".", ".", "…", "—", "\n", "'"], k=rng.randint(0, 14))) for _ in range(600)] + ["a--b", "...", "a.b..c...d", "-a-", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.word_spans(F.col("t")).alias("s"), X.split_words(F.col("t")).alias("w"))
    divider = re.compile(r"--+|\.\.\.+|[—–…]")
    for r in df.collect():
        plain = divider.sub(lambda m: " " * len(m[0]), r.t)
        assert [(s["first"], s["last"]) for s in r.s] == [m.span() for m in re.finditer(r"\S+", plain)], r.t
        assert [r.t[s["first"] : s["last"]] for s in r.s] == r.w, r.t


def plain_mask(text, spans, mode):
    """Character by character, with markup and breaks set apart first."""
    units = re.findall(r"(?s)((?:\{[^{}]*\}|</?[a-zA-Z][^<>]*>|<\d[\d:.]*>)*)(\\[Nnh]|.|\Z)", text)
    seen = [c for _, c in units if c]
    new = list(seen)
    for a, b in spans:
        b = min(b, len(seen))
        if mode == "remove":
            for k in range(a, b):
                new[k] = seen[k] if seen[k] in ("\r", "\n") or len(seen[k]) == 2 else ""
            before, after = seen[a - 1] if a else "", seen[b] if b < len(seen) else ""
            if after == " " and (not before or before.isspace() or len(before) == 2):
                new[b] = ""
            elif before == " " and not after.isalnum():
                new[a - 1] = ""
        else:
            inside = False
            for k in range(a, b):
                letter = len(seen[k]) == 1 and seen[k].isalnum()
                if letter and (inside or mode == "asterisks"):
                    new[k] = "*"
                inside = (inside or letter) and not (seen[k].isspace() or len(seen[k]) == 2)
    at = iter(new)
    return "".join(mark + (next(at) if c else "") for mark, c in units)


def test_masking_is_that_of_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        text = "".join(rng.choices(["a", "b", "1", "é", "😀", " ", " ", "!", "'", "<i>", "</i>", "{\\b1}", "\\N", "\n", "{", "<"], k=rng.randint(0, 16)))
        size = len(re.sub(r"\{[^{}]*\}|</?[a-zA-Z][^<>]*>|<\d[\d:.]*>", "", text).replace("\\N", " "))
        cuts = sorted(rng.sample(range(size + 1), min(size + 1, 2 * rng.randint(0, 2))))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
        if any(b + 1 >= c for (_, b), (c, _) in zip(spans, spans[1:])):
            spans = spans[:1]  # spans that share a space are taken one by one elsewhere
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<first:int,last:int>>")
    for mode in ("asterisks", "first_letter", "remove"):
        got = {r.i: r.m for r in df.select("i", W.mask_text(F.col("t"), F.col("s"), mode).alias("m")).collect()}
        bad = [(t, s, got[i], plain_mask(t, s, mode)) for i, t, s in rows if got[i] != plain_mask(t, s, mode)]
        assert not bad, (mode, bad[:5])
