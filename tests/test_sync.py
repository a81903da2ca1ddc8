"""Aligning clocks: tracking with a fitted model, decisions, and scores of candidates, against plain Python."""

import random
from statistics import median

from loomspan import more_queries  # noqa: F401  registers its queries
from loomspan.operators import media as D
from loomspan.operators import sync as A
from loomspan.queries import QUERIES

ANCHORS = "key long, cue int, start double, end double, radius double, duration double, scale double"
RUNS = "key long, cue int, at double, n_words int, score double, fidelity double"


def plain_fit(pairs, base):
    scales = [base]
    if len(pairs) >= 3 and max(p[0] for p in pairs) - min(p[0] for p in pairs) >= 60:
        scales += [r for r in A.RATIOS if r != base]
    found = None
    for scale in scales:
        gaps = [y - scale * x for x, y in pairs]
        error = median(abs(g - median(gaps)) for g in gaps)
        if found is None or error < found[2] - 0.05:
            found = (scale, median(gaps), error)
    return found


def plain_track(anchors, runs):
    out = {}
    for key in {a[0] for a in anchors}:
        pairs = []
        for _, cue, start, end, radius, duration, scale in sorted((a for a in anchors if a[0] == key), key=lambda a: (a[2], a[1])):
            by, offset, _ = plain_fit(pairs, scale) if pairs else (scale, 0.0, 0)
            low, high = max(0.0, by * start + offset - radius), by * end + offset + radius
            high = high if duration is None else min(high, duration)
            score, fidelity, at = 0.0, None, None
            inside = [] if high - low < 0.5 else [r for r in runs if r[:2] == (key, cue) and low <= r[2] <= high]
            if inside:
                _, _, heard, _, score, fidelity = min(inside, key=lambda r: (-r[4], r[3], r[2]))
                if score >= 75:
                    at = heard
                    pairs.append((start, at))
            out[key, cue] = (round(low, 6), round(max(low, high), 6), score, fidelity, at)
    return out


def test_anchors_are_followed_along_a_drifting_clock(spark):
    rng = random.Random(8)
    anchors, runs = [], []
    for key in range(60):
        scale, offset, base = rng.choice(A.RATIOS), rng.uniform(-12, 12), rng.choice([1.0, 1.0, 25 / 24])
        duration = rng.choice([None, 4000.0, 7000.0])
        for cue in range(rng.randint(1, 14)):
            start = float(rng.randrange(0, 7000))
            anchors.append((key, cue, start, start + rng.uniform(1, 4), rng.choice([5.0, 20.0]), duration, base))
            for _ in range(rng.randint(0, 6)):
                away = rng.choice([rng.gauss(0, 0.3), rng.uniform(-40, 40), 500.0])
                runs.append((key, cue, max(0.0, scale * start + offset + away), rng.randint(3, 5), rng.choice([60.0, 75.0, 80.0, 95.0]), rng.choice([None, 0.5, 1.0])))
    got = A.track(spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(runs, RUNS), "key").collect()
    assert {(r.key, r.cue): (round(r.low, 6), round(r.high, 6), r.score, r.fidelity, r.heard_at) for r in got} == plain_track(anchors, runs)
    assert len(got) == len(anchors)


def test_a_drift_that_leaves_the_window_of_an_offset_is_followed(spark):
    """At 4 % the place moves 2.4 s a minute: after some minutes an offset alone would look elsewhere."""
    anchors = [(1, i, 60.0 * i, 60.0 * i + 2, 8.0, None, 1.0) for i in range(100)]
    runs = [(1, i, 60.0 * i * 25 / 24 + 1, 4, 90.0, 1.0) for i in range(100)]
    heard = {r.cue: r.heard_at for r in A.track(spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(runs, RUNS), "key").collect()}
    assert all(heard.values()) and len(heard) == 100


def test_tracking_edge_cases(spark):
    none = A.track(spark.createDataFrame([], ANCHORS), spark.createDataFrame([], RUNS), "key")
    assert none.collect() == []
    rows = [(None, 1, 5.0, 6.0, 2.0, None, 1.0), (None, 1, 5.0, 6.0, 2.0, None, 1.0), (3, 1, None, 6.0, 2.0, None, 1.0), (4, 1, 100.0, 101.0, 2.0, 50.0, 1.0)]
    heard = [(None, 1, 6.5, 3, 90.0, None), (4, 1, 100.0, 3, 99.0, 1.0), (9, 9, 1.0, 3, 99.0, 1.0), (None, 1, 6.6, 3, None, None)]
    got = A.track(spark.createDataFrame(rows, ANCHORS), spark.createDataFrame(heard, RUNS), "key").collect()
    assert sorted(((r.key, r.score, r.heard_at) for r in got), key=repr) == [(4, 0.0, None), (None, 90.0, 6.5), (None, 90.0, 6.5)]


def test_searched_runs_are_tracked(spark):
    """Runs found in words, without the tokens that hold nothing, are what tracking takes."""
    said = "zero one two ' three four five six seven".split()
    words = spark.createDataFrame([("m", i, 10.0 + i, "" if w == "'" else w) for i, w in enumerate(said)], "key string, pos int, start double, token string")
    asked = spark.createDataFrame([("m", 1, "two three four", 0.0, 40.0, 3)], "key string, cue int, text string, low double, high double, n_words int")
    runs = A.scored_runs(asked, words, ["key"], "cue")
    best = {r.pos: (r.n_words, round(r.score)) for r in runs.collect()}
    assert best[2] == (3, 100) and set(best) == {0, 1, 2, 4, 5, 6, 7}  # nothing begins at the empty token, or has too few words after it
    anchor = spark.createDataFrame([("m", 1, 11.0, 13.0, 5.0, 60.0, 1.0)], ANCHORS.replace("key long", "key string"))
    assert A.track(anchor, runs, "key").first().heard_at == 12.0
    assert A.best_window(asked, words, ["key"], "cue").first().heard_at == 12.0


def test_decisions(spark):
    anchors = spark.createDataFrame([("good", i, 100.0 * i) for i in range(4)] + [("lost", i, 100.0 * i) for i in range(4)] + [("late", i, 100.0 * i) for i in range(4)] + [("loose", 0, 5.0), ("mute", 0, 5.0)], "key string, cue int, start double")
    found = [("good", i, 90.0, 0.9, 100.0 * i + 3) for i in range(4)] + [("lost", 0, 90.0, 0.9, 3.0)] + [("late", i, 90.0, 0.9, 100.0 * i + 9 * (i % 2)) for i in range(4)] + [("loose", 0, 80.0, 0.4, 5.0), ("mute", 0, 80.0, None, 5.0)]
    found = spark.createDataFrame(found, "key string, cue int, score double, fidelity double, heard_at double")
    every = spark.createDataFrame([(k,) for k in ("good", "lost", "late", "loose", "mute", "none")], "key string")
    got = {r.key: (r.tried, r.matched, r.problem) for r in A.check(anchors, found, ["key"], "cue", candidates=every).collect()}
    assert got == {"good": (4, 4, None), "lost": (4, 1, "unmatched"), "late": (4, 4, "error"), "loose": (1, 1, "fidelity"), "mute": (1, 1, "fidelity"), "none": (0, 0, "no-anchors")}


def test_scores_of_candidates(spark):
    rows = [("en", "eng", False, False), ("us", "en-US", False, False), ("deaf", "en", False, True), ("german", "ger", False, True), ("none", None, False, False), ("french", "fr", False, True), ("forced", "en", True, True), ("odd", "xx-YY", False, False)]
    df = spark.createDataFrame(rows, "label string, language string, forced boolean, hearing boolean")
    from pyspark.sql import functions as F

    score = lambda wanted, prefer: {r.label: r.s for r in df.select("label", D.candidate_score(F.col("language"), wanted, F.col("forced"), F.col("hearing"), prefer, F.lit(0)).alias("s")).collect()}
    assert score(["de", "en-GB"], True) == {"en": 90, "us": 90, "deaf": 110, "german": 120, "none": 50, "french": None, "forced": None, "odd": None}
    assert score(["en"], False) == {"en": 120, "us": 120, "deaf": 100, "german": None, "none": 70, "french": None, "forced": None, "odd": None}
    assert score(["xx"], False)["odd"] == 120


def test_registered_tracking_meets_all_cases(spark):
    found = QUERIES["plan_sync"](spark, "/root/testdata/sf0.001").collect()
    assert {r.problem for r in found} >= {None, "unmatched"} and len({r.scale for r in found}) > 3
