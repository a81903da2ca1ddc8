"""Joins of spans of all lengths, and sequence operators that cut a timeline into buckets, against plain Python and the one-window form."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import spans as S

SCHEMA = "media long, id int, start double, end double, text string"


def rows_of(rng, n=300, null=True):
    out = []
    for i in range(n):
        start = round(rng.uniform(-50, 400) * 4) / 4
        length = rng.choice([0, 0.25, 1, 1, 3, 20, 500, 40000])
        out.append((rng.choice([1, 1, 1, 2, *([None] if null else [])]), i, start, start + length, rng.choice("aab")))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("size, base", [(1, 4), (0.5, 2), (60, 10)])
def test_overlaps_of_spans_of_all_lengths(spark, closed, size, base):
    rng = random.Random(size)
    a, b = rows_of(rng, 150), rows_of(rng, 150)
    meets = (lambda p, q: p[2] <= q[3] and q[2] <= p[3]) if closed else (lambda p, q: p[2] < q[3] and q[2] < p[3])
    want = sorted(((p[1], q[1]) for p in a for q in b if p[0] is not None and p[0] == q[0] and meets(p, q)), key=repr)
    right = table(spark, b).select("media", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = S.overlap_join(table(spark, a).select("media", "id", "start", "end"), right, ["media"], size, closed, base=base)
    assert got(pairs, "id", "r_id") == want


def test_a_year_beside_seconds_costs_two_rows_a_level(spark):
    short = [(1, i, float(i * 40), float(i * 40 + 2), "a") for i in range(2000)]
    long = [(1, -1, 0.0, 365 * 86400.0, "a")]
    right = table(spark, short).select("media", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    left = table(spark, short + long).select("media", "id", "start", "end")
    assert S.overlap_join(left, right, ["media"], 4).count() == 2000 + 2000
    year = 12  # 4 * 4 ** 12 seconds is the first width that holds one
    both, seconds = F.array(F.lit(0), F.lit(year)), F.array(F.lit(0))
    assert S.dealt(left.where("id = -1"), "start", "end", 4, 4, 1, seconds, 1).count() <= 2
    assert S.dealt(right, "r_start", "r_end", 4, 4, 2, both, 0).count() <= 2000 * 3 * 2


def test_no_side_no_pairs(spark):
    none = table(spark, []).select("media", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    some = table(spark, [(1, 1, 0.0, 5.0, "a"), (1, 2, None, 5.0, "a")]).select("media", "id", "start", "end")
    assert S.overlap_join(some, none, ["media"], 1).count() == 0
    assert S.overlap_join(some.limit(0), none, ["media"], 1).count() == 0


@pytest.mark.parametrize("seed, bucket", [(1, 7), (2, 0.5), (3, 1000)])
def test_buckets_change_nothing(spark, seed, bucket):
    rng = random.Random(seed)
    rows = rows_of(rng) + [(3, 1000, None, 4.0, "a"), (3, 1001, 2.0, 3.0, None), (3, 1002, 5.0, 6.0, None)]
    df = table(spark, rows)
    for reach in ("max", "last"):
        for gap, closed in ((0, True), (0.5, False)):
            parts = [got(S.islands(df, ["media"], gap, closed, reach, tie=["id"], bucket=k), "id", "island") for k in (None, bucket)]
            assert parts[0] == parts[1]
            merged = [got(S.merge_spans(df, ["media"], gap, closed, reach, aggregates=[F.count(F.lit(1)).alias("n")], bucket=k), "media", "start", "end", "n") for k in (None, bucket)]
            if reach == "max":
                assert merged[0] == merged[1]
    said = [got(S.repeated(df, ["media"], "text", 1, tie=["id"], bucket=k), "media", "text", "start", "end", "n") for k in (None, bucket)]
    assert said[0] == said[1]
    reached = [got(S.running_reach(df, ["media"], ["id"], bucket=k), "id", "reach", "number") for k in (None, bucket)]
    assert reached[0] == reached[1]
    marks = table(spark, rows_of(rng, 100))
    ahead = [got(S.next_start(df.select("media", "id", "end"), marks.select("media", "start"), ["media"], "end", "start", "next", bucket=k), "id", "next") for k in (None, bucket)]
    assert ahead[0] == ahead[1]
    cover = table(spark, [r for r in rows_of(rng, 60) if r[3] - r[2] < 50])
    free = [got(S.difference(df.where("start is not null"), cover, ["media"], "id", 0.5, 10, bucket=k), "media", "id", "start", "end") for k in (None, bucket)]
    assert free[0] == free[1]
    assert [S.islands(df.limit(0), ["media"], bucket=k).count() for k in (None, bucket)] == [0, 0]


def test_what_is_left_of_regions(spark):
    """Against a walk in plain Python."""
    rng = random.Random(9)
    regions = rows_of(rng, 80, null=False)
    cover = [r for r in rows_of(rng, 60, null=False) if r[3] - r[2] < 50 and r[0] == 1]
    want = []
    for media, i, start, end, _ in regions:
        at = start
        for _, _, a, b, _ in sorted((c for c in cover if c[0] == media and c[2] < end and c[3] > start), key=lambda c: c[2]):
            if a > at:
                want.append((i, at, min(a, end)))
            at = max(at, b)
        if at < end:
            want.append((i, at, end))
    # a cover without length parts a region in two
    points = {c[2] for c in cover if c[2] == c[3]}
    parted = []
    for i, a, b in want:
        cuts = [a, *sorted(p for p in points if a < p < b and next(r[0] for r in regions if r[1] == i) == 1), b]
        parted += [(i, x, y) for x, y in zip(cuts, cuts[1:])]
    for bucket in (None, 9):
        assert got(S.difference(table(spark, regions), table(spark, cover), ["media"], "id", 0, 10, bucket=bucket), "id", "start", "end") == sorted(parted, key=repr)
