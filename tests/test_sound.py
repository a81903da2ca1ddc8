"""Spans of sliced sound against slices of whole arrays, and models as table functions."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import models as P
from loomspan.operators import signals as G
from loomspan.sources import sound as K


def wave(rng, n):
    return [rng.uniform(-1, 1) for _ in range(n)]


def test_spans_equal_slices_of_the_whole(spark):
    rng = random.Random(6)
    whole = {f"m{i}": wave(rng, n) for i, n in enumerate([0, 1, 16, 17, 100, 1000])}
    slices = K.sliced(spark.createDataFrame(list(whole.items()), "media string, samples array<double>"), 16)
    assert all(len(r.samples) <= 16 for r in slices.collect())
    spans = [(i, m, a, a + rng.choice([0, 1, 15, 16, 17, 64, 500])) for i, (m, a) in enumerate((m, a) for m in [*whole, "none"] for a in [0, 1, 15, 16, 17, 32, 90, 984, 999, 1000, 5000])]
    spans += [(10000, "m4", None, 5), (10001, "m4", 5, None), (10002, None, 0, 5), (10003, "m4", 9, 3)]
    got = {r.id: r.samples for r in K.read(slices, spark.createDataFrame(spans, "id int, media string, first long, last long"), "id", 16).collect()}
    for i, m, a, b in spans:
        assert got[i] == (None if a is None or b is None else whole.get(m, [])[a:b]), (m, a, b)
    assert len(got) == len(spans)


def test_a_missing_slice_ends_a_span(spark):
    slices = spark.createDataFrame([("m", 0, [0.0, 1.0]), ("m", 2, [4.0, 5.0])], "media string, slice long, samples array<double>")
    spans = spark.createDataFrame([(1, "m", 1, 6), (2, "m", 2, 6), (3, "m", 4, 9)], "id int, media string, first long, last long")
    assert {r.id: r.samples for r in K.read(slices, spans, "id", 2).collect()} == {1: [1.0], 2: [], 3: [4.0, 5.0]}


def test_edges_of_sliced_sound_are_those_of_whole_sound(spark):
    rng = random.Random(2)
    rate, rows, spans = 200, [], []
    for m in range(6):
        samples = [x * (0.01 if 90 < i % 300 < 120 else 1) for i, x in enumerate(wave(rng, 2000))]
        rows.append((m, samples))
        spans += [(m * 10 + k, m, 0.4 + 1.7 * k, 0.4 + 1.7 * k + 0.5) for k in range(5)]
    whole = spark.createDataFrame(rows, "media int, samples array<double>")
    asked = spark.createDataFrame(spans, "id int, media int, start double, end double")
    want = G.refine_edges(asked.join(whole, "media").withColumn("origin", F.lit(0.0)), ["media"], rate, F.lit(10.0), 0.2)
    got = K.refined(K.sliced(whole, 64), asked, "id", 64, rate, F.lit(10.0), 0.2)
    key = lambda df: sorted((r.media, round(r.start, 6), round(r.end, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_two_sliced_streams_are_compared(spark):
    rng = random.Random(3)
    a = wave(rng, 4000)
    late = [0.0, 0.0, 0.0, *a]
    table = lambda x: K.sliced(spark.createDataFrame([("m", x)], "media string, samples array<double>"), 100)
    spans = spark.createDataFrame([(i, "m", 2.0 + i, 2.5 + i) for i in range(5)], "id int, media string, start double, end double")
    row = K.compared(table(a), table(late), spans, "id", 100, 400, 8).first()
    assert row.same and row.compared == 5 and row.lag == 3 / 400
    other = K.compared(table(a), table(wave(rng, 4000)), spans, "id", 100, 400, 8).first()
    assert not other.same


def counting(folder):
    """A factory of a model that says the letters of a text, and writes down what it was asked."""

    def model(texts):
        with open(f"{folder}/{os.getpid()}", "a") as file:
            file.write(",".join(t or "-" for t in texts) + "\n")
        return [[(c, len(t)) for c in t] for t in texts]

    return lambda: model


def asked(folder):
    return [line.strip().split(",") for name in os.listdir(folder) for line in open(f"{folder}/{name}")]


def test_models_see_full_batches_once(spark, tmp_path):
    folder = str(tmp_path / "asked")
    os.mkdir(folder)
    texts = [f"t{i % 23}" for i in range(100)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, k, c, len(t)) for i, t in enumerate(texts) for k, c in enumerate(t or ""))
    for parts in (1, 7):
        out = P.apply_model(rows.repartition(parts), "id", "text", counting(folder), "letter string, n int", 8)
        assert sorted(tuple(r) for r in out.collect()) == want
    one = [b for b in asked(folder) if len(b) == 8]
    assert len(one) >= 12
    memo, fresh = str(tmp_path / "memo"), str(tmp_path / "fresh")
    os.mkdir(fresh)
    for part in (rows.where("id < 50"), rows, rows.repartition(5)):
        out = P.remembered(part, "id", "text", counting(fresh), "letter string, n int", memo, 8)
        ids = {r.id for r in part.collect()}
        assert sorted((r.id, r.place, r.letter, r.n) for r in out.collect()) == [w for w in want if w[0] in ids]
    seen = [t for b in asked(fresh) for t in b]
    assert sorted(seen) == sorted({t or "-" for t in texts if t is not None})  # each distinct input once, the empty one too


def test_a_detector_gives_several_rows_a_clip(spark):
    clip = [0.0] * 8 + [1.0] * 8 + [0.1] * 8 + [0.9] * 3
    rows = spark.createDataFrame([(1, clip), (2, []), (3, [0.0] * 9)], "id int, samples array<double>")
    out = P.apply_model(rows, "id", "samples", P.LoudParts, "first int, last int")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 8, 16), (1, 1, 24, 27)]
    assert np.allclose(P.LoudParts()([clip])[0], [(8, 16), (24, 27)])
