import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import text as T
from loomspan.llm import toxicity
from loomspan.llm.queries import op5_toxicity

CLEAN = "the river runs past old houses and green fields under a calm sky while people walk home".split()


def corpus(n=600):
    rng = random.Random(4)
    docs = []
    for i in range(n):
        toxic = i % 5 == 0
        sentences = [" ".join(rng.choice(CLEAN) for _ in range(6)) for _ in range(8)]
        if toxic:
            sentences[rng.randrange(8)] = f"you are a vileword{rng.randrange(50)} person"
        docs.append((i, ". ".join(sentences) + ".", int(toxic)))
    return docs


def test_held_out_accuracy_and_place(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in docs], "doc_id long, toxic int, text int")
    options = toxicity.ToxicityOptions(bits=16)
    model = toxicity.train(d, labels, toxicity.crc_part(4) != 2, options)
    out = {r.doc_id: r for r in toxicity.score(d, model, options).collect()}
    for i, text, y in docs:
        assert (out[i].score >= 0.3) == (y == 1)
        if y:
            assert ["vileword" in text[s.first : s.end] for s in out[i].offending] == [True]
        else:
            assert not out[i].offending


def test_defined_results(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, " . \n"), (None, "a b"), (4, "é" * 50000), (4, "é" * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, toxicity.crc_part(4) < 4)
    out = toxicity.score(d, model).collect()
    assert len(out) == 6 and all(r.score == 0 for r in out)
    assert toxicity.score(d.limit(0), model).count() == 0


def test_query(spark):
    rows = op5_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_scores_against_a_plain_version(spark):
    """Noisy-or over sentences, from the model's weights, word by word."""
    docs = [(i, t) for i, t, _ in corpus(60)] + [(1000, None), (1001, "vileword3"), (1002, "A vileword7!Person\nyou, are? the river" * 50), (1003, "é…vileword9 ü")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(60)], "doc_id long, toxic int")
    o = toxicity.ToxicityOptions(bits=14, least=2, lift=1.0)
    model = toxicity.train(d, labels, F.lit(True), o)
    assert (model.weights != 0).any()
    got = {r.doc_id: r for r in toxicity.score(d, model, o).collect()}
    breaks = set(b"\t\n\x0b\x0c\r") | set(range(0x20, 0x30)) | set(range(0x3A, 0x41)) | set(range(0x5B, 0x61)) | set(range(0x7B, 0x80))
    shift, mask = 64 - o.bits, (1 << 64) - 1

    def hashed(raw, extra):
        total = sum(int(toxicity._TABLE[c]) * int(T.powers(64)[k]) for k, c in enumerate(raw)) + extra & mask
        return int(T.mix(np.array([total & mask], np.uint64))[0]) >> shift

    for i, text in docs:
        raw, clean, spans, sentence = (text or "").encode(), 1.0, [], 0.0
        at, place, open_ = 0, 0, None
        while at <= len(raw):
            c = raw[at] if at < len(raw) else None
            if c is None or c in b"\n\r!.?":
                if open_ is not None:
                    p = 1 / (1 + math.exp(-(model.bias + sentence)))
                    clean *= 1 - p
                    if p >= o.offending:
                        spans.append((len(raw[: open_[0]].decode()), len(raw[: open_[1]].decode())))
                sentence, open_, at = 0.0, None, at + 1
                continue
            if c in breaks:
                at += 1
                continue
            place = at
            while at < len(raw) and raw[at] not in breaks:
                at += 1
            word = raw[place:at]
            sentence += model.weights[hashed(word, len(word))] + sum(model.weights[hashed(word[:n], n << 32)] if len(word) > n else model.weights[0] for n in o.beginnings)
            open_ = (open_[0] if open_ else place, at)
        assert abs(got[i].score - (1 - clean)) < 1e-6
        assert [(s.first, s.end) for s in got[i].offending] == spans


def test_gradient_of_the_noisy_or():
    """The weights that the fit finds are a minimum of the likelihood, written plainly."""
    rng = np.random.default_rng(1)
    labels, docs, sentences = [], [], []
    for _ in range(80):
        n = int(rng.integers(1, 5))
        rows = np.array([(s, f) for s in range(n) for f in range(3) if rng.random() < 0.3], np.int64).reshape(-1, 2)
        labels.append(int((rows[:, 1] == 1).any()) if rng.random() < 0.9 else int(rng.random() < 0.5))
        docs.append(rows)
        sentences.append(n)
    o = toxicity.ToxicityOptions(bits=4, steps=3000, rate=0.02, shrink=1e-2)
    model = toxicity.fit(np.array(labels), docs, np.array(sentences), np.arange(3), o)

    def loss(w, b):
        total = 0.0
        for y, rows, n in zip(labels, docs, sentences, strict=True):
            clean = np.prod([1 / (1 + math.exp(b + sum(w[f] for s, f in rows if s == k))) for k in range(n)])
            total -= math.log(1 - clean if y else clean)
        return total / len(labels) + o.shrink / 2 * float(np.square(w).sum())

    w, b = model.weights[:3].astype(float), model.bias
    best = loss(w, b)
    for k in range(3):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, b) > best - 1e-6
    assert loss(w, b + 0.05) > best - 1e-6 and loss(w, b - 0.05) > best - 1e-6


def test_clashing_columns_repeated_ids_and_no_labels(spark):
    rows = [(1, "a vileword b", 5.0, "x"), (1, "calm river", 6.0, "y"), (2, "a vileword c", 7.0, None), (3, "calm green", 8.0, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _score double, offending string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    o = toxicity.ToxicityOptions(bits=12, least=1, lift=0.1)
    model = toxicity.train(d, labels, F.lit(True), o)
    out = toxicity.with_score(d, model, o)
    assert out.columns == ["doc_id", "text", "offending", "_score", "_offending"] and out.count() == 4
    assert all(0 <= r._score <= 1 for r in out.collect())
    none = toxicity.train(d, labels.limit(0), F.lit(True), o)
    assert {r.score for r in toxicity.score(d, none, o).collect()} == {0.0}
    small = toxicity.train(d, labels, F.lit(True), toxicity.ToxicityOptions(bits=12, least=1, lift=0.1, sample_bytes=5))
    assert {r.score for r in toxicity.score(d, small, o).collect()} == {0.0}
