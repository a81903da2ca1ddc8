import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from loomspan.llm import attention
from loomspan.llm.language_model import LanguageModelOptions, Looked, Subwords, Words, deal, gather, number_type, score, train
from loomspan.llm.queries import op1_lm_scoring
from loomspan.llm.toxicity import crc_part

PROTO = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + ["\n"]


def check_base(docs, out, held):
    counts = Counter(w for i, t in docs if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((repr(i), len(words(t)), sum(w in counts for w in words(t)), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t))) for i, t in docs)
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in out)
    for a, b in zip(want, got, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, abs(a[3]))
    assert {r.train_tokens for r in out} == {total}


def log_sum(x):
    return x.max() + np.log(np.exp(x - x.max()).sum())


def test_gradient():
    shape = attention.Shape(4, 4, 4, 5, 6, 4)
    flat, rng = attention.initial(shape).astype(np.float64), np.random.default_rng(0)
    inputs, targets = rng.integers(0, 17, (3, 6)), rng.integers(0, 16, (3, 6))
    targets[0, 4:] = -1
    _, g = attention.gradient(flat, shape, inputs, targets)
    for k in rng.choice(len(flat), 40):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        near = (attention.gradient(up, shape, inputs, targets)[0] - attention.gradient(down, shape, inputs, targets)[0]) / 2e-5
        assert abs(near - g[k]) < 1e-5


def test_windows_score_each_token_once_with_its_own_context():
    shape = attention.Shape(4, 4, 8, 8, 7, 4)
    rng = np.random.default_rng(1)
    flat = attention.initial(shape) + rng.normal(size=len(attention.initial(shape))).astype(np.float32) * np.float32(0.3)
    scorer = attention.Scorer(flat, shape)
    lengths = [0, 1, 3, 4, 5, 11, 30]
    places = np.cumsum([0, *lengths])
    units = rng.integers(0, 16, places[-1])
    got = scorer.score(units, places, batch=3)
    p = attention.split(flat, shape)
    for low, high in zip(places[:-1], places[1:], strict=True):
        own = np.concatenate([[shape.units], units[low:high]])
        for i in range(high - low):
            first = max(0, i // 4 * 4 - 3)
            x = p["embed"][own[first : i + 1]]
            q, k, v, o = (np.append(x, np.ones((len(x), 1)), 1) @ p["linear"][:, c] for c in shape.cuts())
            logits = k @ q[-1] * shape.width**-0.5 + p["distance"][np.arange(len(x))[::-1]]
            a = np.exp(logits - logits.max())
            h = np.append(np.tanh(o[-1] + a / a.sum() @ v), 1)
            t = own[i + 1]
            one, two = h @ p["group"], h @ p["member"][t // 4]
            assert abs(one[t // 4] - log_sum(one) + two[t % 4] - log_sum(two) - got[low + i]) < 1e-4


def test_defined_results(spark):
    docs = [(1, None), (2, ""), (3, "The the  THE\nend"), (None, "x"), (3, "The the  THE\nend"), (5, "a" * 20000), (6, "é ü " * 3000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, row int")
    o = LanguageModelOptions(steps=5, rounds=1, frequent=2)
    model, counts = train(df, crc_part(7) != 2, PROTO, o)
    out = score(df, model, counts, PROTO).collect()
    check_base(docs, out, lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2)
    assert all(r.score < 0 for r in out)
    assert score(df.limit(0), model, counts, PROTO).count() == 0
    model, counts = train(df.limit(0), crc_part(7) != 2, PROTO, o)
    assert score(df, model, counts, PROTO).count() == 7


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = op1_lm_scoring(spark, folder).collect()
    check_base(docs, out, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in out)


def test_windows_hold_every_training_token_once(spark):
    docs = [(1, None), (2, "The the  THE\nend"), (3, " ".join(f"word{i % 97} of{i}" for i in range(3000))), (4, "one two " * 12), (5, "é ü " * 300)]
    o = LanguageModelOptions()
    got = gather(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.lit(True), PROTO, o).collect()
    library = Subwords(PROTO).library
    size = o.shape.window
    want, counts = Counter(), Counter()
    for _, t in docs:
        ids = [i for w in words(t)[:-1] for i in library.encode([w])[0]] + [2]
        counts.update(ids)
        want.update(tuple([ids[a - 1] if a else -1] + (ids[a : a + size] + [-2] * size)[:size]) for a in range(0, len(ids), size))
    kind = number_type(library.get_piece_size())
    rows = [row for r in got if r.windows is not None for row in np.frombuffer(r.windows, kind).reshape(-1, size + 1).tolist()]
    assert Counter(map(tuple, rows)) == want
    seen = Counter()
    for r in got:
        if r.t is not None:
            seen[r.t] += r.n
    assert seen == counts


def test_scores_against_a_plain_version(spark):
    """score of whole texts, rare and unseen words included, token by token from the model's parameters."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{int(x)}" if x < 60 else f"rare{i}x{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)))) for i in range(60)] + [(60, None), (61, "unseen é\u2003words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    shape = attention.Shape(4, 8, 8, 8, 10, 6)
    o = LanguageModelOptions(shape=shape, steps=20, rounds=2, batch=16, frequent=10)
    model, counts = train(df, crc_part(7) != 2, PROTO, o)
    out = {r.doc_id: r.score for r in score(df, model, counts, PROTO).collect()}
    p, library = attention.split(model.flat.astype(float), shape), Subwords(PROTO).library
    q, k, v, own = shape.cuts()
    for i, t in docs:
        ids = [x for word in words(t)[:-1] for x in library.encode([word])[0]] + [2]
        units = [shape.units, *model.unit[ids].tolist()]
        total = 0.0
        for at in range(len(ids)):
            first = max(0, at // 6 * 6 - 4)
            x = p["embed"][units[first : at + 1]] @ p["linear"][:-1] + p["linear"][-1]
            a = np.exp(x[:, k] @ x[-1, q] * shape.width**-0.5 + p["distance"][: len(x)][::-1])
            h = np.append(np.tanh(x[-1, own] + a / a.sum() @ x[:, v]), 1)
            one = np.exp(h @ p["group"])
            two = np.exp(np.einsum("h,ghm->gm", h, p["member"]))
            every = (one / one.sum())[:, None] * two / two.sum(1, keepdims=True)
            assert abs(every.sum() - 1) < 1e-9
            alike = (model.unit == units[at + 1]).sum() if units[at + 1] == shape.units - 1 else 1
            total += math.log10(every.reshape(-1)[units[at + 1]] / alike)
        assert abs(total - out[i]) < 1e-3 * max(1, abs(total))


def test_remembered_words_have_the_same_subwords():
    import pyarrow as pa

    subwords = Subwords(PROTO)
    looked = Looked(None, subwords, most=40)
    rng = np.random.default_rng(3)
    for _ in range(12):
        w = Words.of(pa.array([" ".join(f"word{int(x)} né{int(x) % 7}" for x in rng.integers(0, 60, rng.integers(0, 20))) for _ in range(3)]))
        for got, want in zip(looked.tokens(w), w.tokens(subwords, np.arange(len(w.first))), strict=True):
            assert got.tolist() == want.tolist()


def test_copies_spread_over_trainers(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text if i % 2 else None) for i in range(2000)], "doc_id long, text string").repartition(3)
    o = LanguageModelOptions(chunk=4096)
    windows = gather(docs, F.lit(True), PROTO, o).where("windows is not null")
    kind = number_type(Subwords(PROTO).library.get_piece_size())
    held = [r.n for r in deal(windows, 8, o.shape, kind).select("n").collect()]
    assert len(held) == 8 and sum(held) == windows.selectExpr('sum(length(windows))').first()[0] // 50 and max(held) < 1.5 * sum(held) / 8
