import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.PieceModel.load(PATH)

ODD = ["", " ", "   ", "a", " a", "a ", "\n", "\n\n a", "▁", "▁▁x", "a▁b", "<s>", "<0x41>", "</s> <unk>", "\t\t", "é", "日本語", "👍🏽 ok", "é", "\x00", " ", "a" * 3000, "ab" * 700, " " * 1000, "hello  world   again    !", "▁ ▁", "\r\nx"]


def same(text: str) -> None:
    ids = MODEL.ids(text).tolist()
    assert ids == LIBRARY.encode(text)
    import pyarrow as pa

    assert MODEL.texts(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(ids)]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thernond aeisé\n.,", max_size=80))
def test_likely_text(text):
    same(text)


def test_arbitrary_ids_decode_alike():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(0, 8))]
        assert MODEL.texts(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(ids)], ids


def test_frames(spark):
    texts = [None, "", "One two  three", "x" * 5000, "One two  three"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = pieces.digests(pieces.decode(pieces.encode(docs, MODEL), MODEL)).collect()
    for r in out:
        ids = LIBRARY.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == LIBRARY.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
