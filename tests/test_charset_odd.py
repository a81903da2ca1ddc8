"""Texts whose bytes other encodings could explain: few words of letters above 0x7F, UTF-16 of few different characters, marks and controls."""

import pytest

from loomspan.functions.charset import detect
from loomspan.more_queries import src_subs_decode

PLAIN = "Of thedndtion ingingha ertion it that thenin edouin than onorat anth, onerth. " * 4
FEW = ["Äü", "Äü.", "äüß", "Ñá", "ñáñá", "ÓÚ", "Éú.", "éçèé", "áá"]
#: other pages explain these better
MIXED = ["réévi cióndoíí. enerüver. Chözu enieükeit éonauxvi"]
SIXTEEN = ["a" * 40, "=-" * 20, " " * 40, "ab" * 20, "Ñ" * 40, "Приветмирэтословобезпробелов", "สวัสดีชาวโลกนี่คือประโยคยาวไม่มีช่องว่าง", "ab\0cd" * 8, "\x01\x02 with controls " * 3]


@pytest.mark.parametrize("words", FEW + MIXED)
def test_few_words_of_high_letters(words):
    data = f"{PLAIN}{words} {PLAIN}".encode("latin-1")
    assert data.decode(detect(data)) == data.decode("latin-1"), detect(data)


@pytest.mark.parametrize("word", ["geü", "öerzu", "Öß.", "È", "enüstbe", "geteü"])
def test_one_word_again_and_again_is_no_sixteen(word):
    """Words of an odd length have their spaces at every second byte."""
    for text in (f"{word} " * 80, PLAIN + f"{word} " * 80):
        assert text.encode("latin-1").decode(detect(text.encode("latin-1"))) == text, detect(text.encode("latin-1"))


@pytest.mark.parametrize("text", SIXTEEN)
def test_sixteen_of_few_characters(text):
    for name in ("utf-16-le", "utf-16-be"):
        assert text.encode(name).decode(detect(text.encode(name))) == text, name


def test_query(spark, tmp_path):
    texts = [f"{PLAIN}{w} {PLAIN}" for w in FEW] + ["geü " * 80, "È " * 120] + SIXTEEN + ["\ufeffa mark, and more than twenty characters", "", None, f"{PLAIN}Ã©tÃ©", "a" * 300]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(tuple(r) for r in src_subs_decode(spark, str(tmp_path)).collect())
    assert {i: t for i, t in rows if got[i] != t} == {} and len(got) == len(rows)
