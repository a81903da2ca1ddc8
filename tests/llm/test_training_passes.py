"""What a task of training has to do: its own trainers only, and each word's subwords once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from loomspan.llm import language_model
from loomspan.llm.language_model import LanguageModelOptions, Looked, Subwords, Words, gather, train
from loomspan.session import durable

PROTO = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def counted(monkeypatch):
    seen = []
    of = Subwords.of
    monkeypatch.setattr(Subwords, "of", lambda self, data, first, end: (seen.append(len(first)), of(self, data, first, end))[1])
    return seen


def test_marked_words_only_are_looked_up_and_each_once(monkeypatch):
    made, subwords, rng = counted(monkeypatch), Subwords(PROTO), np.random.default_rng(3)
    looked = Looked(None, subwords)
    columns = [Words.of(pa.array([" ".join(f"word{int(x)}" for x in rng.integers(0, 60, 40)) for _ in range(3)])) for _ in range(8)]
    for w in columns:
        wanted = rng.random(len(w.first)) < 0.5
        got, want = looked.tokens(w, wanted), w.tokens(Subwords(PROTO), np.flatnonzero(np.append(wanted, True)))
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert sum(made[::2]) <= 60 < sum(made[1::2])


def test_each_trainer_has_a_file_of_its_own(spark, monkeypatch):
    """Tasks that held several trainers made a round as long as they."""
    dealt = []
    monkeypatch.setattr(language_model, "durable", lambda df, name="table", *more: (dealt.append(durable(df, name, *more)) or dealt[-1]) if name == "dealt" else durable(df, name, *more))
    monkeypatch.setattr(language_model, "discard", lambda *tables: None)
    docs = spark.createDataFrame([(i, " ".join(f"word{i * j % 97}" for j in range(400))) for i in range(300)], "doc_id long, text string").repartition(4)
    o = LanguageModelOptions(trainer=500, rounds=1, steps=1, chunk=1 << 14)
    train(docs, F.lit(True), PROTO, o)
    held = dealt[0].groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(held) == dealt[0].count() > 8 and {r.n for r in held} == {1}
    many = gather(docs, F.lit(True), PROTO, o).selectExpr("sum(length(windows))").first()[0] // 50
    assert dealt[0].agg(F.sum("n")).first()[0] == many
