"""Toxicity by multiple-instance learning: sentences are scored, labels are known for documents only.

A sentence's probability is logistic in its hashed words and their beginnings; a document's is the noisy-or of its
sentences: 1 - product of (1 - p). The weights are fitted to document labels alone by maximum likelihood, so blame
settles on the sentences that tell toxic documents from others, and these are then located.

Inputs of a score are the words of the text and nothing else. A word is a run of bytes other than white space and ASCII
punctuation, with A-Z lower-cased; sentences end at . ! ? and line ends.

The fit uses a bounded sample of labelled documents: those with the smallest hash of doc_id, Options.sample of them and
Options.sample_bytes of text at most. A doc_id with several rows counts once, with the text whose hash is smallest. Where
the texts are, their features are counted; features that toxic documents of the sample hold markedly more often than their
share get weights. The driver gets these features and their places in the sample's documents, and no text.

Defined results: a text without words (null, empty) scores 0; documents with several labels count as the highest; null
labels are none; without labels of both kinds all scores are 0. Rows of equal doc_id are scored each for itself; texts of
any length are scored whole; an empty table gives an empty one. score reads doc_id and text only; with_score replaces
columns that are named _score or _offending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from loomspan.llm import text as T
from loomspan.session import durable


@dataclass(frozen=True)
class ToxicityOptions:
    sample: int = 20000  #: labelled documents that the fit uses at most
    sample_bytes: int = 64 << 20  #: bytes of their texts at most
    most_features: int = 1 << 16  #: features that get weights at most, those with the greatest lift
    bits: int = 20  #: features are hashed to 2 ** bits
    beginnings: tuple[int, ...] = (4, 5, 6)  #: bytes of a word's beginnings
    least: int = 4  #: documents that a feature must be in
    lift: float = 3.0  #: standard errors by which toxic documents must hold a feature more often than expected
    steps: int = 150
    rate: float = 0.1
    shrink: float = 1e-4
    offending: float = 0.3  #: probability from which a sentence is located
    predicted: float = 0.3  #: score from which a document is toxic


_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_TABLE = T.byte_table(_SPACE, 31)
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Sentences:
    """The features of a column's words, the sentence of each word, and each sentence's row and place."""

    features: list[np.ndarray]  #: the word, then its beginnings; 0 where a word is no longer than a beginning
    sentence: np.ndarray  #: number of the word's sentence, from 0, over all rows
    row: np.ndarray  #: row of each sentence
    first: np.ndarray  #: first byte of each sentence, and the one after its last word
    end: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, o: ToxicityOptions) -> Sentences:
        hashes, first, end, place = T.words(column, _TABLE, _SPACE)
        data, at = T.buffers(column)
        row = np.repeat(np.arange(len(place) - 1), np.diff(place))
        marks = np.append(0, np.cumsum(_END[data]))
        new = np.ones(len(hashes), bool)
        if len(hashes):
            new[1:] = (marks[first[1:]] > marks[first[:-1]]) | (row[1:] != row[:-1])
        sentence = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        shift = np.uint64(64 - o.bits)
        features = [(hashes >> shift).astype(np.int64)]
        for size in o.beginnings:
            longer = np.flatnonzero(end - first > size)
            begin = np.zeros(len(longer), np.uint64)
            for k, weight in enumerate(T.powers(size)[:size]):
                begin += _TABLE[data[first[longer] + k]] * weight
            feature = np.zeros(len(hashes), np.int64)
            feature[longer] = (T.mix(begin + np.uint64(size << 32)) >> shift).astype(np.int64)
            features.append(feature)
        last = np.append(starts[1:], len(hashes))[: len(starts)] - 1
        return cls(features, sentence, row[starts], first[starts], end[last])


@dataclass
class ToxicityModel:
    """weights: of each feature; most are 0."""

    weights: np.ndarray
    bias: float

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        """A repeated word adds as often as it stands there."""
        return self.bias + np.bincount(s.sentence, sum(self.weights[f] for f in s.features), minlength=len(s.row))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-softplus(-x))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def fit(labels: np.ndarray, docs: list[np.ndarray], sentences: np.ndarray, kept: np.ndarray, o: ToxicityOptions) -> ToxicityModel:
    """Fit weights of the kept features to document labels.

    docs: for each document the rows (sentence, feature) that hold a kept feature; sentences: how many it has.
    """
    weights = np.zeros(1 << o.bits, np.float32)
    if not len(kept) or labels.min() == labels.max():
        return ToxicityModel(weights, -np.inf)
    owner = np.repeat(np.arange(len(docs)), sentences)
    starts = np.cumsum(sentences) - sentences
    sentence = np.concatenate([d[:, 0] + low for d, low in zip(docs, starts, strict=True)])
    feature = np.searchsorted(kept, np.concatenate([d[:, 1] for d in docs]))
    y = labels.astype(np.float64)
    w, b = np.zeros(len(kept)), -4.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for step in range(1, o.steps + 1):
        z = b + np.bincount(sentence, w[feature], minlength=len(owner))
        p = sigmoid(z)
        q = -np.bincount(owner, softplus(z), minlength=len(y))  # log of the probability that no sentence is toxic
        away = np.exp(np.minimum(q, -1e-9))
        pull = np.where(y > 0, -away / (1 - away), 1.0)
        dz = pull[owner] * p
        g = np.bincount(feature, dz[sentence], minlength=len(kept)) / len(y) + o.shrink * w
        gb = dz.sum() / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= o.rate * (m / a) / (np.sqrt(v / c) + 1e-6)
        b -= o.rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    weights[kept] = w
    return ToxicityModel(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, usable: Column, options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """Fit a model to the labelled documents whose doc_id is usable. docs: doc_id, text; labels: doc_id, toxic."""
    o = options
    known = labels.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    sized = rows.select("doc_id", F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_bytes"))
    sized = sized.groupBy("doc_id").agg(F.min(F.struct("_h", "_bytes")).alias("_t")).select("doc_id", "_t.*")
    known = known.withColumn("doc_id", F.col("doc_id").cast("long")).join(sized, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.sample)
    # at most o.sample rows of numbers: one task adds up their sizes
    upto = F.sum("_bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    known = durable(known.withColumn("_upto", upto).where(F.col("_upto") <= o.sample_bytes).select("doc_id", "_h", "toxic"), "sample")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    if share in (0.0, 1.0):
        return fit(np.zeros(1), [], np.zeros(0, np.int64), np.zeros(0, np.int64), o)
    texts = rows.withColumn("_h", F.xxhash64("text")).join(F.broadcast(known), ["doc_id", "_h"]).select("doc_id", "text", "toxic")
    # equal rows of one doc_id
    texts = durable(texts.groupBy("doc_id", "toxic").agg(F.first("text").alias("text")), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = np.zeros(1 << o.bits, np.int64), np.zeros(1 << o.bits, np.int64)
        for batch in T.chunks(batches):
            s = Sentences.of(batch.column("text"), o)
            bad = batch.column("toxic").to_numpy()
            row = s.row[s.sentence]
            for f in s.features:
                pairs = np.unique(row << o.bits | f)
                f, r = pairs & ((1 << o.bits) - 1), pairs >> o.bits
                every += np.bincount(f, minlength=1 << o.bits)
                toxic += np.bincount(f[bad[r] > 0], minlength=1 << o.bits)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(toxic[at]), pa.array(every[at])], ["feature", "toxic", "every"])

    counts = texts.mapInArrow(count, "feature long, toxic long, every long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))
    more = (F.col("toxic") - F.col("every") * share) / F.sqrt(F.col("every") * share * (1 - share))
    marked = counts.where((F.col("every") >= o.least) & (more >= o.lift) & (F.col("feature") != 0)).select("feature", more.alias("more"))
    kept = np.sort(marked.orderBy(F.desc("more"), "feature").limit(o.most_features).toArrow().column(0).to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << o.bits, bool)
        wanted[shared.value] = True
        for batch in T.chunks(batches):
            s = Sentences.of(batch.column("text"), o)
            places = np.searchsorted(s.row, np.arange(batch.num_rows + 1))
            found = np.concatenate([s.sentence[wanted[f]] << o.bits | f[wanted[f]] for f in s.features])
            found.sort()
            cuts = np.searchsorted(found >> o.bits, places)
            found -= np.repeat(places[:-1], np.diff(cuts)) << o.bits
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(np.diff(places)), lists], ["doc_id", "toxic", "sentences", "features"])

    got = texts.mapInArrow(place, "doc_id long, toxic int, sentences long, features array<long>").toArrow().combine_chunks()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    lists = got.column("features").combine_chunks()
    places, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = [flat[places[i] : places[i + 1]] for i in order.tolist()]
    found = [np.stack([f >> o.bits, f & ((1 << o.bits) - 1)], 1) for f in found]
    return fit(got.column("toxic").to_numpy()[order], found, got.column("sentences").to_numpy()[order], kept, o)


def score(docs: DataFrame, model: ToxicityModel, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """(doc_id, score, offending) of each row: offending lists the sentences of a probability of options.offending or more.

    Their first and end count characters of the text from 0; end is after the last word.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(rows, model, options).select("doc_id", F.col("_score").alias("score"), F.col("_offending").alias("offending"))


def with_score(docs: DataFrame, model: ToxicityModel, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """docs with _score and _offending, see score."""
    o = options
    docs = docs.drop("_score", "_offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    span = StructType([StructField("first", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_offending", ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in T.chunks(batches):
            column = batch.column("text")
            s = Sentences.of(column, o)
            z = own.sentence_logits(s)
            scores = 1 - np.exp(-np.bincount(s.row, softplus(z), minlength=batch.num_rows))
            p = sigmoid(z)
            data, at = T.buffers(column)
            hot = np.flatnonzero(p >= o.offending)
            places = np.searchsorted(s.row[hot], np.arange(batch.num_rows + 1))
            chars = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if len(hot) else np.zeros(len(data) + 1, np.int64)
            begin = chars[at[s.row[hot]]]
            parts = pa.StructArray.from_arrays([pa.array((chars[s.first[hot]] - begin).astype(np.int32)), pa.array((chars[s.end[hot]] - begin).astype(np.int32)), pa.array(p[hot])], ["first", "end", "score"])
            lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), parts).cast(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), lists], [*batch.schema.names, "_score", "_offending"])

    return docs.mapInArrow(run, schema)


def crc_part(parts: int) -> Column:
    """The remainder of the CRC-32 of doc_id as text; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts
