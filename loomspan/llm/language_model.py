"""Scoring texts with a causal self-attention model on subword ids, trained here, beside add-one word probabilities.

Words are lower-cased runs without white space; a text is its words and one end. Counts of all words of all training
documents give the base score. The model reads the same words as subword ids of a public tokenizer and predicts them one
by one, in overlapping windows (module attention), the end included. A text's score is the sum of its subword ids'
log-probabilities: the probabilities of all sequences of ids with one end sum to 1.

Training: every training document is cut into consecutive windows of subword tokens, each token being predicted in one
of them, so the model learns from all tokens; which subwords get a unit of their own is counted over all of them too.
Trainers, one for each so many windows, descend from common parameters on their own windows, and their parameters are
averaged in Spark after each round. A trainer sees another part of its windows in each round, and all of them once, or
all of them several times where they are few. What reaches the driver has a fixed bound: counts by subword id, the
model's parameters, and the frequent words.

Scoring reads texts once. Words that are frequent in all documents, training or not, are looked up in a broadcast table
with their subwords; the others are joined to their counts. No key dominates that join: a word outside the table has no
more than one in options.frequent of all occurrences, and a chunk of text sends a word once for each document.

Defined results: a null or empty text is one end; without training documents all counts are 0 and the model is as it was
initialised; rows of equal doc_id are scored each for itself; null ids count as an empty text for the training rule; an
empty table gives an empty one. Columns other than doc_id and text are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import attention
from loomspan.llm import text as T
from loomspan.session import discard, durable, small_batches

END_WORD = np.uint64(0x656E64)  #: stands for the end among hashes of words
END_ID = 2  #: its subword id


@dataclass(frozen=True)
class LanguageModelOptions:
    shape: attention.Shape = field(default_factory=attention.Shape)
    trainer: int = 1 << 18  #: windows of a trainer, about
    rounds: int = 3
    batch: int = 128  #: windows of a step
    steps: int = 600  #: steps of a trainer in a round at least
    rate: float = 0.03
    frequent: int = 1 << 16  #: words in the table of frequent words at most
    chunk: int = 4 << 20  #: bytes of text that a task works on at once
    bundles: int = 64  #: that a chunk's windows are dealt to


class Subwords:
    """Subword ids of words, by the tokenizer's library."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def of(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places) of the words at these bytes."""
        raw = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        found = self.library.encode(words, num_threads=1) if words else []
        places = np.cumsum([0, *map(len, found)])
        return np.fromiter((i for f in found for i in f), np.int32, int(places[-1])), places


@dataclass
class Words:
    """Distinct words of a column, and the texts as their numbers; the last number is the end's."""

    hashes: np.ndarray
    number: np.ndarray  #: of each word, ends included
    places: np.ndarray  #: where each text's words begin
    data: np.ndarray
    first: np.ndarray  #: bytes of each distinct word
    end: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        hashes, first, end, place = T.words(column)
        data, _ = T.buffers(column)
        unique, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        number = np.insert(number, place[1:], len(unique))
        return cls(np.append(unique, END_WORD), number, place + np.arange(len(place)), data, first[at], end[at])

    def tokens(self, subwords: Subwords, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places) of the distinct words, the end included; none for words that are not wanted. wanted is sorted."""
        end = len(self.first)
        real = wanted[wanted < end]
        ids, places = subwords.of(self.data, self.first[real], self.end[real])
        length = np.zeros(end + 1, np.int64)
        length[real], length[end] = np.diff(places), 1
        return np.append(ids, np.int32(END_ID)), np.append(0, np.cumsum(length))


def spread(number: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, word_places): the ids of words given by number, one word after the other."""
    length = np.diff(places)[number]
    begin = np.cumsum(length) - length
    at = np.repeat(places[number] - begin, length) + np.arange(int(length.sum()))
    return ids[at], begin


def number_type(pieces: int) -> type[np.signedinteger]:
    """The type of subword ids in stored windows."""
    return np.int16 if pieces <= 1 << 15 else np.int32


def cut(tokens: np.ndarray, text_at: np.ndarray, size: int) -> np.ndarray:
    """The windows of texts that stand at text_at[i]:text_at[i + 1], a row each: the token before, then size to predict.

    A text's windows follow one another. -1 stands before its start and -2 after its end.
    """
    length = np.diff(text_at)
    parts = -(-length // size)
    text = np.repeat(np.arange(len(length)), parts)
    low = text_at[text] + size * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
    at = low[:, None] + np.arange(-1, size)
    rows = np.where(at < text_at[text + 1][:, None], tokens[np.clip(at, 0, max(0, len(tokens) - 1))], -2)
    rows[low == text_at[text], 0] = -1
    return rows


class Looked:
    """Subword ids of words: those of words that a task has met are remembered and looked up."""

    def __init__(self, model: LanguageModel | None, subwords: Subwords, most: int = 1 << 19) -> None:
        self.model, self.subwords, self.most = model, subwords, most
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words whose ids are remembered
        self.ids, self.places = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def tokens(self, w: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As Words.tokens, of all words or of those that wanted marks. New ones are remembered, up to a fixed number, and then the
        memory starts again."""
        own = w.hashes[:-1]
        at = np.searchsorted(self.known, own).clip(0, max(0, len(self.known) - 1))
        met = self.known[at] == own if len(self.known) else np.zeros(len(own), bool)
        if wanted is not None:
            met &= wanted
        new = np.flatnonzero(~met if wanted is None else ~met & wanted)
        ids, places = w.tokens(self.subwords, new)
        length = np.diff(places)
        length[np.flatnonzero(met)] = np.diff(self.places)[at[met]]
        out_places = np.append(0, np.cumsum(length))
        out = np.empty(int(out_places[-1]), np.int32)
        old, _ = spread(at[met], self.ids, self.places)
        from_old = np.repeat(np.append(met, False), length)
        out[from_old] = old
        out[~from_old] = ids
        if len(new):
            if len(self.known) + len(new) > self.most:
                self.known, self.ids, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)
            size = np.append(np.diff(self.places), np.diff(places)[new])
            every = np.append(self.ids, ids[:-1])
            begins = np.cumsum(size) - size
            hashes = np.append(self.known, own[new])
            order = np.argsort(hashes)
            self.ids, _ = spread(order, every, np.append(begins, len(every)))
            self.known, self.places = hashes[order], np.append(0, np.cumsum(size[order]))
        return out, out_places


def gather(docs: DataFrame, training: Column, proto: bytes, o: LanguageModelOptions) -> DataFrame:
    """(h, n, m, t, windows, place): counts of words by hash in training documents (n) and in all (m); counts n of subword
    ids t in training documents; or bundles of these documents' windows as bytes of number_type with a number of their own.
    The others are null.
    """
    names = ["h", "n", "m", "t", "windows", "place"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def batch_of(**given: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given.get(name, pa.nulls(n, kind)) for name, kind in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(proto)
        looked = Looked(None, subwords)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen = np.zeros(subwords.library.get_piece_size(), np.int64)
        kind = number_type(len(seen))
        place = TaskContext.get().partitionId() << 40

        def settle() -> None:
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            held[:] = [(h, *(np.bincount(at, np.concatenate([x[i] for x in held])).astype(np.int64) for i in (1, 2)))]

        for batch in T.chunks(batches, o.chunk):
            w = Words.of(batch.column("text"))
            learnt = batch.column("training").fill_null(False).to_numpy(zero_copy_only=False)
            word_learnt = np.repeat(learnt, np.diff(w.places))
            number = w.number[word_learnt]
            count = np.bincount(number, minlength=len(w.hashes))
            held.append((w.hashes, count, np.bincount(w.number, minlength=len(w.hashes))))
            if sum(len(x[0]) for x in held) > 1 << 21:
                settle()
            if not len(number):
                continue
            ids, places = looked.tokens(w, count[:-1] > 0)
            np.add.at(seen, ids, np.repeat(count, np.diff(places)))
            tokens, word_at = spread(number, ids, places)
            text_at = np.cumsum(np.append(0, np.diff(w.places)[learnt]))
            rows = cut(tokens, np.append(word_at, len(tokens))[text_at], o.shape.window).astype(kind)
            bundles = [rows[i :: o.bundles].tobytes() for i in range(min(o.bundles, len(rows)))]
            yield batch_of(windows=pa.array(bundles, pa.binary()), place=pa.array(np.arange(place, place + len(bundles))))
            place += len(bundles)
        if held:
            settle()
            h, n, m = held[0]
            for a in range(0, len(h), 1 << 16):
                b = a + (1 << 16)
                yield batch_of(h=pa.array(h[a:b].view(np.int64)), n=pa.array(n[a:b]), m=pa.array(m[a:b]))
            t = np.flatnonzero(seen)
            yield batch_of(t=pa.array(t.astype(np.int32)), n=pa.array(seen[t]))

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return rows.mapInArrow(run, "h long, n long, m long, t int, windows binary, place long")


@dataclass
class LanguageModel:
    """What tasks need to score texts."""

    flat: np.ndarray
    unit: np.ndarray  #: of each subword id
    words: np.ndarray  #: hashes of the frequent words, sorted, and their counts in training documents
    counts: np.ndarray
    total: int  #: training tokens
    distinct: int
    options: LanguageModelOptions

    @property
    def rest(self) -> float:
        """Log-probability of a subword id given that it is one of those without a unit of their own."""
        return -math.log(max(1, int((self.unit == self.options.shape.units - 1).sum())))


def units(tokens: list[tuple[int, int]], starts: np.ndarray, shape: attention.Shape) -> np.ndarray:
    """The unit of each subword id: own ones for the most frequent, those that begin words together; the last for all others."""
    kept = sorted(t for t, _ in sorted(tokens, key=lambda x: (-x[1], x[0]))[: shape.units - 1])
    kept.sort(key=lambda t: not starts[t])
    unit = np.full(len(starts), shape.units - 1, np.int32)
    unit[kept] = np.arange(len(kept))
    return unit


def deal(windows: DataFrame, trainers: int, shape: attention.Shape, kind: type[np.signedinteger]) -> DataFrame:
    """(trainer, n, rows): the windows of each trainer, one after the other, in an order of their own.

    Bundles are dealt by their stored numbers, not by what they hold, so equal windows spread over all trainers.
    """

    def pack(table: pa.Table) -> pa.Table:
        row = np.frombuffer(b"".join(table.column("windows").to_pylist()), kind).reshape(-1, shape.window + 1)
        row = row[np.lexsort(row.T[:4])]  # nearly the same in whatever order rows come
        return pa.table({"trainer": table.column("trainer")[:1], "n": pa.array([len(row)], pa.int64()), "rows": pa.array([row.tobytes()], pa.binary())})

    dealt = windows.select("windows", F.pmod(F.xxhash64("place"), F.lit(trainers)).alias("trainer"))
    return dealt.groupBy("trainer").applyInArrow(pack, "trainer long, n long, rows binary")


def learner(shared: Broadcast, unit: np.ndarray, o: LanguageModelOptions, turn: int, kind: type[np.signedinteger]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trainers' work in a round: each from the common parameters to its own, on its windows of this round."""
    shape = o.shape

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in (x for batch in batches for x in batch.column("rows")):
            row = np.frombuffer(packed.as_buffer(), kind).reshape(-1, shape.window + 1)
            if len(row) >= o.rounds * o.steps * o.batch:
                row = row[turn :: o.rounds]
            coded = np.where(row >= 0, unit[row.clip(0)], np.where(row == -1, shape.units, -1)).astype(np.int32)
            inputs, targets = np.where(coded[:, :-1] < 0, shape.units, coded[:, :-1]), coded[:, 1:]
            steps = max(o.steps, -(-len(row) // o.batch))
            rates = tuple(o.rate * (1 - 0.95 * t / o.rounds) for t in (turn, turn + 1))  # over all rounds it falls to a twentieth
            out = attention.descend(shared.value, shape, inputs, targets, o.batch, steps, rates, turn)
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float32())), pa.array([float(len(row))])], ["flat", "weight"])

    return learn


def train(docs: DataFrame, training: Column, proto: bytes, options: LanguageModelOptions = LanguageModelOptions()) -> tuple[LanguageModel, DataFrame]:
    """The model, and the table (h, n) of all training words' counts."""
    o = options
    shape = o.shape
    with small_batches(docs.sparkSession, 2000):
        got = durable(gather(docs, training, proto, o), "gathered", "zstd")
    every = durable(got.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "every")
    counts = every.where("n > 0").select("h", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the count from which words are frequent: by classes of counts, of which there are few
    classes = every.groupBy(F.floor(F.log2("m") * 8).alias("c")).agg(F.count(F.lit(1)).alias("words"), F.min("m").alias("least")).orderBy(F.desc("c")).collect()
    least, held = 1 << 62, 0
    for r in classes:
        held += r.words
        if held > o.frequent:
            break
        least = r.least
    frequent = every.where(F.col("m") >= least).select("h", "n").toArrow()
    hashes, often = frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(hashes)
    windows = got.where("windows is not null").select("windows", "place")
    tokens = got.where("t is not null").groupBy("t").agg(F.sum("n").alias("n")).collect()
    library = Subwords(proto).library
    starts = np.array([library.id_to_piece(i).startswith("▁") for i in range(library.get_piece_size())])
    kind = number_type(len(starts))
    unit = units([(r.t, r.n) for r in tokens], starts, shape)
    flat = attention.initial(shape, np.bincount(unit[[r.t for r in tokens]], [r.n for r in tokens], shape.units) if tokens else None)
    size = np.dtype(kind).itemsize * (shape.window + 1)
    many = windows.agg(F.coalesce(F.sum(F.length("windows")), F.lit(0))).first()[0] // size
    if many:
        dealt = durable(deal(windows, max(1, round(many / o.trainer)), shape, kind), "dealt", "zstd", "trainer")
        for turn in range(o.rounds):
            shared = docs.sparkSession.sparkContext.broadcast(flat)
            made = durable(dealt.select("rows").mapInArrow(learner(shared, unit, o, turn, kind), "flat array<float>, weight double"), "trained")
            mean = made.select("weight", F.posexplode("flat").alias("at", "x")).groupBy("at").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
            flat = mean.orderBy("at").toArrow().column("x").to_numpy().astype(np.float32)
            discard(made)
        discard(dealt)
    discard(got)
    return LanguageModel(flat, unit, hashes[order], often[order], int(total), int(distinct), o), counts


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame, proto: bytes) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row; logarithms to base 10."""
    o = model.options
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = model.total + model.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        looked = Looked(m, Subwords(proto))
        scorer = attention.Scorer(m.flat, o.shape)
        for batch in T.chunks(batches, o.chunk):
            w = Words.of(batch.column("text"))
            ids, places = looked.tokens(w)
            found = np.searchsorted(m.words, w.hashes).clip(0, max(0, len(m.words) - 1))
            known = m.words[found] == w.hashes if len(m.words) else np.zeros(len(w.hashes), bool)
            often = np.where(known, m.counts[found], 0) if len(m.words) else np.zeros(len(w.hashes), np.int64)
            tokens, word_at = spread(w.number, ids, places)
            unit = m.unit[tokens]
            text_at = np.append(word_at, len(tokens))[w.places]
            logs = scorer.score(unit, text_at).astype(np.float64)
            logs[unit == o.shape.units - 1] += m.rest
            sure = known[w.number]
            base = np.where(known, np.log((often + 1) / size), 0)[w.number]
            sums = [np.add.reduceat(x, at[:-1]) / math.log(10) if batch.num_rows else x for x, at in ((base, w.places), (logs, text_at))]
            rows = np.repeat(np.arange(batch.num_rows), np.diff(w.places))
            rare = np.unique((rows * len(w.hashes) + w.number)[~sure], return_counts=True)
            row, number = np.divmod(rare[0], len(w.hashes))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(w.hashes[number].view(np.int64)), pa.array(rare[1])], ["h", "k"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(np.diff(w.places)),
                    pa.array(np.bincount(rows, (often > 0)[w.number] & sure, batch.num_rows).astype(np.int64)),
                    *map(pa.array, sums),
                    pa.ListArray.from_arrays(pa.array(cuts), values),
                ],
                ["row", "doc_id", "n_tokens", "known", "base", "score", "rare"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<struct<h:long,k:long>>"
    with small_batches(docs.sparkSession, 2000):
        scored = durable(rows.mapInArrow(run, schema), "scored", "zstd")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.k")
    n = F.coalesce("n", F.lit(0))
    found = rare.join(counts, "h", "left").select("row", F.when(n > 0, F.col("k")).otherwise(0).alias("more"), (F.col("k") * F.log10((n + 1) / F.lit(float(size)))).alias("rest"))
    sums = found.groupBy("row").agg(F.sum("more").alias("more"), F.sum("rest").alias("rest"))
    out = scored.drop("rare").join(sums, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
