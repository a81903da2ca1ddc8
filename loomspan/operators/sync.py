"""Aligning two timelines: choosing anchors, a robust fit with fixed scales, and the decision on a candidate."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import fuzz_ratio, sorted_words

#: fixed values: frame rates that are confused with one another
FRAME_RATES = ((25, 23.976), (25, 24), (24, 23.976), (30, 29.97))
RATIOS = (1.0, *(a / b for a, b in FRAME_RATES), *(b / a for a, b in FRAME_RATES))
#: fixed values: words, shortest and longest duration of an anchor; the second rule holds where no cue meets the first
STRICT, RELAXED = (4, 1.0, 7.0), (2, 0.5, 10.0)


def snap(ratio: Column, tolerance: float = 0.001) -> Column:
    """The first standard ratio that a ratio differs from by no more than a share of it; itself if there is none."""
    known = F.array(*(F.lit(r) for r in RATIOS))
    return F.coalesce(F.get(F.filter(known, lambda r: F.abs(ratio / r - 1) <= tolerance), F.lit(0)), ratio)


def anchors(cues: DataFrame, count: int, media: str = "media") -> DataFrame:
    """cues (media, cue, start, end, lyrics, n_words, n_rare) of which each equal stretch of time keeps one.

    A stretch keeps the eligible cue with most rare words, then most words, then the first.
    """
    whole = Window.partitionBy(media)
    long = F.col("end") - F.col("start")
    fits = lambda rule: ~F.col("lyrics") & (long >= rule[1]) & (long <= rule[2]) & (F.col("n_words") >= rule[0])
    rows = cues.withColumns({"_strict": fits(STRICT), "_relaxed": fits(RELAXED), "_low": F.min("start").over(whole), "_high": F.max("end").over(whole)})
    rows = rows.withColumn("_any", F.max(F.col("_strict").cast("int")).over(whole) > 0)
    rows = rows.where(F.when(F.col("_any"), F.col("_strict")).otherwise(F.col("_relaxed")))
    stretch = (F.col("_high") - F.col("_low")) / count
    rows = rows.withColumn("stretch", F.least(F.lit(count - 1), F.floor((F.col("start") - F.col("_low")) / stretch)).cast("int"))
    best = Window.partitionBy(media, "stretch").orderBy(F.desc("n_rare"), F.desc("n_words"), "cue")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_strict", "_relaxed", "_any", "_low", "_high", "_k")


def fit(pairs: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 60, tie: float = 0.05, scale: float = 1.0) -> DataFrame:
    """(keys, scale, offset, error): y = scale * x + offset of each group.

    The scale is `scale` or one of a few fixed ones; those need three pairs that span some time. The offset is the median
    residual and the error the median absolute residual. A later scale must be better by more than `tie`.
    """
    scales = [scale, *(r for r in RATIOS if r != scale)]
    residual = lambda r: F.col(y) - F.lit(r) * F.col(x)
    free = (F.count(x) >= 3) & (F.max(x) - F.min(x) >= span)
    offsets = pairs.groupBy(*keys).agg(free.alias("_free"), *(F.median(residual(r)).alias(f"_o{i}") for i, r in enumerate(scales)))
    rows = pairs.join(offsets, list(keys))
    kept = [F.first(c).alias(c) for c in ("_free", *(f"_o{i}" for i in range(len(scales))))]
    errors = rows.groupBy(*keys).agg(*kept, *(F.median(F.abs(residual(r) - F.col(f"_o{i}"))).alias(f"_e{i}") for i, r in enumerate(scales)))
    tried = [F.struct(F.lit(r).alias("scale"), F.col(f"_o{i}").alias("offset"), F.col(f"_e{i}").alias("error")) for i, r in enumerate(scales)]
    best = F.aggregate(F.when(F.col("_free"), F.array(*tried[1:])).otherwise(F.slice(F.array(*tried), 1, 0)), tried[0], lambda b, c: F.when(c["error"] < b["error"] - tie, c).otherwise(b))
    return errors.select(*keys, best.alias("_b")).select(*keys, "_b.scale", "_b.offset", "_b.error")


def fidelity(anchors_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fidelity): the median over the anchors that heard anything."""
    return anchors_.groupBy(*keys).agg(F.median("fidelity").alias("fidelity"))


def check(anchors_: DataFrame, found: DataFrame, keys: Sequence[str], id: str, threshold: float = 75, most: float = 0.5, least: float = 0.5, faithful: float = 0.6, candidates: DataFrame | None = None) -> DataFrame:
    """(keys, tried, matched, scale, offset, error, fidelity, problem): the fit of each candidate and whether it passes.

    anchors_: keys, id, start; found: keys, id, score, fidelity, heard_at (best_window's rows, or track's). candidates:
    keys of all candidates; one without anchors has the problem no-anchors. Without it, only those with anchors are judged.
    """
    rows = anchors_.select(*keys, id, "start").join(found.select(*keys, id, "score", "fidelity", "heard_at"), [*keys, id], "left")
    hit = F.coalesce((F.col("score") >= threshold) & F.col("heard_at").isNotNull(), F.lit(False))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tried"), F.count_if(hit).alias("matched"), F.median("fidelity").alias("fidelity"))
    if candidates is not None:
        counts = candidates.select(*keys).distinct().join(counts, list(keys), "left").fillna(0, ["tried", "matched"])
    out = counts.join(fit(rows.where(hit), keys, "start", "heard_at"), list(keys), "left")
    problem = decision(F.col("matched"), F.col("tried"), F.coalesce("error", F.lit(0.0)), F.col("fidelity"), least, most, faithful)
    return out.select(*keys, "tried", "matched", "scale", "offset", "error", "fidelity", problem.alias("problem"))


def decision(matched: Column, tried: Column, error: Column, fidelity: Column, least: float = 0.5, most: float = 0.5, faithful: float = 0.6) -> Column:
    """Null if a candidate passes, else the first reason why not: no-anchors, unmatched, error or fidelity. A null fidelity is none."""
    return F.when(tried == 0, "no-anchors").when(matched < least * tried, "unmatched").when(error > most, "error").when(fidelity.isNull() | (fidelity < faithful), "fidelity")


def word_runs(rows: DataFrame, id: str, words: str, size: int = 5) -> DataFrame:
    """(id, pos, run): a 64-bit hash of each run of so many neighbouring words of an array; pos is its first word's place."""
    rows = rows.select(id, words)  # shorter arrays give nothing; a filter here would make Spark work the words out twice
    kind = rows.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            distinct = lists.flatten().dictionary_encode()
            own = pd.util.hash_array(np.array(distinct.dictionary.to_pylist(), object), categorize=False)[distinct.indices.to_numpy(zero_copy_only=False)]
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            row = np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
            pos = np.arange(len(own)) - (ends - np.diff(ends, prepend=0))[row]
            n = max(0, len(own) - size + 1)
            hashed = np.zeros(n, np.uint64)
            for k in range(size):
                hashed = (hashed ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            whole = np.flatnonzero(row[:n] == row[size - 1 :])
            for some in (whole[i : i + (1 << 17)] for i in range(0, len(whole), 1 << 17)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), pa.array(pos[some].astype(np.int32)), pa.array(hashed[some].view(np.int64))], [id, "pos", "run"])

    return rows.mapInArrow(run, f"`{id}` {kind}, pos int, run long")


def _tried(anchors_: DataFrame, words: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Every run that best_window and scored_runs compare, with its score."""
    most = (anchors_.agg(F.max("n_words")).first()[0] or 0) + 1
    order = Window.partitionBy(*keys).orderBy("pos")
    runs = words.where("token <> ''").withColumns({"_run": F.collect_list("token").over(order.rowsBetween(0, max(0, most - 1))), "_heard": F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int")})
    runs = runs.select(*keys, "pos", F.col("start").alias("at"), "_run", "_heard")
    left = anchors_.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    right = runs.withColumn("_bin", F.floor(F.col("at") / size))
    pairs = left.join(right, [*keys, "_bin"]).where((F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")))
    sizes = F.array_distinct(F.array(*(F.greatest(F.least(F.col("n_words") + k, F.col("_heard")), F.lit(1)) for k in (-1, 0, 1))))
    pairs = pairs.withColumn("_n", F.explode(sizes)).where(F.size("_run") >= F.col("_n"))
    pairs = pairs.withColumn("said", F.array_join(F.slice("_run", 1, F.col("_n")), " ")).drop("_run")
    # few bytes, but long work: as many tasks as a shuffle has, which adaptive execution would take for small ones and join
    tasks = max(int(anchors_.sparkSession.conf.get("spark.sql.shuffle.partitions")), anchors_.sparkSession.sparkContext.defaultParallelism)
    return pairs.repartition(tasks, *keys, "pos").withColumn("score", fuzz_ratio(F.col("text"), F.col("said")))


def scored_runs(anchors_: DataFrame, words: DataFrame, keys: Sequence[str], id: str, size: float = 30) -> DataFrame:
    """(keys, id, pos, at, n_words, score, fidelity): of the heard runs that begin at a place in an anchor's span, the one most like its text.

    anchors_: keys, id, text, low, high (search span), n_words; words: keys, pos, start, token, as in best_window.
    """
    best = F.max_by(F.struct("at", F.col("_n").alias("n_words"), "score", "said", "text"), F.struct("score", -F.col("_n")))
    rows = _tried(anchors_, words, keys, size).groupBy(*keys, id, "pos").agg(best.alias("_b"))
    return rows.select(*keys, id, "pos", "_b.at", "_b.n_words", "_b.score", run_fidelity(F.col("_b.text"), F.col("_b.said")).alias("fidelity"))


def best_window(anchors_: DataFrame, words: DataFrame, keys: Sequence[str], id: str, size: float = 30) -> DataFrame:
    """(keys, id, score, fidelity, heard_at): the run of heard words most like each anchor's text.

    anchors_: keys, id, text, low, high (search span), n_words; words: keys, pos, start, token. Tokens that are empty are
    not heard. Runs have the anchor's number of words, give or take one, or all words where there are fewer, and begin in
    its span. Of the best, the shortest wins, then the first. The fidelity, 0 to 1, is the likeness of its sorted words.
    """
    best = F.max_by(F.struct("score", F.col("at").alias("heard_at"), "text", "said"), F.struct("score", -F.col("_n"), -F.col("pos")))
    rows = _tried(anchors_, words, keys, size).groupBy(*keys, id).agg(best.alias("_b"))
    return rows.select(*keys, id, "_b.score", run_fidelity(F.col("_b.text"), F.col("_b.said")).alias("fidelity"), "_b.heard_at")


def run_fidelity(text: Column, said: Column) -> Column:
    """The likeness of the sorted words of two texts, 0 to 1."""
    return fuzz_ratio(sorted_words(text), sorted_words(said)) / 100


class Model:
    """fit for the pairs of one candidate as they come: each scale's residuals stay in order, so a pair costs a few looks."""

    def __init__(self, scale: float = 1.0, span: float = 60, tie: float = 0.05) -> None:
        self.scales = [scale, *(r for r in RATIOS if r != scale)]
        self.rests: list[list[float]] = [[] for _ in self.scales]
        self.pairs: list[tuple[float, float]] = []
        self.span, self.tie, self.low, self.high = span, tie, float("inf"), float("-inf")

    def add(self, x: float, y: float) -> None:
        self.pairs.append((x, y))
        self.low, self.high = min(self.low, x), max(self.high, x)
        for scale, rest in zip(self.scales, self.rests, strict=True):
            insort(rest, y - scale * x)

    def of(self, scale: float) -> Model:
        """The same pairs with another scale before any fit."""
        other = Model(scale, self.span, self.tie)
        for x, y in self.pairs:
            other.add(x, y)
        return other

    def best(self) -> tuple[float, float, float]:
        """(scale, offset, error); without pairs the given scale and nothing else."""
        n = len(self.rests[0])
        if not n:
            return self.scales[0], 0.0, 0.0
        found = None
        for scale, rest in zip(self.scales, self.rests, strict=True):
            offset = rest[n // 2] if n % 2 else (rest[n // 2 - 1] + rest[n // 2]) / 2
            error = _distance(rest, offset, n // 2) if n % 2 else (_distance(rest, offset, n // 2 - 1) + _distance(rest, offset, n // 2)) / 2
            if found is None or error < found[2] - self.tie:
                found = scale, offset, error
            if n < 3 or self.high - self.low < self.span:
                break
        return found


def _distance(rest: list[float], middle: float, k: int) -> float:
    """Of the distances of sorted numbers from one amid them the k-th, from 0: those below and above are in order already."""
    m = bisect_left(rest, middle)
    low, high = max(0, k + 1 - len(rest) + m), min(m, k + 1)
    while low < high:  # how many of the first k + 1 are below the middle
        i = (low + high) // 2
        if rest[m + k - i] - middle <= middle - rest[m - 1 - i]:
            high = i
        else:
            low = i + 1
    below = middle - rest[m - low] if low else 0.0
    return max(below, rest[m + k - low] - middle) if k >= low else below


def track(anchors_: DataFrame, runs: DataFrame, key: str, id: str = "cue", threshold: float = 75, shortest: float = 0.5, span: float = 60, tie: float = 0.05) -> DataFrame:
    """(key, id, start, low, high, score, fidelity, heard_at): each anchor searched where the fit of those before it puts it.

    anchors_: key, id, start, end, radius, duration (null: without end) and scale (the candidate's scale before any fit).
    runs: key, id, at, n_words, score, fidelity: how like an anchor the words heard from a time on are (scored_runs).
    Anchors of a candidate are taken in order of start. One is searched from its predicted start to its predicted end,
    widened by radius and cut to 0..duration. Of the runs that begin there the best counts (then the shortest, then the first). If its
    score reaches the threshold it is a pair, heard_at is its time, and scale and offset are fitted anew to all pairs so
    far, as fit does; so a drift that builds up stays in the window. A window shorter than `shortest` isn't searched; its score is 0, as
    is that of a window without runs.

    A candidate's runs come before its anchors, in order, and stream through a task, which holds the runs and pairs of one
    candidate; the runs are scored and cut to anchors before, in tasks of their own.
    Null keys are one candidate; null starts, ends and scores are left out; an empty table gives an empty one.
    """
    none = lambda kind: F.lit(None).cast(kind)
    left = anchors_.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(key, id, "start", "end", "radius", F.col("duration").cast("double").alias("duration"), F.col("scale").cast("double").alias("scale"), *(none(k).alias(c) for c, k in (("at", "double"), ("n_words", "int"), ("score", "double"), ("fidelity", "double"))))
    right = runs.where(F.col("score").isNotNull()).select(key, id, *(none("double").alias(c) for c in ("start", "end", "radius", "duration", "scale")), F.col("at").cast("double").alias("at"), F.col("n_words").cast("int").alias("n_words"), F.col("score").cast("double").alias("score"), F.col("fidelity").cast("double").alias("fidelity"))
    kind = lambda c: anchors_.schema[c].dataType.simpleString()

    schema = f"`{key}` {kind(key)}, `{id}` {kind(id)}, start double, low double, high double, score double, fidelity double, heard_at double"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, fitted, line = (), {}, None, None
        for batch in batches:
            rows: list[tuple] = []
            for own, name, start, end, radius, duration, scale, at, n_words, score, fidelity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (own,):
                    now, places, fitted, line = (own,), {}, None, None
                if start is None:  # a run; the best of an anchor stands first
                    places.setdefault(name, []).append((at, score, fidelity))
                    continue
                factor, offset = (line or (scale or 1.0, 0.0, 0.0))[:2]
                low = max(0.0, factor * start + offset - radius)
                high = factor * end + offset + radius
                high = high if duration is None else min(duration, high)
                best, like, heard = 0.0, None, None
                if high - low >= shortest:
                    found = next((r for r in places.get(name, ()) if r[0] is not None and low <= r[0] <= high), None)
                    if found:
                        best, like = found[1:]
                        if best >= threshold:
                            heard = found[0]
                            fitted = fitted or Model(scale or 1.0, span, tie)
                            if fitted.scales[0] != (scale or 1.0):  # another anchor names another scale
                                fitted = fitted.of(scale or 1.0)
                            fitted.add(start, heard)
                            line = fitted.best()
                rows.append((own, name, start, low, max(low, high), best, like, heard))
            if rows:
                types = [batch.schema.field(0).type, batch.schema.field(1).type, *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [key, id, "start", "low", "high", "score", "fidelity", "heard_at"])

    both = left.withColumns({c: F.col(c).cast("double") for c in ("start", "end", "radius")}).unionByName(right)
    order = [F.col(key), F.col("start").isNotNull(), F.isnan("score"), F.desc("score"), F.col("n_words").asc_nulls_last(), F.col("at").asc_nulls_last(), F.col("start"), F.col(id).asc_nulls_last()]
    return both.repartition(key).sortWithinPartitions(*order).mapInArrow(follow, schema)
