"""Near-duplicate documents: one-permutation MinHash with optimal densification.

Each distinct word sequence gets one signature from a single hash of its word shingles: the hash range is cut into
bands * rows bins, a bin holds its smallest hash, and an empty bin borrows from the filled bin that comes first in
the bin's own random order (optimal densification). Rows of the signature make band hashes. Documents that share a
band hash are candidates, but only edges to the smallest document of a bucket are drawn (a star), so that a bucket
of n documents gives n - 1 edges. Edges are confirmed on full shingle sets. Links that stars miss join different
components that still share a bucket; a second pass compares exactly those documents across components, in tiles: either
all of a family of documents that such buckets tie, or each of its buckets by itself, whichever moves fewer rows.

With 60 bands of 6 rows, two sets of similarity 0.75 share no bucket with probability (1 - 0.75 ** 6) ** 60 < 1e-5.

What moves: a set of shingles, once for each star edge of its document, a star's centre once for some hundred of its
neighbours. In the second pass the documents of a group's largest component meet those of the others only, never each
other, so a large group of copies with some outliers moves once for each tile of outliers. A bucket of m documents that
all stay in different components (texts that share most, but less than three quarters, of their shingles) sends each of
them to m / tile tasks; this is what remains quadratic.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; fewer than five words make
one shingle of the whole sequence; rows of equal doc_id are one node of the graph, whatever their texts, so they share
a component; a row whose doc_id is null keeps null as component and isn't kept; texts of any length are compared whole; an
empty table gives an empty one. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import text as T
from loomspan.llm.graph import components
from loomspan.llm.sieve import bitmap, sieved
from loomspan.session import discard, durable, small_batches


@dataclass(frozen=True)
class NearDuplicateOptions:
    shingle_words: int = 5
    similar: int = 75  #: percent of the union that two sets must share
    bands: int = 60
    rows: int = 6
    tile: int = 128  #: documents that are compared at once
    tile_shingles: int = 1 << 18  #: their shingles, about
    star: int = 64  #: neighbours to which a centre's set is sent once
    seed: int = 7


def shingle_sets(column: pa.Array, size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """For each row: the sorted distinct hashes of its shingles, and a digest of its word sequence."""
    hashes, _, _, place = T.words(column)
    weights = T.series(size, 5)
    if len(hashes) >= size:
        n = len(hashes) - size + 1
        runs = hashes[:n] * weights[0]
        for i in range(1, size):
            runs = runs + hashes[i : n + i] * weights[i]
        runs = T.mix(runs)
    else:
        runs = np.zeros(0, np.uint64)
    sets, digests = [], []
    for low, high in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        own = hashes[low:high]
        if high - low >= size:
            sets.append(np.unique(runs[low : high - size + 1]))
        elif high > low:
            sets.append(T.mix(np.array([(own * weights[: high - low]).sum() + np.uint64(high - low)], np.uint64)))
        else:
            sets.append(own)
        digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
    return sets, digests


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, options: NearDuplicateOptions) -> None:
        self.o = options
        self.bins = n = options.bands * options.rows
        self.order = T.mix(np.arange(n * n, dtype=np.uint64) + np.uint64(options.seed << 40)).reshape(n, n)
        self.weights = T.series(options.rows, 17)
        self.band = T.series(options.bands, 23)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        at = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        filled = at[first].astype(np.int64)
        signature = np.zeros(self.bins, np.uint64)
        signature[filled] = shingles[first]
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            signature[empty] = shingles[first[self.order[np.ix_(empty, filled)].argmin(1)]]
        return T.mix((signature.reshape(self.o.bands, self.o.rows) * self.weights).sum(1) + self.band).view(np.int64)


def sketch(docs: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """(doc_id, key, n_shingles, bands) of each row; bands is null where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(options)
        for batch in T.chunks(batches):
            sets, digests = shingle_sets(batch.column("text"), options.shingle_words)
            bands = [signer.bands(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key binary, n_shingles long, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """(doc_id, shingles, size) of the given documents, written once: what follows shuffles these, not the corpus.

    A bitmap of the ids keeps most other texts out of the shuffle. The ids are the built side of a hashed join, so texts
    are not sorted. shingles: sorted distinct 64-bit hashes, as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            sets, _ = shingle_sets(batch.column("text"), options.shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "shingles", "size"])

    bits = bitmap(ids, "doc_id")
    texts = sieved(docs, "doc_id", bits).where("_met").join(ids.distinct().hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        sets = durable(texts.mapInArrow(run, "doc_id long, shingles binary, size long"), "sets")
    discard(bits)
    return sets


def alike(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    """Whether two sets share so many percent of their union."""
    low, high = sorted((len(x), len(y)))
    if not low or 100 * low < similar * high:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similar * (low + high - both)


def confirm(pairs: DataFrame, sets: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """The pairs (a, b) of documents whose full shingle sets are similar enough.

    The neighbours of a centre a are dealt to parts of about options.star; a part's rows come one after the other, the
    centre's set first, so a task holds no more than that set and a batch. A doc_id with several texts has several sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, centres = None, []
        for batch in batches:
            kept: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), batch.column("shingles"), strict=True)
            for a, number, b, shingles in rows:
                own = np.frombuffer(shingles.as_buffer(), np.uint64)
                if (a, number) != part:
                    part, centres = (a, number), []
                if b is None:
                    centres.append(own)
                elif any(alike(c, own, options.similar) for c in centres):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], ["a", "b"])

    degrees = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / options.star).alias("parts"))
    dealt = durable(pairs.join(durable(degrees, "degrees"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    own = dealt.select("a", "part", F.col("b").alias("doc_id"), "b")
    centres = dealt.select("a", "part", F.col("a").alias("doc_id"), F.lit(None).cast("long").alias("b")).distinct()
    rows = own.union(centres).join(sets.select("doc_id", "shingles"), "doc_id").select("a", "part", "b", "shingles")
    with small_batches(pairs.sparkSession, 2000):
        return durable(rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long"), "links").distinct()


def tiled(members: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """(group, main, others, mains, moved): how each group of several components is cut to tiles, and how many rows that makes.

    members: doc_id, component, group, size. main is the component with most documents; they fill `mains` tiles, and those
    of the other components `others`. A group that fits in one tile is one: main is null then.
    """
    o = options
    parts = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    sums = parts.groupBy("group").agg(F.max(F.struct("n", "component", "s")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("components"))
    tiles = lambda n, s: F.greatest(F.ceil(n / o.tile), F.ceil(s / o.tile_shingles)).cast("int")
    one = tiles(F.col("n"), F.col("s")) <= 1
    rows = sums.where("components > 1").select(
        "group", "n", F.col("m.n").alias("held"), F.when(~one, F.col("m.component")).alias("main"),
        F.when(one, 1).otherwise(tiles(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s"))).alias("others"), F.when(one, 0).otherwise(tiles(F.col("m.n"), F.col("m.s"))).alias("mains"),
    )
    moved = F.when(F.col("main").isNull(), F.col("n")).otherwise((F.col("n") - F.col("held")) * (F.col("others") + F.col("mains")) + F.col("held") * F.col("others"))
    return rows.select("group", "main", "others", "mains", moved.alias("moved"))


def compare_tiles(sets: DataFrame, members: DataFrame, tiles: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """Links (a, b) between documents of one group but different components, found by comparing them all.

    members: (doc_id, component, group); tiles: tiled's rows. Documents are dealt to tiles by a hash, and each pair of
    tiles that may hold a link is compared for itself, so that no task ever holds a whole group. A pair of tiles returns a
    forest of its links at most, and no row is made for a pair of documents.
    """
    o = options
    own = F.col("main").isNotNull() & (F.col("component") == F.col("main"))
    tile = F.pmod(F.xxhash64("doc_id"), F.when(F.col("_main"), F.col("mains")).otherwise(F.col("others"))).cast("int") + F.when(F.col("_main"), F.col("others")).otherwise(0)
    reach = F.when(F.col("_main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = (
        members.join(tiles.drop("moved"), "group")
        .withColumn("_main", F.coalesce(own, F.lit(False)))
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), reach - 1)))
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        .select("doc_id", "component", "group", "tile", "low", "high")
    )

    def run(table: pa.Table) -> pa.Table:
        ids, tiles, comps = (table.column(c).to_numpy() for c in ("doc_id", "tile", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[column]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(number.max(initial=-1)) + 1, 4096):
            part = (number >= low) & (number < low + 4096)
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[row[part], number[part] - low] = 1
            both += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - both
        good = (100 * both >= o.similar * union) & (comps[:, None] != comps[None, :])
        if (tiles != tiles[0]).any():
            good &= tiles[:, None] != tiles[None, :]
        top = {c: c for c in comps.tolist()}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        a, b = [], []
        for x, y in zip(*np.nonzero(np.triu(good)), strict=True):
            if (u := find(int(comps[x]))) != (v := find(int(comps[y]))):
                top[u] = v
                a.append(int(ids[x]))
                b.append(int(ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # dealt by the pair of tiles, not by the group, which is what the joins before left them dealt by
    rows = dealt.join(sets.select("doc_id", "shingles"), "doc_id").repartition("group", "low", "high")
    return rows.groupBy("group", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, options: NearDuplicateOptions = NearDuplicateOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs; see the module's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        sketches = durable(sketch(docs, options), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    same = durable(full.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "same")
    bands = full.join(same, ["key", "doc_id"], "left_semi").select("doc_id", F.explode("bands").alias("h"))
    # buckets of two documents or more, each row with the bucket's smallest document
    stars = bands.groupBy("h").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").select("h", "centre")
    shared = durable(bands.join(stars, "h"), "shared")
    pairs = durable(shared.where("centre < doc_id").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    # rows of one doc_id with different texts: their classes are one
    keys = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    several = durable(keys.where("low < high").select("doc_id"), "several")
    own = full.join(several, "doc_id", "left_semi").select("key", F.col("doc_id").alias("b")).join(same.withColumnRenamed("doc_id", "a"), "key").select("a", "b")
    sets = sets_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))), options)
    found = durable(components(confirm(pairs, sets, options).union(own)), "found")
    discard(pairs)
    # buckets that still hold two components: the documents they tie together are compared across components
    placed = shared.join(found, shared.doc_id == found.node, "left").select("h", "centre", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = durable(placed, "placed")
    mixed = durable(placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h"), "mixed")
    rest = durable(placed.join(mixed, "h", "left_semi"), "rest")
    discard(shared, placed, mixed)
    families = components(rest.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")))
    families = durable(rest.select("doc_id", "component").distinct().join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id"), "families")
    sizes = durable(sets.groupBy("doc_id").agg(F.sum("size").alias("size")), "sizes")
    placed = rest.select("h", "doc_id", "component").distinct().join(families.select("doc_id", "family"), "doc_id").join(sizes, "doc_id")
    placed = durable(placed, "members")
    group = lambda by, of: F.struct(F.lit(by).alias("by"), F.col(of).alias("of")).alias("group")
    whole = placed.select("doc_id", "component", group(0, "family"), "size").distinct()
    single = placed.select("doc_id", "component", group(1, "h"), "size")
    both = durable(tiled(whole, options).union(tiled(single, options)), "tiles")
    # a family at once, or bucket by bucket
    of = placed.select(F.col("h").alias("of"), "family").distinct()
    buckets = both.where("group.by = 1").select("group.of", "moved").join(of, "of").groupBy("family").agg(F.sum("moved").alias("apart"))
    chosen = both.where("group.by = 0").select(F.col("group.of").alias("family"), "moved").join(buckets, "family").select("family", (F.col("moved") <= F.col("apart")).alias("at_once"))
    chosen = durable(chosen, "chosen")
    at_once = whole.join(chosen.where("at_once").select(group(0, "family")), "group", "left_semi")
    apart = placed.join(chosen.where("not at_once").select("family"), "family", "left_semi").select("doc_id", "component", group(1, "h"))
    more = compare_tiles(sets, at_once.drop("size").unionByName(apart), both, options)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    found = durable(found, "components")
    discard(sets, rest, families, sizes, placed, both, chosen)
    classes = same.join(found, same.doc_id == found.node, "left").select("key", F.coalesce("component", "doc_id").alias("component_id"))
    tied = several.join(found, several.doc_id == found.node).select("doc_id", F.col("component").alias("tied"))
    out = sketches.select("doc_id", "key", "n_shingles").join(classes, "key", "left").join(tied, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("tied", "component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
