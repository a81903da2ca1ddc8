"""Near-duplicate vectors: randomised-rotation binary codes with correction factors, confidence bounds, exact cosines.

Vectors of equal label and coordinates are one class with a count. A class gets the sign bits of its randomly rotated
unit vector, and for each rotation the factor <code, vector> by which an estimate has to be divided to be free of bias.
Classes of a label that share one of several bands of sign bits meet in a bucket, whose number of bits follows the
logarithm of the label's size; the number of bands follows from the bits, so that a pair just at the threshold shares no
bucket with a probability of 1e-4 at most. Bits grow with the label without a limit that data reach (most_bits: 2 to the
47 vectors of a label), so a bucket's size does not follow the label's. Buckets carry codes, factors and coordinates
rounded to a byte, no vectors.

In a bucket, <code, other> / factor estimates the cosine. Its error stays below a multiple of
sqrt((1 - factor^2) / factor^2 / (dimensions - 1) / rotations): where the upper bound stays below the threshold, for
either vector's code, the pair is done with. The others need exact recomputation. Pairs of classes with few such
partners are written as pairs. Classes with many are tied to families instead, which are compared exactly in tiles, so
that no row is made for each pair of a dense group. What remains quadratic is the number of links that the dense group
has itself, which the result counts.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without label, link with
nothing and are components of their own; vectors of different length never link; equal vectors of one label link; rows of
equal vec_id share a component, whatever their vectors and labels, and each counts its own links; a null vec_id has links
but never names a component and isn't kept; an empty table gives an empty one. Other columns are not read.

All cosines come from one formula: products added in the order of coordinates, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.graph import components
from loomspan.llm.vectors import matrix, usable
from loomspan.session import durable


@dataclass(frozen=True)
class NearVectorOptions:
    similar: float = 0.93
    missed: float = 1e-4  #: probability that a pair just at the threshold shares no bucket
    bucket: int = 128  #: classes that a bucket of a label without near copies should hold
    most_bits: int = 40
    rotations: int = 2  #: codes of a class
    wide: float = 4.0  #: width of the confidence bounds, in units of the estimate's error
    partners: int = 32  #: possible partners in a bucket beyond which a class is compared in a family
    tile: int = 512
    seed: int = 29


def bands_of(o: NearVectorOptions) -> list[int]:
    """By number of bits: how many bands a label needs."""
    alike = 1 - math.acos(o.similar) / math.pi
    return [1] + [math.ceil(math.log(o.missed) / math.log(1 - alike**b)) for b in range(1, o.most_bits + 1)]


def rotation(dim: int, number: int, seed: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(classes: DataFrame, o: NearVectorOptions) -> DataFrame:
    """classes (node, label, dim, x, bits) with code, factors, rounded coordinates and the keys of its bands."""
    bands = bands_of(o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}

        def turned(unit: np.ndarray, number: int) -> np.ndarray:
            key = unit.shape[1], number
            if key not in known:
                known[key] = rotation(*key, o.seed)
            return unit @ known[key]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims, bits = (table.column(c).to_numpy() for c in ("dim", "bits"))
            for d, b in sorted(set(zip(dims.tolist(), bits.tolist(), strict=True))):
                part = table.filter(pa.array((dims == d) & (bits == b)))
                x = matrix(part.column("x"))
                x = x / np.abs(x).max(1)[:, None]
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                codes, factors = [], []
                for r in range(o.rotations):
                    t = turned(unit, r)
                    codes.append(t > 0)
                    factors.append(np.abs(t).sum(1) / math.sqrt(d))
                signs = [np.zeros((len(x), 0), bool)]
                for r in range(-(-bands[b] * b // d)):
                    signs.append(turned(unit, o.rotations + r) > 0)
                signs = np.concatenate(signs, 1)[:, : bands[b] * b].reshape(len(x), bands[b], b)
                keys = np.arange(bands[b], dtype=np.int64) * (1 << b) + signs @ (1 << np.arange(b, dtype=np.int64))
                scale = np.abs(unit).max(1)
                rounded = np.rint(unit / scale[:, None] * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").combine_chunks(),
                        part.column("label").combine_chunks(),
                        part.column("dim").combine_chunks(),
                        pa.array([c.tobytes() for c in np.packbits(np.stack(codes, 1), axis=2)], pa.binary()),
                        pa.array(list(np.stack(factors, 1).astype(np.float32)), pa.list_(pa.float32())),
                        pa.array([c.tobytes() for c in rounded], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    ["node", "label", "dim", "code", "factors", "rounded", "keys"],
                )

    return classes.select("node", "label", "dim", "bits", "x").mapInArrow(run, "node long, label string, dim int, code binary, factors array<float>, rounded binary, keys array<long>")


def tiles(members: DataFrame, keys: list[str], o: NearVectorOptions) -> DataFrame:
    """members dealt to the pairs of tiles (low, high) of their group, so that no task holds a whole group.

    Sizes are partial sums that are written, so the join's sides are plain shuffles and a large group's rows are split
    over tasks; then rows are dealt by the pair of tiles, not by the group.
    """
    size = durable(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "sizes")
    count = F.ceil(F.col("held") / o.tile).cast("int")
    return (
        members.join(size, keys)
        .withColumn("tile", F.pmod(F.xxhash64("node", F.lit(3)), count).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        .drop("held", "other")
        .repartition(*keys, "low", "high")
    )


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, added up in the order of coordinates, as the SQL expression of pairs does."""

    def dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros(len(p))
        for k in range(p.shape[1]):
            total += p[:, k] * q[:, k]
        return total

    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix, the smallest node that it reaches."""
    top = np.arange(len(linked))
    while True:
        new = np.minimum(top, np.where(linked, top[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == top).all():
            return top
        top = new


def across(tile: np.ndarray) -> np.ndarray | bool:
    """Which pairs belong to a pair of tiles: those across, or all in a tile with itself."""
    return tile[:, None] != tile[None, :] if (tile != tile[0]).any() else ~np.eye(len(tile), dtype=bool)


def possible(coded: DataFrame, o: NearVectorOptions) -> DataFrame:
    """(a, b, family): pairs of nodes that may link; or, where family is set, nodes to be compared in one family."""
    rows = coded.withColumn("key", F.explode("keys")).drop("keys")
    dealt = tiles(rows, ["label", "dim", "key"], o)

    def run(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        node, tile = table.column("node").to_numpy(), table.column("tile").to_numpy()
        n = len(node)
        factors = matrix(table.column("factors"), np.float32)
        packed = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, o.rotations, -1)
        signs = np.unpackbits(packed, axis=2, count=d).astype(np.float32) * 2 - 1
        unit = np.frombuffer(b"".join(table.column("rounded").to_pylist()), np.int8).reshape(n, d).astype(np.float32)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        guess = np.zeros((n, n), np.float32)
        spread = np.zeros(n, np.float32)
        for r in range(o.rotations):
            turned = unit @ rotation(d, r, o.seed).astype(np.float32)
            guess += signs[:, r] @ turned.T / math.sqrt(d) / factors[:, r : r + 1] / o.rotations
            spread += (1 - factors[:, r] ** 2).clip(0) / factors[:, r] ** 2 / o.rotations
        error = o.wide * np.sqrt(spread / max(d - 1, 1e-9) / o.rotations)
        upper = guess + error[:, None] >= o.similar - 0.02  # coordinates are rounded
        may = upper & upper.T & across(tile) if d > 1 else np.ones((n, n), bool) & across(tile)
        dense = may.sum(1) > o.partners
        tied = may & (dense[:, None] | dense[None, :])
        top = forest(tied) if tied.any() else np.arange(n)
        at = np.flatnonzero(top != np.arange(n))
        a, b = np.nonzero(np.triu(may & ~tied))
        return pa.table({"a": np.concatenate([node[a], node[at]]), "b": np.concatenate([node[b], node[top[at]]]), "family": np.arange(len(a) + len(at)) >= len(a)})

    found = dealt.groupBy("label", "dim", "key", "low", "high").applyInArrow(run, "a long, b long, family boolean")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "family").distinct()


def compare_families(members: DataFrame, o: NearVectorOptions) -> DataFrame:
    """(a, b, w): w links of node a (b null), and a forest of links (w 0). members: family, node, x, n."""
    dealt = tiles(members, ["family"], o)

    def run(table: pa.Table) -> pa.Table:
        node, tile, n = (table.column(c).to_numpy() for c in ("node", "tile", "n"))
        x = matrix(table.column("x"))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        near = unit @ unit.T
        good = near >= o.similar
        i, j = np.nonzero(np.abs(near - o.similar) < 1e-9)  # where rounding decides
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good[p, q] = cosines(x[p], x[q]) >= o.similar
        good &= across(tile)
        w = good @ n
        top = forest(good)
        at, has = np.flatnonzero(top != np.arange(len(top))), np.flatnonzero(w)
        return pa.table({"a": np.concatenate([node[has], node[at]]), "b": pa.array([None] * len(has) + node[top[at]].tolist(), pa.int64()), "w": np.concatenate([w[has], np.zeros(len(at), np.int64)])})

    return dealt.groupBy("family", "low", "high").applyInArrow(run, "a long, b long, w long")


def near_vectors(vectors: DataFrame, options: NearVectorOptions = NearVectorOptions()) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors; see the module's text."""
    o = options
    x = F.col("embedding").cast("array<double>")
    able = usable(F.col("embedding")) & F.exists(x, lambda v: v != 0) & F.col("label").isNotNull()
    # zeros of either sign are one coordinate
    x = F.transform(x, lambda v: v + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(able, x).alias("x"))
    rows = rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("label", "x")))
    classes = rows.where("node is not null").groupBy("node", "label", "x").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = durable(classes.withColumn("dim", F.size("x")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("held"))
    bits = F.least(F.lit(o.most_bits), F.greatest(F.lit(0), F.ceil(F.log2(F.col("held") / o.bucket)))).cast("int")
    coded = durable(encode(classes.join(sizes.select("label", "dim", bits.alias("bits")), ["label", "dim"]), o), "codes")
    maybe = durable(possible(coded, o), "maybe")
    families = components(maybe.where("family").select("a", "b"))
    families = durable(families.select("node", F.col("component").alias("family")), "families")
    of = [families.select(F.col("node").alias(e), F.col("family").alias(f"family_{e}")) for e in ("a", "b")]
    pairs = maybe.where("not family").select("a", "b").join(of[0], "a", "left").join(of[1], "b", "left").where("family_a is null or family_b is null or family_a <> family_b")
    ends = [classes.select(F.col("node").alias(e), F.col("x").alias(f"x_{e}"), F.col("n").alias(f"n_{e}"), "dim", "label") for e in ("a", "b")]
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("x_a", "x_b") / (F.sqrt(dot("x_a", "x_a")) * F.sqrt(dot("x_b", "x_b")))
    exact = pairs.select("a", "b").join(ends[0].drop("dim", "label"), "a").join(ends[1].drop("dim", "label"), "b").where(cosine >= o.similar)
    exact = durable(exact.select("a", "b", "n_a", "n_b"), "exact")
    dense = durable(compare_families(families.join(classes.select("node", "x", "n"), "node"), o), "dense")
    degrees = (
        exact.select(F.col("a").alias("node"), F.col("n_b").alias("w"))
        .union(exact.select("b", "n_a"))
        .union(dense.where("w > 0").select("a", "w"))
        .groupBy("node")
        .agg(F.sum("w").alias("w"))
    )
    # rows of one vec_id with different vectors: their classes are one
    held = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("node").alias("n"), F.count(F.lit(1)).alias("all"))
    held = durable(held.where("a < z or (n > 0 and n < all)").select("vec_id", "a"), "several")
    own = rows.where("node is not null").select("vec_id", F.col("node").alias("b")).join(held, "vec_id").where("a <> b").select("a", "b")
    found = durable(components(exact.select("a", "b").union(dense.where("b is not null").select("a", "b")).union(own)), "found")
    placed = classes.select("node", "first", "n").join(found, "node", "left").join(degrees, "node", "left")
    placed = durable(placed.select("node", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("links")), "placed")
    names = durable(placed.groupBy("component").agg(F.min("first").alias("component_id")), "names")
    placed = durable(placed.join(names, "component").select("node", "links", "component_id"), "named")
    tied = held.join(placed.select(F.col("node").alias("a"), F.col("component_id").alias("tied")), "a").select("vec_id", "tied")
    out = rows.select("vec_id", "node").join(placed, "node", "left").join(tied, "vec_id", "left")
    component = F.when(F.col("vec_id").isNotNull() | F.col("node").isNotNull(), F.coalesce("tied", "component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
