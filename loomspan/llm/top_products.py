"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length: each task gets a block of candidates, sorted by length and cut into buckets, and a block
of queries. A query's k-th best score so far (first found among the longest vectors of all, later raised by each bucket)
divided by its own length and by the longest length in the bucket is the cosine that a vector of the bucket has to reach.
Over 1, nothing in the bucket can reach it, nor in any later one. A high local threshold makes coordinates prune: in its
largest coordinates, a vector of such a cosine lies in a narrow range around the query. A low one prunes by length
alone: a prefix of the bucket is long enough. The products of what is left are computed exactly.

The queries are a stated set. They are dealt to blocks by the length that a candidate needs, and a query goes only to the
blocks of candidates whose longest vector has it; a block of candidates moves once for each block of queries that comes to
it, and only the k best rows of a query and a block of candidates leave a task. Where lengths tell little, each block of
queries meets each block of candidates, so rows that move grow as queries times candidates divided by the size of a block.

Vectors are integers here: floor(scale * x). Products are exact: in double precision while lengths allow it (below 2 to
the 53), else in 64-bit integers.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different length
are not compared; ties go to the smaller id, null ids last; rows of equal id are rows of their own, and a query's own row
is left out by row, not by id; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.vectors import matrix, usable
from loomspan.session import durable


@dataclass(frozen=True)
class SearchOptions:
    k: int = 20
    scale: float = 64
    longest: int = 2048  #: long vectors among which first thresholds are found, about
    queries: int = 4096  #: queries of a block, about
    candidates: int = 16384  #: candidates of a block, about
    bucket: int = 1024
    focus: int = 3  #: coordinates that prune
    steep: float = 0.6  #: local thresholds from which coordinates prune


NONE = np.iinfo(np.int64).min


@dataclass
class Block:
    """Integer vectors of one task: row numbers, ids, coordinates and lengths."""

    row: np.ndarray
    id: np.ndarray
    x: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        x = matrix(table.column("x"))
        ids = table.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max)
        return cls(table.column("row").to_numpy(), ids.to_numpy(), x, np.sqrt((x * x).sum(1)))

    def take(self, at: np.ndarray | slice) -> Block:
        return Block(self.row[at], self.id[at], self.x[at], self.norm[at])


def products(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    return (q @ c.T).astype(np.int64) if exact else q.astype(np.int64) @ c.astype(np.int64).T


def along(unit: np.ndarray, q: np.ndarray, coordinates: np.ndarray, least: float) -> np.ndarray:
    """Places of the unit vectors that may have a cosine of least with q, seen along some coordinates.

    The angle to a coordinate's axis differs from the query's by no more than the angle between the two vectors.
    """
    ok = np.ones(len(unit), bool)
    angle = np.arccos(min(1.0, least))
    for f in coordinates.tolist():
        own = np.arccos(np.clip(q[f], -1, 1))
        ok &= (unit[:, f] >= np.cos(min(np.pi, own + angle)) - 1e-9) & (unit[:, f] <= np.cos(max(0.0, own - angle)) + 1e-9)
    return np.flatnonzero(ok)


def search_block(q: Block, least: np.ndarray, c: Block, o: SearchOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, score) of the k best candidates of each query that reach its threshold."""
    order = np.argsort(-c.norm, kind="stable")
    c = c.take(order)
    exact = float(q.norm.max(initial=0)) * float(c.norm.max(initial=0)) < 2.0**52
    bound = least.copy()
    who, what, score = (np.zeros(0, np.int64) for _ in range(3))
    length = np.maximum(q.norm, 1e-300)
    unit_q = q.x / length[:, None]
    focus = np.argsort(-np.abs(unit_q), 1)[:, : o.focus]
    for low in range(0, len(c.row), o.bucket):
        part = c.take(slice(low, low + o.bucket))
        # the length that a vector needs; the margin keeps rounding from pruning what just reaches a threshold
        need = np.where(bound > 0, bound / length * (1 - 1e-9), -1.0)
        local = need / max(part.norm[0], 1e-300)
        live = local <= 1
        if not live.any():
            break  # later buckets are shorter still
        found = []
        flat = np.flatnonzero(live & (local < o.steep))
        if len(flat):
            reach = int((part.norm >= need[flat].min()).sum())
            s = products(q.x[flat], part.x[:reach], exact)
            a, b = np.nonzero(s >= bound[flat][:, None])
            found.append((flat[a], b, s[a, b]))
        steep = np.flatnonzero(live & (local >= o.steep))
        if len(steep):
            unit = part.x / np.maximum(part.norm, 1e-300)[:, None]
        for i in steep.tolist():
            at = along(unit, unit_q[i], focus[i], local[i])
            s = products(q.x[i : i + 1], part.x[at], exact)[0]
            good = s >= bound[i]
            found.append((np.full(int(good.sum()), i), at[good], s[good]))
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
        other = part.row[b] != q.row[a]
        who, what, score = np.concatenate([who, a[other]]), np.concatenate([what, b[other] + low]), np.concatenate([score, s[other]])
        best = np.lexsort((c.id[what], -score, who))
        rank = np.arange(len(best)) - np.searchsorted(who[best], who[best])
        full = best[rank == o.k - 1]
        bound[who[full]] = np.maximum(bound[who[full]], score[full])
        keep = best[rank < o.k]
        who, what, score = who[keep], what[keep], score[keep]
    return who, order[what], score


def _grid(queries: DataFrame, candidates: DataFrame, o: SearchOptions) -> DataFrame:
    """(row, id, score, other): the k best of each query in each block of candidates.

    queries: row, id, x, least, dim, q_block, c_blocks; candidates: row, id, x, dim, c_block.
    """
    keys = ["dim", "q_block", "c_block"]
    queries = queries.withColumn("c_block", F.explode(F.col("c_blocks")))
    candidates = candidates.join(durable(queries.select(*keys).distinct(), "meetings"), ["dim", "c_block"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()))})
        right = right.rename_columns([*keys, "row", "id", "x"])
        q, c = Block.of(left), Block.of(right)
        least = left.column("least").combine_chunks().fill_null(NONE).to_numpy()
        a, b, s = search_block(q, least, c, o)
        return pa.table({"row": q.row[a], "query_id": left.column("id").combine_chunks().take(pa.array(a)), "id": right.column("id").combine_chunks().take(pa.array(b)), "score": s})

    left = queries.select(*keys, "row", "id", "x", "least").groupBy(*keys)
    right = candidates.select(*(F.col(c).alias(f"c_{c}") for c in (*keys, "row", "id", "x"))).groupBy(*(f"c_{c}" for c in keys))
    return left.cogroup(right).applyInArrow(run, "row long, query_id long, id long, score long")


def top_products(vectors: DataFrame, is_query: Column, options: SearchOptions = SearchOptions(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of the highest inner product with each query, see the module's text."""
    o = options
    rows = vectors.where(usable(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * o.scale)).alias("x"),
    )
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = durable(rows.withColumns({"norm": norm, "dim": F.size("x")}), "vectors")
    # lengths that cut the rows of a dimension into equal parts, and those that only the longest rows reach
    steps = [i / 64 for i in range(1, 64)]
    ends = [1 - 2.0**-i for i in range(40)]
    of = rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.lit(1), F.ceil(F.count_if("query") / o.queries)).cast("int").alias("q_blocks"),
        F.percentile_approx("norm", F.lit(steps), F.lit(10000)).alias("steps"),
        F.percentile_approx("norm", F.lit(ends), F.lit(10000)).alias("ends"),
    )
    long_ones = F.get("ends", F.least(F.lit(len(ends) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / o.longest)))).cast("int"))
    parts = F.ceil(F.col("n") / o.candidates)
    part = F.floor(F.size(F.filter("steps", lambda c: c <= F.col("norm"))) * F.least(parts, F.lit(64)) / 64).cast("int")
    of = of.withColumn("far", long_ones).drop("ends")
    rows = rows.join(of, "dim").withColumns({"part": part, "first": F.col("norm") >= F.col("far")}).drop("steps")
    # lengths that many rows share: parts are cut again by a hash of the row
    counts = durable(rows.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("held"), F.max("norm").alias("longest")), "parts")
    cut = counts.select("dim", "part", F.ceil(F.col("held") / o.candidates).cast("int").alias("cuts"), "longest")
    names = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct((F.col("part").cast("long") * (1 << 32) + i).alias("c_block"), F.col("longest").alias("longest")))
    blocks = durable(cut.groupBy("dim").agg(F.flatten(F.collect_list(names)).alias("c_blocks")), "blocks")
    shares = rows.where("first").groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / o.longest).alias("share"))
    rows = rows.join(cut.drop("longest"), ["dim", "part"]).withColumn("c_block", F.col("part").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("cuts")))
    asked = rows.where("query").select("row", "id", "x", "norm", "dim", "q_blocks")
    hashed = F.pmod(F.xxhash64("row", F.lit(1)), F.col("q_blocks")).cast("int")
    leaders = rows.where("first").join(shares, "dim").where("pmod(xxhash64(row, 2), share) = 0").select("row", "id", "x", "dim", F.lit(0).cast("long").alias("c_block"))
    tried = _grid(asked.withColumns({"q_block": hashed, "least": F.lit(None).cast("long"), "c_blocks": F.array(F.lit(0).cast("long"))}), leaders, o)
    least = durable(tried.groupBy("row").agg(F.when(F.count(F.lit(1)) >= o.k, F.min("score")).alias("least")), "least")
    # queries whose candidates need about the same length are a block; the margin keeps rounding from pruning what just reaches
    need = F.when(F.col("least") > 0, F.try_divide(F.col("least").cast("double"), F.col("norm")) * (1 - 1e-9)).otherwise(F.lit(-1.0))
    asked = durable(asked.join(least, "row", "left").withColumn("need", need), "asked")
    needs = asked.groupBy("dim").agg(F.percentile_approx("need", F.lit(steps), F.lit(10000)).alias("needs"))
    dealt = F.least("q_blocks", F.lit(64))
    near = F.floor(F.size(F.filter("needs", lambda c: c <= F.col("need"))) * dealt / 64)
    again = F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("q_blocks") / dealt))
    reached = F.transform(F.filter("c_blocks", lambda b: b["longest"] >= F.col("need")), lambda b: b["c_block"])
    queries = asked.join(needs, "dim").join(blocks, "dim").select("row", "id", "x", "dim", "least", (near + dealt * again).cast("int").alias("q_block"), reached.alias("c_blocks"))
    candidates = rows.select("row", "id", "x", "dim", "c_block")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (
        _grid(queries, candidates, o)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= o.k)
        .select("query_id", "rank", F.col("id").alias(id), "score")
    )
