"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import discard, durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of links reaches. Nodes without links are not listed.

    Alternating large-star and small-star steps: each joins a node's smallest neighbour (an aggregate with partial
    sums, so that a node with very many links is no hot group) back to its links and points these at it. The number
    of links never grows, and the number of rounds follows the logarithm of the longest path. Every step is written
    to the shared folder and read from there by the join, so that both of its sides are plain shuffles: the links of a
    node with very many are then split over tasks by adaptive execution. Earlier steps' tables are deleted.

    Null ends and loops are left out; an empty table gives an empty table.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, state = _settle(edges)
    while state[0]:
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "low")
        large = durable(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        # small star: a node's smaller neighbours and itself move to the smallest
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(_ends()).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        old, (edges, now) = edges, _settle(small)
        discard(old, low, large, least)
        if now == state:
            break
        state = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def _ends() -> Column:
    return F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))


def _settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = durable(edges, "edges")
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return edges, (row[0], row[1])
