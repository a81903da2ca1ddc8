"""Shards of a hierarchical weighted hash tree, and gapless slots.

A row descends from the root to a region, a rack and a shard. At each level every child draws -ln(u) / weight, where u is
a hash of the key and the child, and the lowest draw wins: a child wins in proportion to its weight. A child's draw does
not depend on its siblings, so a change of weights moves rows only into a child whose weight grows or out of one whose
weight shrinks; rows elsewhere stay, and so do rows inside a subtree that does not change. A shard that is added as a
region of its own takes rows only into itself: the law here is `key`, key and shard count decide.

All of it are DataFrame functions. Slots are counted in two steps so that no task holds a shard: rows are numbered within
the (shard, input partition) they came with, after sums over these few counts.

Defined results: a null text has no bytes and the CRC-32 of an empty one; null keys are one key, and equal keys share a
shard; rows of equal key get slots of their own; an empty table gives an empty one. Columns other than the key, the text
and those asked for are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import durable


@dataclass(frozen=True)
class Tree:
    """regions, their racks, and these racks' shards with weights. Shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def regular(cls, regions: int, racks: int, shards: int, weight: float = 1.0) -> Tree:
        return cls((((weight,) * shards,) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def draw(key: Column, level: str, child: int, weight: float) -> Column:
    """-ln(u) / weight, where u is in (0, 1] by a hash of the key, the level and the child's number on it."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level} {child}")), 11).cast("double") + 1) / float(1 << 53)
    return -F.ln(u) / weight


def lowest(key: Column, level: str, children: list[tuple[int, float]]) -> Column:
    """The number of the child with the lowest draw. children: (number, weight); a weight of 0 takes nothing."""
    able = [(n, w) for n, w in children if w > 0]
    if len(able) == 1:
        return F.lit(able[0][0])
    return F.least(*(F.struct(draw(key, level, n, w).alias("draw"), F.lit(n).alias("child")) for n, w in able))["child"]


def choose(number: Column, ways: list[tuple[int, Column]]) -> Column:
    """The way of that number."""
    out = None
    for n, way in ways:
        out = F.when(number == n, way) if out is None else out.when(number == n, way)
    return out


def descend(df: DataFrame, tree: Tree, key: Column, region: str = "region", rack: str = "rack", shard: str = "shard") -> DataFrame:
    """df with the region, rack and shard of each row. Racks and shards are numbered over the whole tree."""
    racks, shards, at_rack, at_shard = {}, {}, 0, 0
    for r, members in enumerate(tree.regions):
        racks[r] = []
        for weights in members:
            racks[r].append((at_rack, sum(weights)))
            shards[at_rack] = [(at_shard + i, w) for i, w in enumerate(weights)]
            at_rack, at_shard = at_rack + 1, at_shard + len(weights)
    live = {r: sum(w for _, w in racks[r]) for r in racks}
    df = df.withColumn(region, lowest(key, "region", list(live.items())))
    df = df.withColumn(rack, choose(F.col(region), [(r, lowest(key, "rack", racks[r])) for r in racks if live[r] > 0]))
    return df.withColumn(shard, choose(F.col(rack), [(k, lowest(key, "shard", s)) for k, s in shards.items() if sum(w for _, w in s) > 0]))


def numbered(df: DataFrame, group: str, slot: str = "slot") -> DataFrame:
    """df with a number from 0 without gaps in each group, for groups of any size.

    Rows are written once with an id that tells their partition; each (group, partition) starts where the sum of the
    group's counts in the partitions before ends.
    """
    df = durable(df.withColumn("_row", F.monotonically_increasing_id()), "rows").withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_row")) - 1
    return df.withColumn("_inside", inside).join(starts, [group, "_part"]).withColumn(slot, F.col("_start") + F.col("_inside")).drop("_row", "_part", "_start", "_inside")


def sharded(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, region, rack, shard, slot, grown_shard): where each document goes, now and with one more shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(rows, tree, F.col(key))
    rows = descend(rows, tree.grown(), F.col(key), "grown_region", "grown_rack", "grown_shard").drop("grown_region", "grown_rack")
    return numbered(rows, "shard")


def write_shards(docs: DataFrame, tree: Tree, path: str, key: str = "doc_id", files: int = 1) -> None:
    """Write docs as Parquet in one folder for each shard, dealt to so many files a shard."""
    placed = descend(docs, tree, F.col(key))
    placed.repartition(tree.shards * files, "shard", F.pmod(F.xxhash64(key, F.lit("file")), F.lit(files))).drop("region", "rack").write.partitionBy("shard").parquet(path)
