"""Ranking and selecting: stable order, the best per group, the first usable, and what fits a limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], *order: Column, most: int | None = None, rank: str = "rank") -> DataFrame:
    """df with a rank in its keys by an order that has to be total; with most, only so many of each."""
    rows = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where(F.col(rank) <= most) if most else rows


def first_usable(df: DataFrame, keys: Sequence[str], usable: Column, *order: str) -> DataFrame:
    """Of each group's usable rows the first: an aggregate, so that groups may be of any size."""
    rest = [c for c in df.columns if c not in keys]
    best = df.where(usable).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*")


def keep_newest(df: DataFrame, keys: Sequence[str], size: str, limit: int, *newest_first: Column) -> DataFrame:
    """Rows that stay when the oldest go until the sum of sizes is within a limit."""
    order = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= limit).drop("_sum")


def online_score(same_file: Column, similarity: Column, rate_apart: Column, downloads: Column) -> Column:
    popular = F.least(F.lit(5.0), F.log10(1 + downloads))
    return F.when(same_file, 40).otherwise(0) + similarity + F.when(rate_apart < 0.01, 5).otherwise(0) + popular


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, where the new one of a key replaces the old."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def distinct_in_order(df: DataFrame, keys: Sequence[str], value: str, order: str, out: str = "values") -> DataFrame:
    """(keys, out): each group's distinct values in the order in which they come first."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("_v"))))
    return first.groupBy(*keys).agg(F.transform(rows, lambda x: x["_v"]).alias(out))


def shared_times(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, both): the size of the multiset intersection of two tables' values; groups without one are left out."""
    both = left.select(*keys, value).intersectAll(right.select(*keys, value))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("both"))


def unknown(names: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct rows that are not among the known ones."""
    return names.subtract(known)


def rare_values(rows: DataFrame, id: str, values: Column, any_value: Column) -> DataFrame:
    """(id, rare): of each row's distinct values (an array) how many stand in two rows at most; rows without any value (any_value) are left out.

    The rows of a rare value are the smallest and the largest id that it has, so an aggregate finds them and no row is joined.
    """
    each = rows.select(F.struct(id).alias("_id"), F.explode_outer(values).alias("_v")).where("_v IS NOT NULL")
    rare = each.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_n <= 2")
    rare = rare.select(F.explode(F.when(F.col("_n") == 1, F.array("_a")).otherwise(F.array("_a", "_b"))).alias("_id")).select(f"_id.{id}", F.lit(1).alias("_k"))
    return rows.where(any_value).select(id, F.lit(0).alias("_k")).unionAll(rare).groupBy(id).agg(F.sum("_k").alias("rare"))
