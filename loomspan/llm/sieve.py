"""A bitmap of fixed size that tells of most rows that their key is not in a table, so that only the others take part in a join.

Keys are hashed to 2 ** BITS places. The bitmap is made in Spark, 32,768 places a row, and holds 4 MB at most however many
keys there are, so it can be broadcast; with millions of keys it lets a few percent of the other rows through, and with
hundreds of millions it lets all through. The join itself, which decides, comes after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import durable

BITS = 25


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def bitmap(ids: DataFrame, key: str) -> DataFrame:
    """(_part, _bits): the places of all keys, written once."""
    place = _place(key)
    return durable(ids.groupBy(F.shiftright(place, 15).alias("_part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("_bits")), "bitmap")


def sieved(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """rows with _met: true where the key is among those of the bitmap and for some others, false for most others."""
    place = _place(key)
    byte = F.substr("_bits", F.shiftright(place.bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))
    met = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place.bitwiseAND(F.lit(7)).cast("int")) == 1
    found = rows.join(F.broadcast(bits), F.shiftright(place, 15) == F.col("_part"), "left")
    return found.withColumn("_met", F.coalesce(met, F.lit(False))).drop("_part", "_bits")
