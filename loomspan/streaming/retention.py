"""Retention of a stream's entries by state (an extension): newest first within a limit of size, and not older than an age.

For each key a list state holds the entries that are kept, and a value state the newest entry that has gone. The
order of time is all that decides, so whatever is older than an entry that has gone goes as well, even if it comes later;
the result after each micro-batch is that of ranking.keep_newest and the age rule over all rows so far.

The query needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ENTRY = "at double, id string, size long"


class Retention(StatefulProcessor):
    """The entries of one key. Newer entries are those of larger at, then larger id."""

    def __init__(self, key: str, limit: int, age: float) -> None:
        self.key, self.limit, self.age = key, limit, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", ENTRY)
        self.gone = handle.getValueState("gone", "at double, id string")

    def _sweep(self, key: Any, new: list[tuple], now: float) -> pd.DataFrame:
        before = {(at, i): size for at, i, size in map(tuple, self.kept.get())}
        cut = tuple(self.gone.get()) if self.gone.exists() else (float("-inf"), "")
        fresh = {(at, i): size for at, i, size in new}
        entries = sorted((before | fresh).items(), reverse=True)
        now = max([now, *(e[0][0] for e in entries[:1])])
        total, stays = 0, {}
        for place, size in entries:
            total += size
            if total > self.limit or place <= cut or place[0] < now - self.age:
                cut = max(cut, place)
                break
            stays[place] = size
        self.kept.clear()
        if stays:
            self.kept.put([(at, i, size) for (at, i), size in stays.items()])
            oldest = min(stays)[0]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(int((oldest + self.age) * 1000) + 1)
        if cut[0] > float("-inf"):
            self.gone.update(cut)
        log = [(key, at, i, size, (at, i) in stays) for (at, i), size in entries if ((at, i) in stays) != ((at, i) in before) or (at, i) not in stays]
        return pd.DataFrame(log, columns=[self.key, "at", "id", "size", "kept"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(float(at), str(i), int(size)) for part in rows for at, i, size in part[["at", "id", "size"]].itertuples(index=False)]
        yield self._sweep(key[0], new, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._sweep(key[0], [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def retained(entries: DataFrame, key: str, limit: int, age: float, late: str = "1 hour") -> DataFrame:
    """(key, at, id, size, kept): the changes of what is kept of a stream of entries (key, at in seconds, id, size).

    A row with kept true is an entry that stays for now, one with false an entry that has gone, or never stayed. An entry
    goes when it and the newer ones of its key are larger than limit together, or when it is more than age seconds older than
    the newest of its key, or than the watermark. An id at one time is one entry; its last size counts. Entries without time, id
    or size are left out, and so are those that come later than the delay.
    """
    known = entries.where("at IS NOT NULL AND id IS NOT NULL AND size IS NOT NULL")
    timed = known.select(key, F.col("at").cast("double").alias("at"), F.col("id").cast("string").alias("id"), F.col("size").cast("long").alias("size"), F.timestamp_seconds("at").alias("_at")).withWatermark("_at", late)
    kind = entries.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(Retention(key, limit, age), f"`{key}` {kind}, {ENTRY}, kept boolean", outputMode="Append", timeMode="EventTime")
