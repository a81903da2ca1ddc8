"""Sessions of a stream (an extension): merged spans and sentences, given out once they can't change any more.

Rows may come in any order within the watermark's delay. A row is settled when the watermark has passed its start, as
no earlier row can come then; settled rows are taken in order, as the batch operators take them. Rows not yet
settled wait in a list state, and what the settled ones have made so far, one session a key, is a value state. A session is given
out when a settled row begins another, or when the watermark passes the time up to which it could grow.

The query needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Row = tuple


@dataclass(frozen=True)
class Fold:
    """How settled rows make sessions. The first two columns of rows and of sessions are start and end, in seconds."""

    rows: str  #: schema of a row's columns
    session: str  #: schema of a session's state
    out: str  #: schema of what is given out
    begin: Callable[[Row], Row]
    joins: Callable[[Row, Row], bool]  #: whether a row belongs to the session before it
    add: Callable[[Row, Row], Row]
    until: Callable[[Row], float]  #: a row that starts then or later can't join the session any more
    result: Callable[[Row], Row]


class Sessions(StatefulProcessor):
    """The sessions of one key."""

    def __init__(self, key: str, fold: Fold) -> None:
        self.key, self.fold = key, fold
        names = lambda schema: [f.strip().split(" ")[0] for f in schema.split(",")]
        self.columns, self.given = names(fold.rows), [key, *names(fold.out)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fold.rows)
        self.session = handle.getValueState("session", self.fold.session)

    def _settle(self, key: Any, new: list[Row], watermark: int, fired: bool) -> Iterator[pd.DataFrame]:
        """Each look at the state is a message to the JVM, which costs more than the fold: only those that are needed are sent.

        A key with state has one timer, a key without none. One that has fired is deleted by the engine.
        """
        fold = self.fold
        waits, open_ = fired or self.waiting.exists(), self.session.exists()
        before = [tuple(r) for r in self.waiting.get()] if waits else []
        rows = sorted([*before, *new], key=lambda r: tuple((v is not None, v) for v in r))
        now = watermark / 1000
        settled = [r for r in rows if r[0] < now]
        rest = rows[len(settled) :]
        session, done = (tuple(self.session.get()) if open_ else None), []
        for row in settled:
            if session is not None and fold.joins(session, row):
                session = fold.add(session, row)
            else:
                if session is not None:
                    done.append(fold.result(session))
                session = fold.begin(row)
        if session is not None and fold.until(session) <= now:
            done.append(fold.result(session))
            session = None
        if rest and rest != before:
            self.waiting.put(rest)
        elif before and not rest:
            self.waiting.clear()
        if session is not None and (settled or not open_):
            self.session.update(session)
        elif session is None and open_:
            self.session.clear()
        if not fired and (before or open_):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        due = min([r[0] for r in rest[:1]] + ([fold.until(session)] if session is not None else []), default=None)
        if due is not None:
            self.handle.registerTimer(max(int(due * 1000) + 1, watermark + 1))
        if done:
            yield pd.DataFrame([(key, *d) for d in done], columns=self.given)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(None if v != v else v for v in r) for part in rows for r in zip(*(part[c].tolist() for c in self.columns), strict=True)]
        yield from self._settle(key[0], new, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settle(key[0], [], timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, key: str, fold: Fold, late: str) -> DataFrame:
    """(key, fold.out): the sessions of a stream of rows (key, fold.rows), whose start is a time of the stream in seconds.

    Rows without start or end are left out, and so are rows that come later than the delay.
    """
    names = [f.strip().split(" ")[0] for f in fold.rows.split(",")]
    timed = rows.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()).select(key, *names, F.timestamp_seconds(names[0]).alias("_at")).withWatermark("_at", late)
    kind = rows.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(Sessions(key, fold), f"`{key}` {kind}, {fold.out}", outputMode="Append", timeMode="EventTime")


def merged(spans: DataFrame, gap: float, late: str = "10 minutes", key: str = "media") -> DataFrame:
    """(key, start, end, n): spans.merge_spans(gap=gap) of a stream of spans (key, start, end)."""
    fold = Fold(
        "start double, end double", "start double, end double, n long", "start double, end double, n long",
        lambda r: (r[0], r[1], 1), lambda s, r: r[0] - s[1] < gap, lambda s, r: (s[0], max(s[1], r[1]), s[2] + 1), lambda s: s[1] + gap, lambda s: s,
    )
    return sessions(spans, key, fold, late)


def sentences(words: DataFrame, pause: float, late: str = "10 minutes", ends: str = ".!?…", key: str = "media") -> DataFrame:
    """(key, start, end, text, n): lines.sentences of a stream of words (key, start, end, text).

    A sentence closes behind a word that ends with one of `ends`, or where no word follows within the pause. Null texts
    count as empty. Of words with equal start and end the smaller text comes first.
    """
    closed = lambda text: bool(text) and text[-1] in ends
    fold = Fold(
        "start double, end double, text string", "start double, end double, text string, n long, closed boolean", "start double, end double, text string, n long",
        lambda r: (r[0], r[1], r[2] or "", 1, closed(r[2])),
        lambda s, r: not s[4] and r[0] - s[1] < pause,
        lambda s, r: (s[0], r[1], f"{s[2]} {r[2] or ''}", s[3] + 1, closed(r[2])),
        lambda s: float("-inf") if s[4] else s[1] + pause,
        lambda s: s[:4],
    )
    return sessions(words, key, fold, late)
