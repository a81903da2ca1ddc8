"""Repair of damaged conversations: the cheapest edits that make the order of roles right.

The rows of a conversation, in the order of turns, become a sequence of the grammar (s?(ua)+)?: an optional system row,
then user and assistant in turns, or nothing. A forward Viterbi pass over four states (nothing yet, after system, after
user, after assistant) carries the cheapest (cost, audit) of each state; audit has one letter for each edit, and ties go
to the smaller string. After each row its layer is closed with inserts, two at most from any state: a third would come
back to a state already reached. Beside cost and audit a state carries the SHA-256 of the repaired text so far,
so one pass gives the digest too. Two ways to one state at one cost are never the beginning of each other (they
hold the same rows, so they would differ in inserts, which cost), so the smaller string stays the smaller one.

Rows come to the pass sorted within partitions of whole conversations and are read once, in a stream: a task holds a batch of rows
and the four audits, whose common beginning is set aside as it grows, and never a conversation. A digest of a whole
conversation is by its nature one sequential computation, so a conversation stays within one task.

Defined results: null roles and texts are one space, as are null ids and turns in the hash that damages rows; rows of one
turn are taken in the order of role and text; rows with a null conv_id are one conversation; a
conversation of which no row is left has zeros, an empty audit and the digest of an empty text; an empty table gives an
empty one; other columns are not used.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  #: costs; CUT_OFF is added where a truncated row stays
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}  #: what rows may be given or inserted as
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of rows after the damage that the CRC-32 of `conv_id:turn` modulo 20 tells.

    0 drops a row (it stays here, marked, so that its conversation is not forgotten), 1 empties its text, 2 takes `.`, `!` and `?` out
    of it, 3 repeats it, 4 makes its role user.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = (F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20).alias("kind")
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role, text, kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("_again")).drop("_again")


def _last_letter(text: str) -> Column:
    """The last character of a text that is no white space; empty without one."""
    return F.right(F.expr(f"trim(TRAILING '{''.join(f'\\u{ord(c):04x}' for c in SPACE)}' FROM {text})"), F.lit(1))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows with fault: the first that holds of blank, duplicate (role and text stood in an earlier row of the conversation), truncated; else null."""
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumns({"_last": _last_letter("text"), "_place": F.row_number().over(same)})
    fault = F.when(F.col("_last") == "", "blank").when(F.col("_place") > 1, "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).drop("_last", "_place")


class Repair:
    """The pass over one conversation's rows."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.shared: list[str] = []  # the beginning that all audits have, in parts
        self.ways: dict[int, tuple[int, str, object]] = {EMPTY: (0, "", hashlib.sha256())}
        self.role: str | None = None
        self.turns: tuple[int, int] | None = None
        self.n_turns = 0
        self._close()

    @staticmethod
    def _line(digest: object, before: int, line: str) -> object:
        digest = digest.copy()
        digest.update((line if before == EMPTY else "\n" + line).encode())
        return digest

    def _take(self, best: dict, way: tuple, state: int, to: int, cost: int, letter: str, line: str | None) -> None:
        """Offer best a way from a state on; line is hashed only once the way is chosen."""
        offer = (way[0] + cost, way[1] + letter)
        if to not in best or offer < best[to][:2]:
            best[to] = (*offer, way[2], state, line)

    def _settle(self, best: dict) -> None:
        self.ways = {to: (cost, audit, self._line(digest, state, line) if line is not None else digest) for to, (cost, audit, digest, state, line) in best.items()}

    def _close(self) -> None:
        """Inserts: to user from any state before one, then to assistant."""
        for to, initial in ((USER, "u"), (ASSISTANT, "a")):
            best = {s: (*w, s, None) for s, w in self.ways.items()}
            for state, way in self.ways.items():
                if NEXT.get((state, initial)) == to:
                    self._take(best, way, state, to, INSERT, "I", f"{ROLES[initial]}:")
            self._settle(best)

    def _forget(self) -> None:
        """Leave out ways that can't win any more, so that those that are left soon have a common beginning.

        What follows a way without user rows can follow one that ends with an assistant's as well, with a system row deleted.
        """
        cost = self.ways[ASSISTANT][0] if ASSISTANT in self.ways else None
        for state, more in ((EMPTY, DELETE), (SYSTEM, KEEP)):
            if cost is not None and state in self.ways and cost + more < self.ways[state][0]:
                del self.ways[state]

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.role is not None and self.role[:1] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.role = role
        if turn is not None:
            if self.turns is None or turn != self.turns[1]:
                self.n_turns += 1
            self.turns = (self.turns[0] if self.turns else turn, turn)
        best: dict = {}
        more = CUT_OFF if fault == "truncated" else 0
        for state, way in self.ways.items():
            self._take(best, way, state, state, DELETE, "D", None)
            if fault not in ("blank", "duplicate"):
                if (state, initial) in NEXT:
                    self._take(best, way, state, NEXT[state, initial], KEEP + more, "K", f"{role}:{text}")
                for to, name in ROLES.items():
                    if (state, to) in NEXT:
                        self._take(best, way, state, NEXT[state, to], REROLE + more, "R", f"{name}:{text}")
        self._settle(best)
        self._close()
        self._forget()
        if max(len(w[1]) for w in self.ways.values()) > 256:
            same = os.path.commonprefix([w[1] for w in self.ways.values()])
            if same:
                self.shared.append(same)
                self.ways = {s: (c, a[len(same) :], d) for s, (c, a, d) in self.ways.items()}

    def result(self) -> tuple:
        cost, audit, digest = min((self.ways[s] for s in (EMPTY, ASSISTANT) if s in self.ways), key=lambda w: w[:2])
        self.counts["cost"] = cost
        self.counts["gaps"] = self.turns[1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return (*(self.counts[c] for c in COUNTS), "".join(self.shared) + audit, digest.hexdigest())


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows: counts of faults, the cost and letters of its cheapest edits, and the digest of the repaired text.

    rows: conv_id, turn, role, text, dropped, fault, as with_faults(damaged(...)) gives them.
    """
    key = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", key), *(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []
        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or conv != now:
                    if open_:
                        out.append((now, *open_.result()))
                    now, open_ = conv, Repair()
                if not dropped:
                    open_.row(turn, role, text, fault)
            if len(out) > 1000:
                yield finish(out, arrow)
                out = []
        if open_:
            yield finish([*out, (now, *open_.result())], arrow)

    def finish(out: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
        types = [arrow, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)

    rows = rows.select("conv_id", "turn", "role", "text", "dropped", "fault").repartition("conv_id")
    return rows.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, schema)
