"""Encoding and decoding with the pieces of a merge-type (BPE) SentencePiece model, exactly as the library does.

An encoding is the one sequence of pieces that covers a text and in which every two neighbours are compatible: merging
the characters of both again gives the same two pieces. It is found by backtracking. Aho-Corasick gives the longest
piece that starts at each place; a piece is taken if it is compatible with the one before; if not, the next shorter
piece that starts there is tried, and if none is left, the piece before is given up and its end is marked in a bitfield
of failed positions, so that no position is left twice in vain. The work is linear in the text's length.

Pieces that merging never makes are left out when the model is loaded. A mark of a space never follows another
character in a piece, so a text is cut before each run of such marks, and what a cut yields is remembered.
Characters without a piece become their UTF-8 bytes.

Defined results: a null or empty text has no ids; decoding null gives an empty text; control ids stand for nothing; rows
that repeat are rows of their own; texts of any length are encoded whole; an empty table gives an empty one; an input
column with the name of a new one is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomspan.llm import text as T

MARK = "▁"  #: stands for a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
REMEMBERED = 1 << 18  #: cuts and pairs that a task remembers at most


@dataclass
class PieceModel:
    """The pieces of a model by id, with scores (higher: merged earlier) and kinds. Small, and sent to each task."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    _cuts: dict[str, bytes] = field(default_factory=dict, repr=False)
    _pairs: dict[tuple[str, str], bool] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "scores": self.scores, "kinds": self.kinds, "_cuts": {}, "_pairs": {}}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model on the driver. Raises ValueError where these rules would not give the library's results."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, trained = proto.normalizer_spec, proto.trainer_spec
        model = cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces])
        plain = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL]
        if (
            trained.model_type != 2
            or trained.treat_whitespace_as_suffix
            or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not (rules.add_dummy_prefix and rules.escape_whitespaces)
            or set(model.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}
            or BYTE not in model.kinds
            or any(MARK in p.lstrip(MARK) or len(p) > 1 and "\n" in p for p in plain)
            or {c for p in plain for c in p} - set(plain)
        ):
            raise ValueError("only merge-type models with byte fallback, identity normalisation and a leading space")
        return model

    @cached_property
    def _ids(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}

    @cached_property
    def _bytes(self) -> list[int]:
        found = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        return [found[b] for b in range(256)]

    @cached_property
    def _whole(self) -> set[str]:
        """Pieces that merging their own characters makes."""
        return {p for p in self._ids if len(p) == 1 or self.merged(p) == [p]}

    @cached_property
    def _shorter(self) -> dict[str, str | None]:
        """The longest piece that a piece begins with, other than itself."""
        return {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self._whole), None) for p in self._whole}

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self._whole:
            automaton.add_word(p)
        automaton.make_automaton()
        return automaton

    @cached_property
    def _known(self) -> set[str]:
        """Characters that are pieces."""
        return {p for p in self._ids if len(p) == 1}

    @cached_property
    def _cut(self) -> re.Pattern:
        """Cuts where no piece goes on: before marks, at line ends, and between letters and some punctuation.

        Spaces stand for marks here.
        """
        inside = {p[i : i + 2] for p in self._ids for i in range(len(p) - 1)}
        closing = "".join(c for c in ",.;:!?)" if not any(pair[1] == c and re.match(r"[^\W\d_]", pair) for pair in inside))
        word = f" *[^\\W\\d_]+(?=[{re.escape(closing)}])|" if closing else ""
        return re.compile(f"{word} *[^ \n]+| +|\n")

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text: always the neighbours whose piece has the highest score, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self._ids.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.scores[number] > best):
                    best, at = self.scores[number], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging two neighbours again keeps them; remembered in _pairs."""
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        fits = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return fits

    def split(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        n = len(text)
        longest = [0] * n
        for end, length in self._automaton.iter(text):
            longest[end - length + 1] = length
        pairs, compatible, shorter = self._pairs.get, self.compatible, self._shorter
        failed: bytearray | None = None  # one bit for each position, made when the first fails
        taken: list[str] = []
        last, at = "", 0
        piece = text[: longest[0]]
        while True:
            end = at + len(piece)
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs((last, piece)) if last else True
                if fits is None:
                    fits = compatible(last, piece)
                if fits:
                    taken.append(piece)
                    if end == n:
                        return taken
                    last, at, piece = piece, end, text[end : end + longest[end]]
                    continue
            piece = shorter[piece]
            while piece is None:  # nothing fits here: go back, and never come here again
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                back = taken.pop()
                at -= len(back)
                last = taken[-1] if taken else ""
                piece = shorter[back]

    def cut_ids(self, cut: str) -> bytes:
        """Ids of one cut as native 32-bit numbers."""
        plain, cut = cut, cut.replace(" ", MARK)
        number = self._ids.__getitem__
        if self._known.issuperset(cut):
            ids = list(map(number, self.split(cut)))
        else:
            ids = []
            for known, run in groupby(cut, self._known.__contains__):
                if known:
                    ids += map(number, self.split("".join(run)))
                else:
                    ids += [self._bytes[b] for b in "".join(run).encode()]
        out = array("i", ids).tobytes()
        if len(cut) <= 64:
            if len(self._cuts) >= REMEMBERED:
                self._cuts.clear()
            self._cuts[plain] = out
        return out

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, make = self._cuts.get, self.cut_ids
        cuts = self._cut.findall(" " + text.replace(MARK, " "))  # both are the same to the model
        return np.frombuffer(b"".join([known(c) or make(c) for c in cuts]), "i4")

    @cached_property
    def _surfaces(self) -> pa.Array:
        """The bytes that each id stands for, then the same for an id that begins a text (without the first space)."""
        inner, first = [], []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            if k == BYTE:
                raw = start = bytes([int(p[3:5], 16)])
            elif k == CONTROL:
                raw = start = b""
            elif k == UNKNOWN:
                raw = start = " ⁇ ".encode()
            else:
                raw, start = p.replace(MARK, " ").encode(), p.removeprefix(MARK).replace(MARK, " ").encode()
            inner.append(raw)
            first.append(start)
        return pa.array(inner + first, pa.binary())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids: the first space of a text goes, bytes that are no UTF-8 become U+FFFD each."""
        places = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)[places[0] : places[-1]]
        places = places - places[0]
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.pieces)):
            raise ValueError("ids outside the model")
        begins = places[:-1][places[1:] > places[:-1]]
        flat = flat.copy()
        flat[begins] += len(self.pieces)
        raw = self._surfaces.take(pa.array(flat)) if len(flat) else pa.array([], pa.binary())
        data, at = T.buffers(raw)
        out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at[places].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        try:
            return pc.cast(out, pa.string())
        except pa.ArrowInvalid:
            return pa.array([_repaired(x) for x in out.to_pylist()], pa.string())


def _repaired(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        parts, at = [], 0
        while at < len(raw):
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                parts.append(raw[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                parts.append("�")
                at += 1
        return "".join(parts)


def encode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of the ids of each whole text; with decoded, also one of the text that they stand for.

    Columns of these names are replaced. Texts are worked on one after the other, in pieces of a batch, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(ids, *([decoded] if decoded else []))
    more = [StructField(decoded, StringType())] if decoded else []
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), *more])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in T.chunks(batches, column=text):
            found = [own.ids(t) for t in batch.column(at).to_pylist()]
            places = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(flat, pa.int32()))
            back = [own.texts(lists)] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *back], schema.names)

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """coded with a column of the texts that its ids stand for. A column of that name is replaced."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    coded = coded.drop(text)
    schema = StructType([*coded.schema.fields, StructField(text, StringType())])
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = batch.column(at)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own.texts(lists)], [*batch.schema.names, text])

    return coded.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """coded (with ids and decoded) with n_tokens and the SHA-256 digests of ids and text."""
    return coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join("ids", ",").cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
        }
    )
