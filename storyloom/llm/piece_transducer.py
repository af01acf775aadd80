"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled into three machines. The normaliser maps blanks to the mark ``▁`` and puts one in front. The piece
machine has an arc for every piece. Byte fallback gives a character that no piece has its UTF-8 bytes, at a cost of one for
each. For a BPE file the pieces alone allow more paths than the merges do, so they are composed with an acceptor that remembers
the last piece: two pieces may follow each other only if merging their joined text ends in just these two. A path of
which every two neighbours satisfy that is what merging the whole text gives, and there is one for each prefix of the
text, so the composition with a text keeps one live state for each position. The cheapest path through these states under the
tropical semiring is the encoding.

No piece holds a mark after another character, or a line feed, so every path passes the start state there; the input is cut at
these places, and the ids of stretches met before are remembered in a bounded cache.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that share an identifier are encoded each;
no rows give no rows. Decoding gives back the text unless it holds the mark itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import ready, schema_of, text_or_empty, type_of

MARK = "▁"
# Fixed values of the model format: kinds of pieces and models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
REMEMBERED = 500_000
_STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as handle:
            model = handle.read()
        pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3) != BPE or not trainer.get(35) or normaliser.get(2):
            raise ValueError("a BPE model with byte fallback and without a character map is needed")
        if not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("a model with a mark in front and with all blanks kept is needed")
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {text: score for text, score, kind in pieces if kind == NORMAL}
        if any("\n" in text or MARK in text.lstrip(MARK) for text in self.ids):
            raise ValueError("a piece crosses a place where the input is cut")
        byte = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        self.bytes = [byte[b] for b in range(256)]
        # How long a piece that ends in two given characters can be, and which characters are neighbours in a piece.
        self.reach: dict[str, int] = {}
        self.neighbours: set[str] = set()
        for text in self.ids:
            self.reach[text[-2:]] = max(len(text), self.reach.get(text[-2:], 0))
            self.neighbours.update(text[i : i + 2] for i in range(len(text) - 1))
        self.packed = [struct.pack("<I", i) for i in range(len(pieces))]
        self.output = [self._shown(text, kind) for text, _, kind in pieces]
        self.follows: dict[tuple[str, str], bool] = {}
        # Ids of stretches: those met lately, and before they were too many those met before.
        self.stretches: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _shown(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else text.replace(MARK, " ").encode()

    def _merged(self, text: str) -> list[str]:
        """The merge rule itself, on a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        """The acceptor: merging the two texts together ends in just these pieces. An empty left is the start."""
        key = (left, right)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
            known = self.follows[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def shortest_path(self, text: str) -> list[int]:
        """Ids of the cheapest path of a stretch through the composed machines."""
        size, ids, reach, follows = len(text), self.ids, self.reach, self.follows
        last = [""] * (size + 1)
        steps: list[tuple[int, int]] = [(0, 0)] * (size + 1)
        for end in range(1, size + 1):
            longest = reach.get(text[end - 2 : end], 1) if end > 1 else 1
            for begin in range(end - longest if end > longest else 0, end):
                piece = text[begin:end]
                number = ids.get(piece)
                if number is not None:
                    follow = follows.get((last[begin], piece))
                    if follow or (follow is None and self.may_follow(last[begin], piece)):
                        last[end], steps[end] = piece, (begin, number)
                        break
            else:
                # A character without a piece; nothing merges over it, so what follows starts anew.
                steps[end] = (end - 1, -1)
        path: list[int] = []
        at = size
        while at:
            begin, number = steps[at]
            path.extend((number,) if number >= 0 else [self.bytes[b] for b in reversed(text[begin].encode("utf-8", "replace"))])
            at = begin
        path.reverse()
        return path

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch not met lately, which is cut where its characters are neighbours in no piece."""
        if len(self.stretches) > REMEMBERED:
            self.older, self.stretches = self.stretches, {"": b""}
        known, older, packed = self.stretches, self.older, self.packed
        ids = older.get(text)
        if ids is not None:
            known[text] = ids
            return ids
        out, low = [], 0
        for high in range(1, len(text) + 1):
            if high == len(text) or text[high - 1 : high + 1] not in self.neighbours:
                part = text[low:high]
                ids = known.get(part) or older.get(part)
                if ids is None:
                    ids = known[part] = b"".join([packed[i] for i in self.shortest_path(part)])
                out.append(ids)
                low = high
        made = known[text] = b"".join(out)
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed unsigned 32-bit numbers."""
        if not text:
            return b""
        if MARK in text or "  " in text or text[0] == " ":
            stretches = _STRETCH.findall(MARK + text.replace(" ", MARK))
        else:
            stretches = (MARK + text).replace(" ", f" {MARK}").replace("\n", " \n ").split(" ")
        known = self.stretches
        out = []
        for stretch in stretches:
            ids = known.get(stretch)
            if ids is None:
                ids = self._stretch(stretch)
                known = self.stretches
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.output.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One compiled model for each worker process and file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and ``ids`` of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            ids = [np.frombuffer(machine.encode(t), dtype="<u4").astype(np.int32) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(read, schema_of(("_id", type_of(docs, id_col)), ("ids", "array<int>"))).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Identifier and ``text`` of every list of ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [machine.decode(np.asarray(i or [], dtype="<u4").tobytes()) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    source = encoded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").alias("_ids"))
    return source.mapInArrow(read, schema_of(("_id", type_of(encoded, id_col)), ("text", "string"))).withColumnRenamed("_id", id_col)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every text the number and CRC-32 of its ids, the digest of what they decode to, and whether that is the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            counts, sums, digests, same = [], [], [], []
            for text in batch.column("_text").to_pylist():
                ids = machine.encode(text)
                back = machine.decode(ids)
                counts.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                names=["_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    schema = schema_of(("_id", type_of(docs, id_col)), ("n_ids", "bigint"), ("ids_crc32", "bigint"), ("decoded_sha256", "string"), ("round_trip", "boolean"))
    return _source(docs, id_col, text_col).mapInArrow(read, schema).withColumnRenamed("_id", id_col)
