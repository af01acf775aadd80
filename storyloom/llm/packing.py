"""Packing documents into sequences by hierarchical best fit.

Texts become pieces of at most ``capacity`` tokens. The pieces, without their ids, are dealt at random over partitions of
bounded size, so that each sees the mix of lengths of the whole corpus, and every partition packs its own by best fit,
longest first. Nearly full bins are final. Underfull ones become items of the next round, dealt anew over fewer nodes and
packed again, until one node is left or a round no longer joins bins. A node never holds more than about
``NODE_ITEMS`` numbers, whatever the size of the corpus, and each round is a written table.

Defined results: a null or empty text has the end token alone; rows that share an identifier are packed each; no rows
give no rows. Only pieces longer than the capacity are cut.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SLICE_BYTES, ready, schema_of, text_or_empty, type_of
from storyloom.scratch import store

CAPACITY = 4096
END_ID = 1
NODE_ITEMS = 65_536
# A bin with less room than this is final; a share of the capacity.
NEARLY_FULL = 1 / 256
# Words whose ids a worker remembers.
REMEMBERED = 600_000

# Fixed value: the word pattern of the vocabulary file.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Text that the normaliser of the file only lower-cases: printable Latin-1.
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff]+")


def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class WordEncoder:
    """Ids of texts by a byte-level BPE file whose words end in ``</w>``, as packed unsigned 32-bit numbers.

    No token reaches over white space, so ids are remembered per run of other characters. Runs not met before are
    split into words and encoded together in one call; each word ends at the first id that carries the word end.
    Anything but printable Latin-1 goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        if not words:
            return
        shown = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        ids = np.asarray(self.bare.encode(" ".join(shown), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) == len(words):
            raw, low = ids.tobytes(), 0
            for word, high in zip(words, (4 * ends).tolist()):
                self.words[word] = raw[low:high]
                low = high
        else:
            for word in words:
                self.words[word] = self._pack(self.whole.encode(word, add_special_tokens=False).ids)

    def _split(self, text: str) -> tuple[str, ...] | None:
        """Lower-cased words of a run; None where the whole tokenizer is needed."""
        if not (text.isascii() and text.isprintable()) and not _PLAIN.fullmatch(text):
            return None
        if "<" in text and any(s in text for s in self.special):
            return None
        low = text.lower()
        if low.isalpha():
            return (low,)
        if low[:-1].isalpha():
            return low[:-1], low[-1]
        return tuple(_WORDS.findall(low))

    def learn(self, runs: set[bytes]) -> None:
        words, parts = self.words, {}
        for run in runs:
            text = run.decode()
            split = self._split(text)
            if split is None:
                self.runs[run] = self._pack(self.whole.encode(text, add_special_tokens=False).ids)
            else:
                parts[run] = split
        if len(words) > REMEMBERED:
            words.clear()
        self._learn_words([*{w for ws in parts.values() for w in ws}.difference(words)])
        for run, ws in parts.items():
            self.runs[run] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        known = self.runs
        seen = set().union(*split)
        if len(known) > REMEMBERED:
            known.clear()
        self.learn(seen.difference(known))
        return [b"".join(map(known.__getitem__, runs)) for runs in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("_id"), batch.column("_text").to_pylist()
            for low, high in _slices(texts):
                where, piece, start, length, crc, tokens = [], [], [], [], [], []
                for i, raw in enumerate(enc.encode(texts[low:high]), low):
                    raw += end
                    for n, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[begin : begin + 4 * capacity]
                        where.append(i)
                        piece.append(n)
                        start.append(begin // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            tokens.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                columns = [
                    ids.take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return read


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the ``ids`` of every piece."""
    ready(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    fields = [("_id", type_of(docs, id_col)), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    return source.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), schema_of(*fields, *([("ids", "array<int>")] if with_ids else [])))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin that has room; and the load of each bin.

    Bins are kept by the room left; a bit mask of rooms in use finds the smallest sufficient one.
    """
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    loads: list[int] = []
    used = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = used >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            room, chosen = capacity, len(loads)
            loads.append(0)
        bins[item], offsets[item] = chosen, loads[chosen]
        loads[chosen] += length
        room -= length
        if room:
            by_room[room].append(chosen)
            used |= 1 << room
    return bins, offsets, np.array(loads, dtype=np.int64)


def _bin_ids(turn: int, node: int, bins: np.ndarray) -> np.ndarray:
    return (np.int64(turn) << 56) | (np.int64(node) << 28) | bins


def _pack_local(capacity: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets, loads = best_fit(table.column("length").to_numpy(), capacity)
        ids = _bin_ids(0, TaskContext.get().partitionId(), bins)
        added = table.append_column("_bin", pa.array(ids)).append_column("_offset", pa.array(offsets))
        yield from added.append_column("_load", pa.array(loads[bins])).to_batches()

    return read


def _merge(capacity: int, turn: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_bin")
        bins, offsets, loads = best_fit(rows["_load"].to_numpy(), capacity)
        return pd.DataFrame({"_bin": rows["_bin"], "_up": _bin_ids(turn, key[0], bins), "_shift": offsets, "_total": loads[bins]})

    return pack


def _scattered(df: DataFrame, key: str, turn: int, nodes: int):
    return df.withColumn("_node", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(nodes)).cast("int"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; all their columns are kept (a column ``length`` is needed)."""
    written = store(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    light = [c for c in written.df.columns if c != "ids"]
    nodes = max(1, -(-written.rows // NODE_ITEMS))
    dealt = written.df.select(*light).repartition(nodes, F.xxhash64("_row"))
    placed_schema = schema_of(
        *((f.name, f.dataType) for f in dealt.schema.fields), ("_bin", "bigint"), ("_offset", "bigint"), ("_load", "bigint")
    )
    placed = store(dealt.mapInArrow(_pack_local(capacity), placed_schema), "placed").df
    enough = capacity - int(capacity * NEARLY_FULL)
    open_bins = store(placed.filter(F.col("_load") < enough).select("_bin", "_load").distinct(), "bins")
    steps, items, last = [], open_bins.rows, nodes == 1
    while items > 1 and not last:
        nodes = max(1, -(-items // NODE_ITEMS))
        turn, last = len(steps) + 1, nodes == 1
        merged = _scattered(open_bins.df, "_bin", turn, nodes).groupBy("_node").applyInPandas(
            _merge(capacity, turn), "_bin bigint, _up bigint, _shift bigint, _total bigint"
        )
        step = store(merged, "merged").df
        steps.append(step)
        rest = step.filter(F.col("_total") < enough).select(F.col("_up").alias("_bin"), F.col("_total").alias("_load")).distinct()
        open_bins = store(rest, "bins")
        last = last or open_bins.rows > 0.99 * items
        items = open_bins.rows
    moved = placed
    if steps:
        whole = steps[-1].select("_bin", "_up", "_shift")
        for step in reversed(steps[:-1]):
            further = whole.select(F.col("_bin").alias("_up"), F.col("_up").alias("_top"), F.col("_shift").alias("_more"))
            whole = step.join(further, "_up", "left").select(
                "_bin", F.coalesce("_top", "_up").alias("_up"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift")
            )
        moved = placed.join(whole, "_bin", "left")
        moved = moved.withColumn("_bin", F.coalesce("_up", "_bin")).withColumn("_offset", F.col("_offset") + F.coalesce("_shift", F.lit(0)))
    out = moved.select(*light, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))
    if "ids" in written.df.columns:
        out = out.join(written.df.select("_row", "ids"), "_row")
    return out.drop("_row")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Identifier, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, if asked for, ``ids``."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity).withColumnRenamed("_id", id_col)
