"""Removal of bytes that repeat a string of ``WIDTH`` bytes from earlier in the corpus, by a distributed difference-cover algorithm.

Windows are the first ``WIDTH`` bytes of suffixes; a window that equals an earlier one is removed with all its bytes.

1. What cannot repeat is left out, which loses nothing. Of the hashes of the ``PART``-byte strings in a window the smallest is its
   anchor, which equal windows share. Only windows whose anchor value occurs twice in the corpus stay; runs of them are fragments.
   Then whole stretches of neighbouring windows are compared by a digest of all bytes they span, and of equal stretches only the
   first stays. So a passage that is copied any number of times takes part once, whatever the size of the group. Then anchor
   values are counted again, as most of what is left has lost its equals.
2. Suffixes of the fragments are divided into three classes by their place (in characters of ``CHAR`` bytes, modulo three). Those of
   classes 1 and 2, a difference cover, are the sample. The sample's triples of characters are sorted and named; on the names the
   step recurses, three names and then two at a time, until a name stands for 90 bytes. As only ``WIDTH`` bytes count, it ends there.
3. The remaining suffixes are merged: any two suffixes of classes a and b are at most two characters away from places that are both
   in the sample, so they are compared by those characters, a name, and the characters behind it: 100 bytes in all. There is one
   order for each of the three ways to be in step, sorted by exact content, and neighbours with equal prefixes are one
   group, of which the first in the corpus stays. Names are given by sorting, so nothing in steps 2 and 3 rests on a hash.

Sorting is dealt out by key. A block of fragments sends each of its different keys once, with their first place, so a key that is
everywhere reaches its task at most once from each block, and gets back one name or one bit for each. Texts are walked in pieces
of bounded size, so memory does not follow the length of a document.

Defined results: a null text is empty; texts shorter than ``WIDTH`` bytes stay; a null identifier comes after all others; rows that
share an identifier are one document, in which equal starts take nothing from one another, so repeated rows stay both; no
rows give no rows; other columns do not take part, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import pickle
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.llm.common import BASES, mix, powers, ready, schema_of, text_or_empty, type_of
from storyloom.operators.positions import ordered_position
from storyloom.scratch import StoredTable, store

# Bytes of a window, of a character, and of the names that the recursion reaches.
WIDTH = 100
CHAR = 5
REACH = WIDTH - 2 * CHAR
# Bytes of the strings whose smallest hash is a window's anchor, and of those that cut stretches.
PART = 50
CUT = 16
CUT_BITS = 4
# Bytes walked at once; anchors are packed with a place below this.
SLICE_BITS = 22
SLICE = 1 << 20
PIECE = SLICE - 2 * WIDTH
# Bytes of fragments in a block (it can grow by two slices), and anchor values that a task gathers before it sends them.
BLOCK_BYTES = 1 << 20
# Bytes of fragments whose keys one bucket holds: the number of buckets follows the data, so a block's row for one is never nearly empty
# because a cluster has many partitions.
BUCKET_BYTES = 1 << 22
SENT_VALUES = 1 << 20
NAME_BITS = 42
_INVERSE = pow(BASES[0], -1, 1 << 64)
_LAST = np.iinfo(np.int64).max


class Windows:
    """Pieces of texts, one after another in ``data``: row, place in the text, start in ``data`` and number of windows of each."""

    def __init__(self, rows, places, lengths, data):
        self.rows, self.places, self.data = np.array(rows), np.array(places, dtype=np.int64), data
        lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.counts = lengths - WIDTH + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window its start in ``data`` and the start of its anchor: the first of the smallest hashes in it."""
        least = self.hashes = rolling(self.data, PART)
        least = (least & ~np.uint64((1 << SLICE_BITS) - 1)) | np.arange(len(least), dtype=np.uint64)
        width, span = 1, WIDTH - PART + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = ranges(self.starts, self.counts)
        return at, (least[at] & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start .. start + count - 1 of each."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` bytes. Only ever used to leave out what has no equal, so an accidental match costs work, not results."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASES[0], n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_INVERSE, n - width + 1))


def pieces_of(texts: pa.Array) -> Iterator[Windows]:
    """All windows of all texts, in pieces of bounded size."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    rows, places, lengths, parts, held = [], [], [], [], 0
    for row in np.flatnonzero(np.diff(ends) >= WIDTH).tolist():
        low, size = int(ends[row]), int(ends[row + 1] - ends[row])
        for place in range(0, size - WIDTH + 1, PIECE):
            length = min(size, place + PIECE + WIDTH - 1) - place
            if held + length > SLICE:
                yield Windows(rows, places, lengths, np.concatenate(parts))
                rows, places, lengths, parts, held = [], [], [], [], 0
            rows.append(row)
            places.append(place)
            lengths.append(length)
            parts.append(data[low + place : low + place + length])
            held += length
    if held:
        yield Windows(rows, places, lengths, np.concatenate(parts))


def _sent(bucket: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The members of each bucket that has any, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _anchor_rows(n_buckets: int):
    """Anchor values of all texts with the key of their row, by bucket of the value."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, keys, held = [], [], 0

        def made() -> pa.RecordBatch:
            all_values, all_keys, rows = np.concatenate(values), np.concatenate(keys), []
            for b, own in _sent((all_values % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64), n_buckets):
                rows.append((b, all_values[own].tobytes(), *_runs(all_keys[own])))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["_b", "_v", "_k", "_c"])

        for batch in batches:
            own = batch.column("_key").to_numpy(zero_copy_only=False)
            for part in pieces_of(batch.column("_text")):
                _, anchor = part.anchors()
                fresh = np.ones(len(anchor), dtype=bool)
                fresh[1:] = anchor[1:] != anchor[:-1]
                values.append(part.hashes[anchor[fresh]])
                keys.append(np.repeat(own[part.rows], part.counts)[fresh])
                held += len(values[-1])
                if held >= SENT_VALUES:
                    yield made()
                    values, keys, held = [], [], 0
        if held:
            yield made()

    return read


def _runs(keys: np.ndarray) -> tuple[bytes, bytes]:
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads].tobytes(), np.diff(np.append(heads, len(keys))).astype(np.int32).tobytes()


def _twice(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The values of one bucket that occur twice, each with the key of its row."""
    values = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["_v"]])
    keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, np.int32)) for k, c in zip(rows["_k"], rows["_c"])])
    order = np.argsort(values, kind="stable")
    values, keys = values[order], keys[order]
    same = values[1:] == values[:-1]
    several = np.zeros(len(values), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    return values[several], keys[several]


def _repeated_values(n_buckets: int):
    """Of one bucket the values that occur twice, by bucket of the rows that have them."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        values, keys = _twice(rows)
        out = [(r, values[own].tobytes(), keys[own].tobytes()) for r, own in _sent(_row_bucket(keys, n_buckets), n_buckets)]
        return pd.DataFrame(out, columns=["_r", "_v", "_k"])

    return judge


def _row_bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(BASES[1])) % np.uint64(n_buckets)).astype(np.int64)


def _values_of_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """The values of each row of a bucket of rows."""
    values = np.frombuffer(b"".join(rows["_v"]), np.uint64)
    keys = np.frombuffer(b"".join(rows["_k"]), np.int64)
    order = np.argsort(keys, kind="stable")
    values, keys = values[order], keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(heads[1:], len(keys))
    return pd.DataFrame({"_key": keys[heads], "_vs": [values[a:b].tobytes() for a, b in zip(heads.tolist(), ends.tolist())]})


# A block is a dictionary of arrays. ``seq``, ``key``, ``tag``: order of the fragment's document, and what finds its row again;
# ``at``: its place in the document; ``n``: its number of windows; ``data``: n + WIDTH - 1 bytes of each; ``gone``: removed ranges so
# far as (key, tag, start, end); later ``names`` of its sampled places.
FIELDS = ("seq", "key", "tag", "at", "n")


_BLOCKS = "_blk bigint, _data binary, _size bigint"


def _block_number(k: int) -> int:
    return (TaskContext.get().partitionId() << 31) | k


def _packed(number: int, block: dict) -> pa.RecordBatch:
    raw = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(block, 5))
    size = pa.array([len(block["data"])], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([raw], pa.binary()), size], names=["_blk", "_data", "_size"])


def _unpacked(raw: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _runs_of(mask: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of ``mask``, which also end at ``borders``."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[borders] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts


def _live_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the texts: runs of windows whose anchor value occurs twice."""
    fields, parts, held, made = [[] for _ in FIELDS], [], 0, 0

    def flushed() -> pa.RecordBatch:
        columns = [np.concatenate(f) for f in fields]
        order = np.lexsort((columns[3], columns[0]))
        data, sizes = np.concatenate(parts), columns[4] + WIDTH - 1
        starts = np.cumsum(sizes) - sizes
        block = dict(zip(FIELDS, (c[order] for c in columns)))
        return _packed(_block_number(made), block | {"data": data[ranges(starts[order], sizes[order])], "gone": np.zeros((0, 4), np.int64)})

    for batch in batches:
        seq, key, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_seq", "_key", "_tag"))
        wanted = [np.unique(np.frombuffer(v, np.uint64)) for v in batch.column("_vs").to_pylist()]
        for part in pieces_of(batch.column("_text")):
            _, anchor = part.anchors()
            value, live, low = part.hashes[anchor], np.zeros(len(anchor), dtype=bool), 0
            for row, count in zip(part.rows.tolist(), part.counts.tolist()):
                mine = value[low : low + count]
                found = np.searchsorted(wanted[row], mine)
                live[low : low + count] = wanted[row][np.minimum(found, len(wanted[row]) - 1)] == mine
                low += count
            borders = np.cumsum(part.counts) - part.counts
            starts, lengths = _runs_of(live, borders)
            of = np.searchsorted(borders, starts, side="right") - 1
            inside = starts - borders[of]
            for f, values in zip(fields, (seq[part.rows[of]], key[part.rows[of]], tag[part.rows[of]], part.places[of] + inside, lengths)):
                f.append(values.astype(np.int64))
            parts.append(part.data[ranges(part.starts[of] + inside, lengths + WIDTH - 1)])
            held += len(parts[-1])
            if held >= BLOCK_BYTES:
                yield flushed()
                fields, parts, held, made = [[] for _ in FIELDS], [], 0, made + 1
    if held:
        yield flushed()


# Keys of a block: for each kind two 64-bit halves, which together are exact content or exact names, and the members they belong to.
Keys = Callable[[dict], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _sorted_keys(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, equal ones as they come, and where in it a new key begins."""
    order = np.lexsort((low, high))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    return order, fresh


def _wrapped(columns: list[np.ndarray]) -> bytes:
    """64-bit columns by byte: the upper bytes of sorted or small numbers hardly vary, so they pack to little."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unwrapped(packed: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(-1, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def _bucket(high: np.ndarray, low: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(high ^ mix(low)) % np.uint64(n_buckets)).astype(np.int64)


def _key_rows(keys_of: Keys, places_of: Callable | None, n_buckets: int):
    """Each block's different keys, with the first place of each, by bucket."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("_blk").to_pylist(), batch.column("_data").to_pylist()):
                block, rows = _unpacked(raw), []
                for kind, (high, low, members) in enumerate(keys_of(block)):
                    order, fresh = _sorted_keys(high, low)
                    firsts = order[fresh]
                    high, low = high[firsts], low[firsts]
                    places = places_of(block, members[firsts]) if places_of else None
                    for b, own in _sent(_bucket(high, low, n_buckets), n_buckets):
                        payload = [high[own], low[own]] + ([p[own] for p in places] if places else [])
                        rows.append((b, number, kind, len(own), _wrapped(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["_b", "_blk", "_kind", "_n", "_p"])

    return read


def _answers(how: str, n_buckets: int):
    """For each key of each block its name, whether another block has it, or whether another block has it at an earlier place."""
    named, placed = how == "name", how == "first"

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_kind", "_blk"], ignore_index=True)
        out = []
        for _, part in rows.groupby("_kind", sort=True):
            sizes = part["_n"].to_numpy()
            columns = [np.concatenate(c) for c in zip(*(_unwrapped(p, n) for p, n in zip(part["_p"], sizes)))]
            high, low = columns[:2]
            columns[2:] = [c.view(np.int64) for c in columns[2:]]
            order = np.lexsort((columns[3], columns[2], low, high) if placed else (low, high))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
            group = np.cumsum(fresh) - 1
            answer = np.empty(len(order), dtype=np.int64 if named else bool)
            if named:
                answer[order] = group * n_buckets + int(part["_b"].iloc[0])
                if len(order) and group[-1] >= (1 << NAME_BITS) // n_buckets:
                    raise OverflowError("more names than their bits can hold")
                answer = answer.astype(np.uint32 if int(answer.max(initial=0)) < 1 << 32 else np.int64)
            elif not placed:
                answer[order] = (np.bincount(group) > 1)[group] if len(group) else False
            else:
                first = order[np.flatnonzero(fresh)][group]
                answer[order] = (columns[2][first] < columns[2][order]) | ((columns[2][first] == columns[2][order]) & (columns[3][first] < columns[3][order]))
            cuts = np.cumsum(sizes)[:-1]
            for number, kind, b, x in zip(part["_blk"], part["_kind"], part["_b"], np.split(answer, cuts)):
                out.append((number, kind, b, x.dtype.str, x.tobytes() if named else np.packbits(x).tobytes(), len(x)))
        return pd.DataFrame(out, columns=["_blk", "_kind", "_b", "_dtype", "_p", "_n"])

    return judge


def _by_member(keys: list, told: list, named: bool, n_buckets: int) -> Iterator[tuple]:
    """For each kind: members in the order of their keys, where a new key begins, and the answer of each."""
    for kind, (high, low, members) in enumerate(keys):
        order, fresh = _sorted_keys(high, low)
        firsts = order[fresh]
        answer = np.empty(len(firsts), dtype=np.int64 if named else bool)
        mine = {t["_b"]: t for t in told if t["_kind"] == kind}
        for b, own in _sent(_bucket(high[firsts], low[firsts], n_buckets), n_buckets):
            t = mine[b]
            answer[own] = np.frombuffer(t["_p"], t["_dtype"]) if named else np.unpackbits(np.frombuffer(t["_p"], np.uint8), count=t["_n"]).astype(bool)
        yield members[order], fresh, answer[np.cumsum(fresh) - 1]


def exchange(stored: StoredTable, keys_of: Keys, change: Callable, how: str = "name", places_of: Callable | None = None) -> StoredTable:
    """Sort the keys of all blocks and hand the answers back: ``change(block, kinds)`` makes the new block, which replaces the old.

    With ``how`` "name" a key's answer is its name, equal for equal keys only; with "shared", whether another block has the key; with
    "first", whether its first place in the block, by ``places_of``, has an earlier one in another.
    """
    named, blocks = how == "name", stored.df
    n_buckets = 1 + (blocks.agg(F.sum("_size")).first()[0] or 0) // BUCKET_BYTES
    sent = blocks.mapInArrow(_key_rows(keys_of, places_of, n_buckets), "_b bigint, _blk bigint, _kind bigint, _n bigint, _p binary")
    told = sent.groupBy("_b").applyInPandas(_answers(how, n_buckets), "_blk bigint, _kind bigint, _b bigint, _dtype string, _p binary, _n bigint")
    gathered = told.groupBy("_blk").agg(F.collect_list(F.struct("_kind", "_b", "_dtype", "_p", "_n")).alias("_told"))

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("_blk").to_pylist()):
                block = _unpacked(batch.column("_data")[i].as_py())
                found = list(_by_member(keys_of(block), batch.column("_told")[i].as_py() or [], named, n_buckets))
                yield _packed(number, change(block, found))

    new = store(blocks.join(gathered, "_blk", "left").mapInArrow(changed, _BLOCKS), "suffix-blocks")
    stored.discard()
    return new


def _geometry(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Fragment of each byte, and its place in the fragment."""
    sizes = block["n"] + WIDTH - 1
    return np.repeat(np.arange(len(sizes)), sizes), ranges(np.zeros(len(sizes), np.int64), sizes)


def _stretches(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in ``data``, number of windows and fragment of the stretches, cut where their content says so."""
    fragment, inside = _geometry(block)
    cut = np.zeros(len(fragment), dtype=bool)
    cut[: len(fragment) - CUT + 1] = rolling(block["data"], CUT) >> np.uint64(64 - CUT_BITS) == 0
    window = inside < block["n"][fragment]
    starts = np.flatnonzero(window & (cut | (inside == 0)))
    of = fragment[starts]
    ends = np.append(starts[1:], len(fragment))
    stops = np.cumsum(block["n"] + WIDTH - 1)[of] - WIDTH + 1
    return starts, np.minimum(ends, stops) - starts, of


def _stretch_keys(block: dict) -> list:
    starts, counts, _ = _stretches(block)
    view = memoryview(block["data"].tobytes())
    made = b"".join(hashlib.blake2b(view[a : a + n + WIDTH - 1], digest_size=16).digest() for a, n in zip(starts.tolist(), counts.tolist()))
    halves = np.frombuffer(made, np.uint64).reshape(-1, 2)
    return [(halves[:, 0].copy(), halves[:, 1].copy(), np.arange(len(starts)))]


def _places(block: dict, starts: np.ndarray) -> list[np.ndarray]:
    """Order of the document and place in it, of starts in ``data``."""
    heads = np.cumsum(block["n"] + WIDTH - 1) - (block["n"] + WIDTH - 1)
    of = np.searchsorted(heads, starts, side="right") - 1
    return [block["seq"][of], block["at"][of] + starts - heads[of]]


def _stretch_places(block: dict, members: np.ndarray) -> list[np.ndarray]:
    return _places(block, _stretches(block)[0][members])


def _later(block: dict, kinds: list, starts: np.ndarray | None = None) -> np.ndarray:
    """Members with an equal at an earlier place, in this block or another."""
    late = []
    for members, fresh, earlier in kinds:
        seq, at = _places(block, members if starts is None else starts[members])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        late.append(members[earlier | (seq[first] < seq) | ((seq[first] == seq) & (at[first] < at))])
    return np.unique(np.concatenate(late)) if late else np.zeros(0, np.int64)


def _ranges_gone(block: dict, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Byte ranges in the documents that windows from ``starts`` cover."""
    heads = np.cumsum(block["n"] + WIDTH - 1) - (block["n"] + WIDTH - 1)
    of = np.searchsorted(heads, starts, side="right") - 1
    low = block["at"][of] + starts - heads[of]
    return _merged_ranges(np.stack([block["key"][of], block["tag"][of], low, low + counts + WIDTH - 1], axis=1))


def _merged_ranges(gone: np.ndarray) -> np.ndarray:
    """Ranges (key, tag, start, end) in order, those of a document that overlap or touch as one."""
    gone = gone[np.lexsort((gone[:, 2], gone[:, 1], gone[:, 0]))]
    fresh = np.concatenate(([True], (gone[1:, :2] != gone[:-1, :2]).any(axis=1)))[: len(gone)]
    document = np.cumsum(fresh) - 1
    # Documents are set apart by more than any text is long, so one pass over all ends serves all of them.
    apart = document * (np.int64(1) << 40)
    starts, ends = _joined(gone[:, 2] + apart, gone[:, 3] + apart)
    of = np.searchsorted(gone[:, 2] + apart, starts)
    return np.concatenate([gone[of, :2], (starts - apart[of])[:, None], (ends - apart[of])[:, None]], axis=1)


def _first_stretches(block: dict, kinds: list) -> dict:
    """The block with only those stretches of which none is earlier."""
    starts, counts, of = _stretches(block)
    late = np.zeros(len(starts), dtype=bool)
    late[_later(block, kinds, starts)] = True
    gone = np.concatenate([block["gone"], _ranges_gone(block, starts[late], counts[late])])
    return _with_windows(block, np.repeat(~late, counts)) | {"gone": gone}


def _with_windows(block: dict, stays: np.ndarray) -> dict:
    """The block with some of its windows; runs of them are the new fragments."""
    heads, sizes = np.cumsum(block["n"]) - block["n"], block["n"] + WIDTH - 1
    runs, lengths = _runs_of(stays, heads)
    frag = np.searchsorted(heads, runs, side="right") - 1
    inside = runs - heads[frag]
    new = {f: block[f][frag] for f in ("seq", "key", "tag")} | {"at": block["at"][frag] + inside, "n": lengths}
    return new | {"data": block["data"][ranges((np.cumsum(sizes) - sizes)[frag] + inside, lengths + WIDTH - 1)], "gone": block["gone"]}


def _block_anchors(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """The start of each window's anchor, and the hashes of all starts."""
    own = Windows(np.arange(len(block["n"])), block["at"], block["n"] + WIDTH - 1, block["data"])
    if not len(block["n"]):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return own.anchors()[1], own.hashes


def _anchor_keys(block: dict) -> list:
    anchor, hashes = _block_anchors(block)
    at = np.unique(anchor)
    return [(hashes[at], np.zeros(len(at), np.uint64), at)]


def _still_shared(block: dict, kinds: list) -> dict:
    """The block with the windows whose anchor value still occurs twice."""
    members, fresh, elsewhere = kinds[0]
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(members)))
    good = np.zeros(len(block["data"]), dtype=bool)
    good[members[elsewhere | (sizes > 1)[np.cumsum(fresh) - 1]]] = True
    return _with_windows(block, good[_block_anchors(block)[0]])


def _number(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes as one number, the first byte highest."""
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        total = (total << np.uint64(8)) | data[at + k]
    return total


def _sampled(block: dict, reach: int) -> np.ndarray:
    """Places of classes 1 and 2 with ``reach`` bytes of their fragment left."""
    fragment, inside = _geometry(block)
    return np.flatnonzero((inside // CHAR % 3 > 0) & (inside + reach <= (block["n"] + WIDTH - 1)[fragment]))


def _triple_keys(block: dict) -> list:
    at = _sampled(block, 3 * CHAR)
    return [(_number(block["data"], at, 8), _number(block["data"], at + 8, 3 * CHAR - 8), at)]


def _names(block: dict, reach: int) -> np.ndarray:
    """Names by place in ``data``."""
    names = np.zeros(len(block["data"]), dtype=np.uint64)
    names[_sampled(block, reach)] = block["names"]
    return names


def _pack(name: np.ndarray, a: np.ndarray, b: np.ndarray, a_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A name of ``NAME_BITS`` and two more numbers, without loss."""
    spare = 64 - NAME_BITS
    rest = a_bits - spare
    return (name << np.uint64(spare)) | (a >> np.uint64(rest)), ((a & np.uint64((1 << rest) - 1)) << np.uint64(NAME_BITS)) | b


def _recursed_keys(block: dict) -> list:
    names, at = _names(block, 3 * CHAR), _sampled(block, 9 * CHAR)
    return [(*_pack(names[at], names[at + 3 * CHAR], names[at + 6 * CHAR], NAME_BITS), at)]


def _last_keys(block: dict) -> list:
    names, at = _names(block, 9 * CHAR), _sampled(block, REACH)
    return [(names[at], names[at + 9 * CHAR], at)]


def _named(block: dict, kinds: list) -> dict:
    members, _, names = kinds[0]
    made = names[np.argsort(members)]
    return block | {"names": made.astype(np.uint32 if int(made.max(initial=0)) < 1 << 32 else np.uint64)}


def _merge_keys(distance: int) -> Keys:
    """The order of the suffixes that are ``distance`` characters away from the sample with those they are in step with."""

    def keys(block: dict) -> list:
        names, data = _names(block, REACH), block["data"]
        fragment, inside = _geometry(block)
        at = np.flatnonzero((inside < block["n"][fragment]) & (inside // CHAR % 3 != (0, 2, 1)[distance]))
        # Characters before the name, then those behind it: two in all.
        a, b = [_number(data, at + CHAR * k + (REACH if k >= distance else 0), CHAR) for k in range(2)]
        return [(*_pack(names[at + CHAR * distance], a, b, 8 * CHAR), at)]

    return keys


def _noted(block: dict, kinds: list) -> dict:
    return block | {"late": np.union1d(block.get("late", np.zeros(0, np.int64)), _later(block, kinds))}


def _covered(block: dict) -> np.ndarray:
    """Byte ranges in the documents that are removed."""
    late = np.zeros(len(block["data"]), dtype=bool)
    late[block["late"]] = True
    heads = np.cumsum(block["n"] + WIDTH - 1) - (block["n"] + WIDTH - 1)
    starts, counts = _runs_of(late, heads)
    return np.concatenate([block["gone"], _ranges_gone(block, starts, counts)])


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removed ranges of each document of a block, joined where they meet."""
    for batch in batches:
        for raw in batch.column("_data").to_pylist():
            gone = _covered(_unpacked(raw))
            if not len(gone):
                continue
            gone = _merged_ranges(gone)
            heads = np.flatnonzero(np.concatenate(([True], (gone[1:, :2] != gone[:-1, :2]).any(axis=1))))
            parts = np.split(gone, heads[1:])
            spans = [p[:, 2:].tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(gone[heads, 0]), pa.array(gone[heads, 1]), pa.array(spans, pa.binary())], names=["_key", "_tag", "_spans"])


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order of start, overlapping and adjacent ones as one."""
    if not len(starts):
        return starts, ends
    upto = np.maximum.accumulate(ends)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = starts[1:] > upto[:-1]
    heads = np.flatnonzero(fresh)
    return starts[heads], upto[np.append(heads[1:], len(starts)) - 1]


def _cut(id_type: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lost, counts, digests, removed = [], [], [], [], []
            for i, parts in enumerate(batch.column("_all").to_pylist()):
                raw = memoryview((batch.column("_text")[i].as_py() or "").encode())
                ranges_ = np.frombuffer(b"".join(parts or []), np.int64).reshape(-1, 2)
                ranges_ = ranges_[np.argsort(ranges_[:, 0], kind="stable")]
                starts, ends = _joined(ranges_[:, 0], ranges_[:, 1]) if len(ranges_) else (np.zeros(0, np.int64),) * 2
                kept, low = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept.update(raw[low:a])
                    low = b
                kept.update(raw[low:])
                sizes.append(len(raw))
                lost.append(int((ends - starts).sum()))
                counts.append(len(starts))
                digests.append(kept.hexdigest())
                removed.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
            columns = [batch.column("_id"), *(pa.array(c, pa.int64()) for c in (sizes, lost, counts)), pa.array(digests, pa.string()), pa.array(removed, span)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return read


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text``, ``_seq`` (order of the identifier), ``_key`` and ``_tag``, which find a row again."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    if isinstance(type_of(docs, id_col), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        placed = source.withColumn("_seq", F.col("_id").cast("bigint"))
    else:
        order = ordered_position(source.select("_id").filter(F.col("_id").isNotNull()).distinct(), [F.col("_id").asc()], "_seq")
        placed = source.join(order, "_id", "left")
    tag = F.xxhash64("_text")
    return placed.select("_id", "_text", F.coalesce("_seq", F.lit(_LAST)).alias("_seq"), F.coalesce("_seq", tag).alias("_key"), tag.alias("_tag"))


def _release(spark) -> None:
    """Spark deletes the shuffle files of a finished step once the driver has collected what refers to them.

    Python's references keep those of the JVM alive, and the JVM's are queued before they are dropped, so it takes two turns.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: identifier, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``removed`` byte ranges."""
    spark = ready(docs.sparkSession)
    id_type = type_of(docs, id_col)
    rows = _keyed(docs, id_col, text_col)
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = rows.select("_key", "_text").mapInArrow(_anchor_rows(n_buckets), "_b bigint, _v binary, _k binary, _c binary")
    repeated = anchors.groupBy("_b").applyInPandas(_repeated_values(n_buckets), "_r bigint, _v binary, _k binary")
    wanted = store(repeated.groupBy("_r").applyInPandas(_values_of_rows, "_key bigint, _vs binary"), "suffix-anchors")
    _release(spark)
    live = rows.select("_seq", "_key", "_tag", "_text").join(wanted.df, "_key")
    blocks = store(live.mapInArrow(_live_blocks, _BLOCKS), "suffix-blocks")
    wanted.discard()
    _release(spark)
    blocks = exchange(blocks, _stretch_keys, _first_stretches, "first", _stretch_places)
    _release(spark)
    blocks = exchange(blocks, _anchor_keys, _still_shared, "shared")
    _release(spark)
    for keys_of in (_triple_keys, _recursed_keys, _last_keys):
        blocks = exchange(blocks, keys_of, _named)
        _release(spark)
    for distance in range(3):
        blocks = exchange(blocks, _merge_keys(distance), _noted, "first", _places)
        _release(spark)
    spans = blocks.df.mapInArrow(_range_rows, "_key bigint, _tag bigint, _spans binary").groupBy("_key", "_tag").agg(F.collect_list("_spans").alias("_all"))
    spans = store(spans, "suffix-spans").df
    _release(spark)
    out = schema_of(("_id", id_type), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"),
                    ("removed", "array<struct<start:bigint,end:bigint>>"))
    found = rows.join(spans, ["_key", "_tag"], "left").select("_id", "_text", "_all").mapInArrow(_cut(to_arrow_type(id_type)), out)
    return found.withColumnRenamed("_id", id_col)
