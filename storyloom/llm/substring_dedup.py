"""Removal of passages of 50 words that an earlier document already has.

1. One pass over all texts takes, for every window of 50 words, the smallest hash of its 26 sub-windows of 25 words. Equal
   windows have equal minima, and neighbouring windows mostly share theirs, so a text gives one value for about 13 windows.
   Each task counts in a count-min sketch of fixed size in how many texts a value occurs. The sketches are cut into blocks
   and added up over a tree; a counter never falls below the number of texts that share a window.
2. Blocks shrink to one bit a cell, "two texts or more", and the bits (8 MB, a constant) are broadcast. A second pass emits
   only values whose cells all have the bit; they are grouped exactly, and those of a single word sequence go. Where a larger
   corpus fills the sketch, more values pass the filter and are grouped, and none is lost.
3. Only texts with a surviving value are joined with them and emit their windows under a 128-bit hash. Windows are grouped
   exactly: smallest identifier for each hash, combined before the shuffle, joined back with skew handling.
4. Words under a window that starts in a document with a smaller identifier are removed.

Texts of one word sequence are represented by the smallest identifier from step 3 on; copies with larger identifiers lose
all words if they have a window at all.

Defined results: a null text has no words; a null identifier is smaller than none, so such rows lose nothing and take
nothing; rows that share an identifier never take from one another; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.llm.common import BASES, hash_words, mix, ready, rolling, schema_of, text_or_empty, text_slices, type_of, words_of
from storyloom.scratch import store

WINDOW = 50
PART = 25
# The sketch: rows, cells of a row, cells of a block, and how many tasks a node of the merge tree adds up.
ROWS = 2
CELL_BITS = 25
BLOCK_BITS = 16
FAN_IN = 1024
RANGES = "array<struct<start:bigint,end:bigint>>"


def window_minima(hashed: np.ndarray) -> np.ndarray:
    """For each window of ``WINDOW`` words the smallest hash of its sub-windows of ``PART`` words."""
    least, width, span = rolling(hashed, PART, BASES[1]), 1, WINDOW - PART + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _cells(values: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return (mix(values + np.uint64(BASES[row])) >> np.uint64(64 - cell_bits)).astype(np.int64)


def _documents(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Number, bytes, word hashes and window minima of each text."""
    for first, data, offsets in text_slices(texts):
        _, starts, ends, at = words_of(data, offsets, lower=False)
        hashed = hash_words(data, starts, ends, BASES[0])
        minima = window_minima(hashed) if len(hashed) >= WINDOW else np.zeros(0, dtype=np.uint64)
        for k in range(len(offsets) - 1):
            low, high = int(at[k]), int(at[k + 1])
            yield first + k, data[offsets[k] : offsets[k + 1]].tobytes(), hashed[low:high], minima[low : max(low, high - WINDOW + 1)]


def _sequence(hashed: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashed.tobytes())


def _short(sequence: bytes) -> int:
    return int.from_bytes(sequence[:8], "little", signed=True)


_PROFILE = ["_id", "_n", "_seq", "_s", "_sha", "_row", "_block", "_part", "_cells"]


def _profile(id_type: pa.DataType, cell_bits: int, block_bits: int):
    """Words, sequence and digest of each text; at the end the blocks of the task's sketch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        for batch in batches:
            counts, sequences, digests = [], [], []
            for _, raw, hashed, minima in _documents(batch.column("_text")):
                counts.append(len(hashed))
                sequences.append(_sequence(hashed))
                digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                if len(minima):
                    if sketch is None:
                        sketch = np.zeros((ROWS, 1 << cell_bits), dtype=np.uint8)
                    values = np.unique(minima)
                    for row in range(ROWS):
                        # Values of one text that meet in a cell count once: still one for each text.
                        cells = _cells(values, row, cell_bits)
                        sketch[row, cells] = np.minimum(sketch[row, cells], 254) + 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array(counts, pa.int64()), pa.array(sequences, pa.binary()),
                    pa.array([_short(s) for s in sequences], pa.int64()), pa.array(digests, pa.string()),
                    *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.nulls(n, pa.binary()),
                ],
                names=_PROFILE,
            )
        if sketch is not None:
            part, blocks = TaskContext.get().partitionId(), sketch.reshape(ROWS, -1, 1 << block_bits)
            for row in range(ROWS):
                used = np.flatnonzero(blocks[row].any(axis=1))
                for k in range(0, len(used), 64):
                    some = used[k : k + 64].tolist()
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()),
                            pa.array([row] * n, pa.int32()), pa.array(some, pa.int32()), pa.array([part] * n, pa.int32()),
                            pa.array([zlib.compress(blocks[row, b], 1) for b in some], pa.binary()),
                        ],
                        names=_PROFILE,
                    )

    return read


def _added(rows: pd.DataFrame) -> np.ndarray:
    """The sum of the packed blocks; counters stay at 255."""
    total = None
    for packed in rows["_cells"]:
        more = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        total = more if total is None else np.where(total > 255 - more, 255, total + more).astype(np.uint8)
    return total


def _add_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"_row": [key[0]], "_block": [key[1]], "_cells": [zlib.compress(_added(rows), 1)]})


def _block_bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"_row": [key[0]], "_block": [key[1]], "_bits": [np.packbits(_added(rows) >= 2).tobytes()]})


def _shared_cells(profiles: DataFrame, cell_bits: int, block_bits: int) -> list[np.ndarray]:
    """For each row of the sketch one bit for each cell that two texts or more touch. Of constant size."""
    blocks = profiles.filter(F.col("_row").isNotNull()).select("_row", "_block", "_part", "_cells")
    nodes = blocks.groupBy("_row", "_block", F.pmod("_part", F.lit(FAN_IN)).alias("_node")).applyInPandas(
        _add_blocks, "_row int, _block int, _cells binary"
    )
    bits = [np.zeros((1 << cell_bits) // 8, dtype=np.uint8) for _ in range(ROWS)]
    size = (1 << block_bits) // 8
    for r in nodes.groupBy("_row", "_block").applyInPandas(_block_bits, "_row int, _block int, _bits binary").collect():
        bits[r["_row"]][r["_block"] * size : (r["_block"] + 1) * size] = np.frombuffer(r["_bits"], dtype=np.uint8)
    return bits


def _maybe_shared(shared, cell_bits: int):
    """Values of each text that the sketch gives to two texts or more, with a hash of the text's word sequence."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            where, values, sequences = [], [], []
            for i, _, hashed, minima in _documents(batch.column("_text")):
                if not len(minima):
                    continue
                own = np.unique(minima)
                ok = np.ones(len(own), dtype=bool)
                for row in range(ROWS):
                    cells = _cells(own, row, cell_bits)
                    ok &= ((bits[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
                own = own[ok]
                where.append(np.full(len(own), i))
                values.append(own)
                sequences.append(np.full(len(own), _short(_sequence(hashed))))
            if where:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(np.concatenate(where))), pa.array(np.concatenate(sequences).astype(np.int64)),
                        pa.array(np.concatenate(values).view(np.int64)),
                    ],
                    names=["_id", "_s", "_v"],
                )

    return read


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose value is shared: 128-bit hash, identifier, and place below a tag of the text's sequence."""
    for batch in batches:
        wanted, tags = batch.column("_vs").to_pylist(), batch.column("_s").to_pylist()
        where, first, second, places = [], [], [], []
        held = 0
        for i, _, hashed, minima in _documents(batch.column("_text")):
            if _short(_sequence(hashed)) != tags[i]:
                continue  # Another text of the same identifier.
            at = np.flatnonzero(np.isin(minima, np.array(wanted[i], dtype=np.int64).view(np.uint64)))
            if len(at):
                where.append(np.full(len(at), i))
                first.append(rolling(hashed, WINDOW, BASES[1])[at])
                second.append(rolling(mix(hashed + np.uint64(1)), WINDOW, BASES[2])[at])
                places.append(at.astype(np.int64) | (_tag(tags[i]) << 32))
                held += len(at)
            if held > 100_000:
                yield _window_rows(batch, where, first, second, places)
                where, first, second, places, held = [], [], [], [], 0
        if held:
            yield _window_rows(batch, where, first, second, places)


def _tag(sequence: int) -> int:
    return (sequence >> 33) & 0x7FFFFFFF


def _window_rows(batch: pa.RecordBatch, where, first, second, places) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_id").take(pa.array(np.concatenate(where))), pa.array(np.concatenate(first).view(np.int64)),
            pa.array(np.concatenate(second).view(np.int64)), pa.array(np.concatenate(places)),
        ],
        names=["_id", "_h", "_g", "_at"],
    )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text once the words under its covered windows are gone."""
    range_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        own, gone, digests, ranges = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("_text", "_s", "_starts"))
        for i, (raw, tag, starts) in enumerate(zip(*columns)):
            data = np.frombuffer(raw.encode(), dtype=np.uint8)
            _, begins, ends, _ = words_of(data, np.array([0, len(data)]), lower=False)
            if _short(_sequence(hash_words(data, begins, ends, BASES[0]))) != tag:
                continue  # Another text of the same identifier.
            own.append(i)
            words = raw.encode().split()
            places = np.array(starts, dtype=np.int64)
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, places, 1)
            np.add.at(depth, places + WINDOW, -1)
            covered = np.concatenate(([False], np.cumsum(depth[:-1]) > 0, [False]))
            turns = np.flatnonzero(covered[1:] != covered[:-1])
            ranges.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2])])
            gone.append(int(covered.sum()))
            digests.append(hashlib.sha256(b" ".join([w for w, c in zip(words, covered[1:-1].tolist()) if not c])).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(own, pa.int64())) for c in ("_id", "_s")), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(ranges, range_type)],
            names=["_id", "_s", "_gone", "_left", "_ranges"],
        )


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = CELL_BITS, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """One row for each input row: identifier, ``n_words``, ``n_removed``, ``kept_sha256`` and the ``removed`` word ranges."""
    spark = ready(docs.sparkSession)
    id_type = type_of(docs, id_col)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    profile = schema_of(
        ("_id", id_type), ("_n", "bigint"), ("_seq", "binary"), ("_s", "bigint"), ("_sha", "string"), ("_row", "int"), ("_block", "int"), ("_part", "int"), ("_cells", "binary")
    )
    profiles = store(source.mapInArrow(_profile(to_arrow_type(id_type), cell_bits, block_bits), profile), "profiles").df
    rows = profiles.filter(F.col("_row").isNull()).select("_id", "_n", "_seq", "_s", "_sha")
    firsts = rows.filter((F.col("_n") >= WINDOW) & F.col("_id").isNotNull()).groupBy("_seq").agg(F.min("_id").alias("_first"))

    shared = spark.sparkContext.broadcast(_shared_cells(profiles, cell_bits, block_bits))
    named = source.filter(F.col("_id").isNotNull())
    values = store(named.mapInArrow(_maybe_shared(shared, cell_bits), schema_of(("_id", id_type), ("_s", "bigint"), ("_v", "bigint"))), "values").df
    several = values.groupBy("_v").agg(F.min("_s").alias("_low"), F.max("_s").alias("_high")).filter("_low <> _high").select("_v")
    held = values.join(several, "_v").groupBy("_id", "_s").agg(F.collect_list("_v").alias("_vs"))
    # Copies with larger identifiers are settled already; only the first of each sequence takes part.
    leaders = rows.join(firsts, "_seq").filter("_id = _first").select("_id", "_s").distinct()
    texts = store(named.join(held.join(leaders, ["_id", "_s"], "left_semi"), "_id"), "texts").df
    windows = store(texts.mapInArrow(_windows, schema_of(("_id", id_type), ("_h", "bigint"), ("_g", "bigint"), ("_at", "bigint"))), "windows").df
    earliest = windows.groupBy("_h", "_g").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most")
    covered = windows.join(earliest.select("_h", "_g", "_least"), ["_h", "_g"]).filter("_id > _least")
    starts = covered.groupBy("_id", F.shiftright("_at", 32).alias("_tag")).agg(F.collect_list(F.col("_at").bitwiseAND(F.lit((1 << 32) - 1))).alias("_starts"))
    tag = F.shiftright("_s", 33).bitwiseAND(F.lit(0x7FFFFFFF))
    cut = texts.select("_id", "_s", "_text").withColumn("_tag", tag).join(starts, ["_id", "_tag"])
    parts = cut.select("_id", "_s", "_text", "_starts").mapInArrow(
        _remove, schema_of(("_id", id_type), ("_s", "bigint"), ("_gone", "bigint"), ("_left", "string"), ("_ranges", RANGES))
    ).dropDuplicates(["_id", "_s"])
    judged = rows.join(firsts, "_seq", "left").join(parts, ["_id", "_s"], "left")
    copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("_n").alias("end")))
    return judged.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_words"),
        F.when(copy, F.col("_n")).otherwise(F.coalesce("_gone", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_left", "_sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("_ranges", F.array().cast(RANGES))).alias("removed"),
    )
