"""Removal of lines whose template recurs across documents.

A tree of fixed depth sorts lines: first by the number of their tokens, then by the leading tokens, where a token with a digit
stands as a variable field. Within a leaf a token's support is the number of different texts, added up over different lines, that
have it at its place. A leaf is split by support: for every doubling of ``min_documents`` that a line's tokens reach, the tokens of at
least that support are kept and all others are variable fields. So a line has one generalisation for each of these levels, and
neither a frequent line nor any number of other templates in its leaf takes one from it. A generalisation that keeps fewer than half of
the tokens, or of those after the leading ones that have no digit, does not count: such lines merely begin alike. The line with its
digits masked is a template of its own as well. Lines of which one template occurs in ``min_documents`` different texts go. Copies of
a text count as one, so the lines of copied documents are not taken for boilerplate.

1. A first pass counts the texts of every leaf. Leaves with enough of them are kept as an exact table and, for the second pass
   over the texts, as 2**26 bits that are broadcast (8 MB, a constant): a bit that several leaves share lets a few lines
   too many through, and a join with the exact table takes them out again.
2. Only lines of such leaves are written, as hashes of their tokens. Equal lines are one kind from there on, so supports are counted
   and levels joined over different lines only, by tokens that are dealt over several keys; what a kind's templates need of its
   texts is at most ``min_documents`` of them, as a kind with that many makes all its templates recur.
3. The numbers of the lines that go are gathered by document and joined with the texts, which move once.

Defined results: lines end at line feeds; a null text counts as empty, with one empty line; blank lines stay; rows that share
identifier and text are treated alike; no rows give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import BASES, hash_words, mix, ready, schema_of, text_or_empty, text_slices, type_of, words_of
from storyloom.scratch import store

DEPTH = 3
MIN_DOCUMENTS = 10
# The least share of tokens that a generalised template keeps, of all and of those without digits after the leading ones.
KEPT = 0.5
# Keys over which a token of a leaf is dealt where levels are joined.
SALTS = 8
LEAF_BITS = 26
# Fixed value: Spark's bitmap aggregates hold this many bits.
_BITMAP = 32_768
VARIABLE = 1


def _leaves(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its number, the leaf of each line (0 for blank lines), the masked token hashes and where lines begin."""
    for first, data, offsets in text_slices(texts):
        feeds = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
        counts = 1 + np.diff(np.searchsorted(feeds, offsets))
        # A line feed at the end of a text opens an empty line there, before the next text.
        bounds = np.append(starts, len(data))
        _, begins, ends, at = words_of(data, bounds, lower=False)
        hashed = hash_words(data, begins, ends, BASES[0])
        if len(begins):
            digit = (data >= 48) & (data <= 57)
            upto = np.concatenate(([0], np.cumsum(digit)))
            hashed[upto[ends] > upto[begins]] = np.uint64(VARIABLE)
        sizes = np.diff(at)
        leaf = sizes.astype(np.uint64) * np.uint64(BASES[1])
        for k in range(DEPTH):
            has = sizes > k
            lead = np.full(len(sizes), 2, dtype=np.uint64)
            lead[has] = hashed[at[:-1][has] + k]
            leaf = mix(leaf + lead * np.uint64(BASES[2]))
        leaf[sizes == 0] = 0
        low = 0
        for k, n in enumerate(counts.tolist()):
            yield first + k, leaf[low : low + n].view(np.int64), hashed, at[low : low + n + 1]
            low += n


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf of a text once, with the hash of the text."""
    for batch in batches:
        where, found = [], []
        for i, leaves, _, _ in _leaves(batch.column("_text")):
            own = np.unique(leaves[leaves != 0])
            where.append(np.full(len(own), i))
            found.append(own)
        if where:
            texts = batch.column("_hash").take(pa.array(np.concatenate(where)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), texts], names=["_leaf", "_hash"])


def _second_pass(shared):
    """Lines whose leaf has its bit set, as masked token hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            where, found, numbers, tokens = [], [], [], []
            for i, leaves, hashed, at in _leaves(batch.column("_text")):
                place = leaves.view(np.uint64) >> np.uint64(64 - LEAF_BITS)
                likely = ((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & (leaves != 0)
                for k in np.flatnonzero(likely).tolist():
                    where.append(i)
                    found.append(int(leaves[k]))
                    numbers.append(k)
                    tokens.append(hashed[at[k] : at[k + 1]].view(np.int64))
            rows = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(rows), batch.column("_hash").take(rows), pa.array(found, pa.int64()),
                    pa.array(numbers, pa.int32()), pa.array(tokens, pa.list_(pa.int64())),
                ],
                names=["_id", "_hash", "_leaf", "_line", "_tokens"],
            )

    return read


def _leaf_bits(leaves: DataFrame) -> np.ndarray:
    place = F.shiftrightunsigned("_leaf", 64 - LEAF_BITS) + 1
    maps = leaves.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((1 << LEAF_BITS) // 8, dtype=np.uint8)
    for r in maps.collect():
        low = (r["bucket"] - 1) * _BITMAP // 8
        bits[low : low + _BITMAP // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def _recurring(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Keys that occur in at least ``least`` different texts."""
    counted = rows.select(key, "_hash").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_texts"))
    return store(counted.filter(F.col("_texts") >= least).select(key), "recurring").df


def _levels(kinds: DataFrame, least: int) -> DataFrame:
    """For each kind of line the tokens after the leading ones that ``least`` texts have at the place: place and doublings of it."""
    placed = kinds.select("_kind", "_leaf", "_texts", F.posexplode("_tokens").alias("_at", "_token"))
    placed = placed.filter((F.col("_at") >= DEPTH) & (F.col("_token") != VARIABLE))
    support = placed.groupBy("_leaf", "_at", "_token").agg(F.sum("_texts").alias("_n")).filter(F.col("_n") >= least)
    level = F.length(F.bin(F.expr(f"_n div {least}"))).alias("_level")
    salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("_salt")
    known = support.select("_leaf", "_at", "_token", level, salts)
    dealt = placed.withColumn("_salt", F.pmod("_kind", F.lit(SALTS)).cast("int"))
    joined = dealt.join(known, ["_leaf", "_at", "_token", "_salt"])
    return joined.groupBy("_kind").agg(F.collect_list(F.struct("_at", "_level")).alias("_levels"))


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different templates of each kind of line: itself and its generalisations."""
    for batch in batches:
        kinds, texts, leaves = (batch.column(c).to_pylist() for c in ("_kind", "_texts", "_leaf"))
        rows, made = [], []
        for i, leaf in enumerate(leaves):
            tokens = batch.column("_tokens")[i].values.to_numpy()
            level = np.zeros(len(tokens), dtype=np.int64)
            found = batch.column("_levels")[i]
            if found.is_valid:
                level[found.values.field("_at").to_numpy()] = found.values.field("_level").to_numpy()
            reached = np.unique(level[level > 0]).tolist()
            level[:DEPTH] = np.iinfo(np.int64).max
            own = {_named(leaf, tokens)}
            plain = tokens != VARIABLE
            for least in reached:
                stays = plain & (level >= least)
                if stays.sum() >= KEPT * len(tokens) and stays[DEPTH:].sum() >= KEPT * plain[DEPTH:].sum():
                    own.add(_named(leaf, np.where(stays, tokens, VARIABLE)))
            made.extend(own)
            rows.extend([i] * len(own))
        columns = [pa.array([c[i] for i in rows], pa.int64()) for c in (kinds, texts)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.int64())], names=["_kind", "_texts", "_template"])


def _named(leaf: int, tokens: np.ndarray) -> int:
    digest = xxhash.xxh3_64_digest(struct.pack("<q", leaf) + tokens.astype(np.int64).tobytes())
    return struct.unpack("<q", digest)[0]


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, dropped, kept = [], [], []
        for text, gone in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist()):
            sizes.append(text.count("\n") + 1)
            dropped.append(len(gone or ()))
            if gone:
                numbers = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers)
            kept.append(text)
        columns = [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_lines", "n_dropped", "kept"])


def drop_recurring_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each input row: identifier, ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    spark = ready(docs.sparkSession)
    id_type = type_of(docs, id_col)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    leaves = _recurring(source.select("_hash", "_text").mapInArrow(_first_pass, "_leaf bigint, _hash bigint"), "_leaf", min_documents)
    shared = spark.sparkContext.broadcast(_leaf_bits(leaves))
    line = schema_of(("_id", id_type), ("_hash", "bigint"), ("_leaf", "bigint"), ("_line", "int"), ("_tokens", "array<bigint>"))
    found = source.mapInArrow(_second_pass(shared), line).join(leaves, "_leaf", "left_semi")
    lines = store(found.withColumn("_kind", F.xxhash64("_leaf", "_tokens")), "lines").df

    pairs = store(lines.select("_kind", "_hash").distinct(), "line-texts").df
    texts = pairs.groupBy("_kind").agg(F.count(F.lit(1)).alias("_texts"))
    kinds = store(lines.select("_kind", "_leaf", "_tokens").distinct().join(texts, "_kind"), "line-kinds").df
    levels = _levels(kinds, min_documents).withColumnRenamed("_kind", "_of")
    named = kinds.join(levels, F.col("_kind") == F.col("_of"), "left").select("_kind", "_leaf", "_texts", "_tokens", "_levels")
    made = store(named.mapInArrow(_templates, "_kind bigint, _texts bigint, _template bigint"), "templates").df
    several = F.col("_texts") >= min_documents
    few = made.filter(~several).select("_kind", "_template").join(pairs, "_kind").select("_template", "_hash")
    few = few.distinct().groupBy("_template").agg(F.count(F.lit(1)).alias("_texts")).filter(several)
    recurring = store(few.select("_template").union(made.filter(several).select("_template")).distinct(), "recurring").df
    gone = lines.join(made.join(recurring, "_template", "left_semi").select("_kind").distinct(), "_kind", "left_semi")
    gone = gone.groupBy(F.col("_id").alias("_key"), F.col("_hash").alias("_of")).agg(F.collect_set("_line").alias("_gone"))
    joined = source.join(gone, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_of")), "left")
    out = schema_of(("_id", id_type), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept", "string"))
    return joined.select("_id", "_text", "_gone").mapInArrow(_without_lines, out).withColumnRenamed("_id", id_col)
