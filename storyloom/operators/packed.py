"""Ids of words, counts of pairs and losses of sequences with tables that no worker can hold, without a row for each position.

Texts or sequences are packed into blocks. A block seeks each of its distinct words once and makes ids of its texts where they lie. A block asks for each of its distinct pairs and contexts once; questions and counts are dealt to buckets
by a hash of the key, so no key that occurs often gathers rows in one task, and the answers go back to the block, where the
positions lie. Keys are sorted and sent as differences, cut to planes of bytes, which compress well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.scratch import store

# Ids of a block, unless a single sequence is longer.
BLOCK_IDS = 1 << 19
# Counts and questions of a bucket, about.
BUCKET_KEYS, BUCKET_ASKS = 250_000, 1_000_000
# Ids are below this bound; others are in no count and share one number, and so do empty ones.
ID_BOUND = 1 << 31
_OTHER, _EMPTY = np.uint64((1 << 32) - 2), np.uint64((1 << 32) - 3)
_NULL = np.iinfo(np.int64).min
_ODD = np.uint64(0x9E3779B97F4A7C15)


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, lowest first, as many as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    wide[:, : data[0]] = rows.T
    return wide.view("<u8").ravel()


def _sorted_planes(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _sorted_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def _numbers(ids: np.ndarray) -> np.ndarray:
    known = np.where((ids < 0) | (ids >= ID_BOUND), _OTHER, ids.astype(np.uint64))
    known[ids == _NULL] = _EMPTY
    return known


def _keys(contexts: np.ndarray, targets: np.ndarray | None) -> np.ndarray:
    """One number for a pair, or for a context alone."""
    high = contexts << np.uint64(32)
    return high if targets is None else high | (targets + np.uint64(1))


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    h = keys * _ODD
    h ^= h >> np.uint64(29)
    h *= _ODD
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that takes sorted keys bucket by bucket, and where each bucket begins and ends."""
    bucket = _buckets(keys, n)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))


def _packed(doc_type: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            owners = pa.concat_arrays(docs)
            listed = pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners)
            size, flat = np.concatenate(lengths), np.concatenate(ids)
            body = [pa.array([planes(size.astype(np.uint64))], pa.binary()), pa.array([planes(_numbers(flat))], pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | made], pa.int64()), listed, *body, pa.array([len(flat)], pa.int64())],
                names=["_block", "_docs", "_lengths", "_ids", "_n"],
            )

        for batch in batches:
            column = batch.column("ids")
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().fill_null(int(_NULL)).to_numpy(zero_copy_only=False)
            ends, low = np.cumsum(size), 0
            while low < len(size):
                begin = int(ends[low] - size[low])
                high = max(low + 1, int(np.searchsorted(ends, begin + BLOCK_IDS - held, side="right")))
                docs.append(batch.column("doc_id").slice(low, high - low))
                lengths.append(size[low:high])
                ids.append(flat[begin : int(ends[high - 1])])
                held, low = held + int(ends[high - 1]) - begin, high
                if held >= BLOCK_IDS or low < len(size):
                    yield row()
                    made, docs, lengths, ids, held = made + 1, [], [], [], 0
        if docs:
            yield row()

    return read


def _questions(lengths: bytes, ids: bytes, pad: int | None, buckets: int) -> tuple:
    """Of a block: its sorted keys, their order by bucket and its bounds, and of each scored position its sequence, pair and context."""
    size, flat = unplanes(lengths).astype(np.int64), unplanes(ids)
    owner = np.repeat(np.arange(len(size)), size)
    scored = owner[1:] == owner[:-1]
    if pad is not None:
        scored &= (flat[1:] != pad) & (flat[1:] != _EMPTY)
    contexts, targets = flat[:-1][scored], flat[1:][scored]
    pairs, pair = np.unique(_keys(contexts, targets), return_inverse=True)
    alone, context = np.unique(_keys(contexts, None), return_inverse=True)
    keys = np.concatenate((pairs, alone))
    by_key = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), dtype=np.int64)
    place[by_key] = np.arange(len(keys))
    keys = keys[by_key]
    order, bounds = _by_bucket(keys, buckets)
    return keys, order, bounds, len(size), owner[1:][scored], place[pair], place[len(pairs) + context]


def _ask(pad: int | None, buckets: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, order, bounds, *_ = _questions(r["_lengths"], r["_ids"], pad, buckets)
                used = np.flatnonzero(np.diff(bounds)).tolist()
                sent = [_sorted_planes(keys[order[bounds[b] : bounds[b + 1]]]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([r["_block"]] * len(used), pa.int64()), pa.array(sent, pa.binary()), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary())],
                    names=["_bucket", "_block", "_keys", "_counts", "_means"],
                )

    return read


def _known(buckets: int):
    """Counts of pairs, and of contexts where the target is null, dealt to buckets."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        contexts = table.column("context").to_numpy().astype(np.uint64)
        targets = table.column("target").fill_null(-1).to_numpy()
        keys = np.where(targets < 0, _keys(contexts, None), _keys(contexts, np.maximum(targets, 0).astype(np.uint64)))
        by_key = np.argsort(keys, kind="stable")
        order, bounds = _by_bucket(keys[by_key], buckets)
        counts, means = table.column("count").to_numpy().astype(np.uint64), table.column("mean").to_numpy()
        used, sent = np.flatnonzero(np.diff(bounds)).tolist(), ([], [], [])
        for b in used:
            some = by_key[order[bounds[b] : bounds[b + 1]]]
            for made, data in zip(sent, (_sorted_planes(keys[some]), planes(counts[some]), means[some].astype("<f8").tobytes())):
                made.append(data)
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), *(pa.array(s, pa.binary()) for s in sent)],
            names=["_bucket", "_block", "_keys", "_counts", "_means"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_IDS:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return read


def _answer(means: bool):
    """What the keys that blocks ask for have; nothing where they are in no count."""

    def read(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told = [r for r in rows if r["_block"] is None]
        asked = [r for r in rows if r["_block"] is not None]
        keys = np.concatenate([_sorted_keys(r["_keys"]) for r in told] or [np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        counts = np.concatenate([unplanes(r["_counts"]) for r in told] or [np.zeros(0, np.uint64)])[order]
        mean = np.concatenate([np.frombuffer(r["_means"], dtype="<f8") for r in told] or [np.zeros(0)])[order]
        keys = keys[order]
        out: dict = {"_block": [], "_bucket": [], "_counts": [], "_means": []}
        for r in asked:
            wanted = _sorted_keys(r["_keys"])
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
            found = np.zeros(len(wanted), dtype=np.uint64)
            found[hit] = counts[at[hit]]
            out["_block"].append(r["_block"])
            out["_bucket"].append(r["_bucket"])
            out["_counts"].append(planes(found))
            if means:
                # Only contexts have a mean; one that is in no count has none.
                alone = wanted & np.uint64(0xFFFFFFFF) == 0
                of = np.full(len(wanted), np.nan)
                of[hit] = mean[at[hit]]
                out["_means"].append(of[alone].astype("<f8").tobytes())
            else:
                out["_means"].append(None)
        kinds = {"_block": pa.int64(), "_bucket": pa.int32(), "_counts": pa.binary(), "_means": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return read


def _scored(pad: int | None, buckets: int, alpha: float, vocab_size: int, smoothing: float, doc_type: pa.DataType):
    v = float(vocab_size)

    def read(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = next(r for r in rows if r["_bucket"] is None)
        keys, order, _, n, owner, pair, context = _questions(block["_lengths"], block["_ids"], pad, buckets)
        answers = sorted((r for r in rows if r["_bucket"] is not None), key=lambda r: r["_bucket"])
        counts = np.empty(len(keys))
        if answers:
            counts[order] = np.concatenate([unplanes(r["_counts"]) for r in answers])
        freq, total = counts[pair], counts[context] + alpha * v
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total == 0, np.nan, (freq + alpha) / total)
            loss = np.where(p <= 0, np.inf, -np.log(p))
            if smoothing:
                means = np.full(len(keys), np.nan)
                alone = order[keys[order] & np.uint64(0xFFFFFFFF) == 0]
                if answers:
                    means[alone] = np.concatenate([np.frombuffer(r["_means"], dtype="<f8") for r in answers])
                mean = means[context]
                mean = np.where(np.isnan(mean), np.log(total) - np.log(alpha), mean)
                loss = (1 - smoothing) * loss + smoothing * mean
        number = np.bincount(owner, minlength=n)
        summed = np.bincount(owner, weights=loss, minlength=n)
        some = np.flatnonzero(number)
        docs = pa.array(block["_docs"], doc_type).take(pa.array(some))
        return pa.table({"doc_id": docs, "nll_sum": pa.array(summed[some]), "n_tokens": pa.array(number[some], pa.int64())})

    return read


def row_losses(sequences: DataFrame, pairs: DataFrame, contexts: DataFrame, n_known: int, alpha: float, vocab_size: int, smoothing: float, pad: int | None) -> DataFrame:
    """``doc_id``, ``nll_sum`` and ``n_tokens`` of every row of ``sequences`` (``doc_id``, ``ids``) that has a scored position.

    ``pairs`` (``context``, ``target``, ``freq``) and ``contexts`` (``context``, ``total``, ``seen``, ``log_sum``) hold each key once.
    """
    kind = sequences.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    layout = T.StructType([
        T.StructField("_block", T.LongType()), T.StructField("_docs", T.ArrayType(kind)), T.StructField("_lengths", T.BinaryType()),
        T.StructField("_ids", T.BinaryType()), T.StructField("_n", T.LongType()),
    ])
    # Stored, so that questions and scores see the same blocks.
    blocks = store(sequences.select("doc_id", F.col("ids").cast("array<bigint>").alias("ids")).mapInArrow(_packed(arrow), layout), "blocks").df
    n_ids = blocks.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, -(-n_known // BUCKET_KEYS), -(-n_ids // BUCKET_ASKS))
    counts = pairs.select("context", "target", F.col("freq").alias("count"), F.lit(0.0).alias("mean"))
    mean = F.lit(0.0)
    if smoothing:
        v = F.lit(float(vocab_size))
        mean = F.log(F.col("total") + F.lit(alpha) * v) - (F.col("log_sum") + (v - F.col("seen")) * F.log(F.lit(alpha))) / v
    totals = contexts.select("context", F.lit(None).cast("bigint").alias("target"), F.col("total").alias("count"), mean.alias("mean"))
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < ID_BOUND)
    known = counts.filter(inside("context") & inside("target")).unionByName(totals.filter(inside("context")))
    dealt = "_bucket int, _block bigint, _keys binary, _counts binary, _means binary"
    both = known.mapInArrow(_known(buckets), dealt).unionByName(blocks.mapInArrow(_ask(pad, buckets), dealt))
    answers = both.groupBy("_bucket").applyInArrow(_answer(bool(smoothing)), "_block bigint, _bucket int, _counts binary, _means binary")
    met = blocks.drop("_n").unionByName(answers, allowMissingColumns=True)
    scored = T.StructType([T.StructField("doc_id", kind), T.StructField("nll_sum", T.DoubleType()), T.StructField("n_tokens", T.LongType())])
    return met.groupBy("_block").applyInArrow(_scored(pad, buckets, alpha, vocab_size, smoothing, arrow), scored)


def _word_blocks(key_type: pa.DataType, names: list[str]):
    """Rows of word lists as blocks: their keys, the length of each list, the distinct words, and the place of each word among them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        owners, lengths, words, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            keys = pa.concat_arrays(owners)
            coded = pa.concat_arrays(words).dictionary_encode()
            # A word that is missing has the place after the last one.
            places = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | made], pa.int64()), whole(keys), pa.array([planes(np.concatenate(lengths).ravel().astype(np.uint64))], pa.binary()),
                    pa.array([planes(places.astype(np.uint64))], pa.binary()), whole(coded.dictionary.cast(pa.string())), pa.array([len(places)], pa.int64()),
                ],
                names=["_block", "_keys", "_lengths", "_places", "_words", "_n"],
            )

        for batch in batches:
            column = batch.column("_w")
            # Of a row with a list that is null no list has words.
            whole = column.is_valid().to_numpy(zero_copy_only=False)
            size = np.stack([np.where(whole, batch.column(f"_s{k}").fill_null(0).to_numpy(), 0) for k in range(len(names))], axis=1).astype(np.int64)
            flat, ends, low = column.flatten(), np.cumsum(size.sum(axis=1)), 0
            while low < len(size):
                begin = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, begin + BLOCK_IDS - held, side="right")))
                owners.append(batch.column("_key").slice(low, high - low))
                lengths.append(size[low:high])
                words.append(flat.slice(begin, int(ends[high - 1]) - begin))
                held, low = held + int(ends[high - 1]) - begin, high
                if held >= BLOCK_IDS or low < len(size):
                    yield row()
                    made, owners, lengths, words, held = made + 1, [], [], [], 0
        if owners:
            yield row()

    return read


class Words:
    """Lists of words in stored blocks whose distinct words have met a vocabulary."""

    def __init__(self, rows: DataFrame, lists: dict, vocab: DataFrame, key: str, unknown: int):
        self.names, self.key, self.unknown = list(lists), key, unknown
        self.kind = rows.schema[key].dataType
        layout = T.StructType([
            T.StructField("_block", T.LongType()), T.StructField("_keys", T.ArrayType(self.kind)), T.StructField("_lengths", T.BinaryType()),
            T.StructField("_places", T.BinaryType()), T.StructField("_words", T.ArrayType(T.StringType())), T.StructField("_n", T.LongType()),
        ])
        cut = rows.select(F.col(key).alias("_key"), *[c.alias(f"_l{k}") for k, c in enumerate(lists.values())])
        sizes = [F.size(f"_l{k}").alias(f"_s{k}") for k in range(len(lists))]
        words = F.concat(*[f"_l{k}" for k in range(len(lists))]).alias("_w")
        self.blocks = store(cut.select("_key", words, *sizes).mapInArrow(_word_blocks(to_arrow_type(self.kind), self.names), layout), "words").df
        # Every word is sought once for each block that has it.
        sought = self.blocks.select("_block", F.inline(F.transform("_words", lambda w, i: F.struct(i.alias("_at"), w.alias("token")))))
        found = sought.hint("merge").join(vocab.select("token", "id"), "token", "left").select("_block", "_at", F.col("id").alias("_id"))
        self.met = self.blocks.select("_block", "_keys", "_lengths", "_places").unionByName(found, allowMissingColumns=True).groupBy("_block")

    def ids(self) -> DataFrame:
        """The key and the lists of ids of every row."""
        names, kind, unknown = [f"_l{k}" for k in range(len(self.names))], to_arrow_type(self.kind), self.unknown

        def read(table: pa.Table) -> pa.Table:
            keys, lengths, ids = _read_words(table, unknown)
            lists, ends = lengths.reshape(len(keys), -1), np.concatenate(([0], np.cumsum(lengths)))
            cut = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            return pa.table({"_key": pa.array(keys, kind), **{n: cut.take(pa.array(np.arange(len(keys)) * lists.shape[1] + k)) for k, n in enumerate(names)}})

        layout = T.StructType([T.StructField("_key", self.kind), *(T.StructField(n, T.ArrayType(T.LongType())) for n in names)])
        return self.met.applyInArrow(read, layout).select(F.col("_key").alias(self.key), *[F.col(n).alias(name) for n, name in zip(names, self.names)])

    def bigrams(self) -> DataFrame:
        """How often a word comes after another in the lists: ``context``, ``target``, ``freq``."""
        total = self.blocks.agg(F.sum("_n")).first()[0] or 0
        buckets, unknown = max(1, -(-total // BUCKET_ASKS)), self.unknown

        def part(table: pa.Table) -> pa.Table:
            _, lengths, ids = _read_words(table, unknown)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            inside = owner[1:] == owner[:-1]
            keys, counts = np.unique(_keys(ids[:-1][inside].astype(np.uint64), ids[1:][inside].astype(np.uint64)), return_counts=True)
            order, bounds = _by_bucket(keys, buckets)
            used = np.flatnonzero(np.diff(bounds)).tolist()
            some = [order[bounds[b] : bounds[b + 1]] for b in used]
            return pa.table({
                "_bucket": pa.array(used, pa.int32()), "_pairs": pa.array([_sorted_planes(keys[s]) for s in some], pa.binary()),
                "_counts": pa.array([planes(counts[s].astype(np.uint64)) for s in some], pa.binary()),
            })

        def summed(table: pa.Table) -> pa.Table:
            keys = np.concatenate([_sorted_keys(x) for x in table.column("_pairs").to_pylist()])
            counts = np.concatenate([unplanes(x) for x in table.column("_counts").to_pylist()])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            some = keys[first]
            return pa.table({
                "context": (some >> np.uint64(32)).astype(np.int64), "target": (some & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1,
                "freq": np.add.reduceat(counts, first).astype(np.int64),
            })

        parts = self.met.applyInArrow(part, "_bucket int, _pairs binary, _counts binary")
        return parts.groupBy("_bucket").applyInArrow(summed, "context bigint, target bigint, freq bigint")


def _read_words(table: pa.Table, unknown: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, lengths of their lists and all ids of a block, from its row and those of its words."""
    own = table.column("_at").is_null()
    block, told = table.filter(own).to_pylist()[0], table.filter(pc.invert(own))
    at, ids = told.column("_at").to_numpy(), told.column("_id").fill_null(unknown).to_numpy()
    number = np.full(len(at) + 1, unknown, dtype=np.int64)
    number[at] = ids
    return block["_keys"], unplanes(block["_lengths"]).astype(np.int64), number[unplanes(block["_places"]).astype(np.int64)]


def encoded(rows: DataFrame, lists: dict, vocab: DataFrame, key: str, unknown: int) -> DataFrame:
    """``key`` and the ids of its lists of words. Of rows that share a key, ids follow one another by place, then by id."""
    words = Words(rows, lists, vocab, key, unknown)
    ids = words.ids()
    owners = words.blocks.select(F.explode("_keys").alias(key))
    shared = store(owners.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_shared")), "shared")
    if not shared.rows:
        return ids
    same = F.col(key).eqNullSafe(F.col("_shared"))
    at = lambda n, start: F.transform(n, lambda v, i: F.struct((start + i).alias("pos"), v.alias("v")))
    start, placed, merged = F.lit(0), [], []
    for k, n in enumerate(words.names):
        placed.append(at(n, start).alias(f"_e{k}"))
        merged.append(F.sort_array(F.flatten(F.collect_list(f"_e{k}")))["v"].alias(n))
        start = start + F.size(n)
    several = ids.join(shared.df, same, "left_semi").select(key, *placed).groupBy(key).agg(*merged)
    return ids.join(shared.df, same, "left_anti").unionByName(several)
