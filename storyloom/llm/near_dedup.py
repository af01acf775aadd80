"""Near-duplicate components from SetSketch registers.

1. Every text becomes its set of five-word shingles (64-bit hashes) and a SetSketch of 128 registers: register i holds
   ``floor(1 - log_b h_i)`` of the smallest exponential value ``h_i`` among the shingles, cut to 0..q+1. Registers
   merge by maximum, and two texts agree in one about as often as their sets are similar.
2. Equal sets collapse to one node first, so a group of copies of any size costs one row from then on.
3. 32 bands of four registers make candidates: at a similarity of 0.75 a pair misses all with a chance of 5e-6. In each
   bucket all members are paired with one hub only, so a bucket of k makes k - 1 rows, not k squared.
4. A pair is dropped when the joint likelihood of all its registers speaks against 0.75 by six standard deviations
   (or the sizes of the sets alone rule it out). What is left is confirmed on the full sets, recomputed from the texts.
5. Confirmed links are contracted to components. Only buckets whose members still lie in different components can hide
   a link that no hub saw. Buckets that share members form a cluster; its members are dealt into blocks of about ``BLOCK``,
   and every two blocks meet in one task. There the full sets of all members are intersected by matrix products, and
   each link found merges two components, so a task emits fewer links than it has members and never the pairs. So no
   bucket is capped and no pair that shares a bucket is skipped.

Defined results: null or empty texts and texts of blanks have no shingle and are linked with nothing; one to four words
make one shingle, the whole sequence; a null identifier is never a component's identifier unless all its members have
none; rows that share an identifier are judged by their texts. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import BASES, hash_words, mix, ready, rolling, schema_of, text_or_empty, text_slices, type_of, words_of
from storyloom.llm.components import components
from storyloom.scratch import store

WORDS = 5
REGISTERS = 128
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
# SetSketch parameters: base, rate and the largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
# Natural-log likelihood ratio beyond which a pair is given up: six standard deviations.
GIVE_UP = 18.0
# Members and shingles of a block; two blocks are compared with one another in one task.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
# Shingles of a presence matrix.
_SHINGLES = 4096
_ROWS = 512

_numbers = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(BASES[0]))
_FACTOR, _SHIFT = _numbers[:REGISTERS] | np.uint64(1), _numbers[REGISTERS:]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    for _, data, offsets in text_slices(texts):
        lowered, starts, ends, first = words_of(data, offsets, lower=True)
        hashed = hash_words(lowered, starts, ends, BASES[0])
        windows = rolling(hashed, words, BASES[1])
        for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
            if high - low >= words:
                yield np.unique(windows[low : high - words + 1])
            elif high > low:
                # A short text is one shingle; its length keeps it apart from true shingles.
                yield mix(rolling(hashed[low:high], high - low, BASES[1]) + np.uint64(high - low))
            else:
                yield np.zeros(0, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), _ROWS):
        spread = shingles[k : k + _ROWS, None] * _FACTOR
        spread += _SHIFT
        np.minimum(least, spread.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT).astype("<u2")


def _crossing(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def plausible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose registers and set sizes allow a similarity of ``threshold``.

    The numbers of registers that are larger on the left, larger on the right and equal are multinomial; their
    likelihood is taken at the threshold and at its best on a grid of similarities.
    """
    small, large = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
    possible = small >= threshold * large
    more = (left > right).sum(axis=1)[:, None]
    less = (left < right).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = (np.clip(_crossing(np.maximum(x, 0)), 1e-9, 1) for x in (u - v * j, v - u * j))
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))

    grid = likelihood(np.linspace(0, 1, 65)[None, :] * top)
    at = likelihood(np.full_like(top, threshold))[:, 0]
    low = np.linspace(0, 1, 65)[grid.argmax(axis=1)] * top[:, 0] < threshold
    return possible & ~(low & (grid.max(axis=1) - at > GIVE_UP))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, sketches = [], [], []
        for found in shingle_sets(batch.column("_text")):
            sizes.append(len(found))
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sketches.append(registers(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())],
            names=["_id", "_hash", "_n", "_node", "_regs"],
        )


def _matrix(column) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(values), dtype="<u2").reshape(len(values), REGISTERS)


def _keep_plausible(threshold: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_na", "_nb")]
                ok = plausible(_matrix(batch.column("_ra")), _matrix(batch.column("_rb")), *sizes, threshold)
                yield batch.filter(pa.array(ok)).select(["_xa", "_xb"])

    return read


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that make the node they were fetched for, and not another one under the same identifier."""
    for batch in batches:
        found = shingle_sets(batch.column("_text"))
        own = [xxhash.xxh3_128_digest(f.tobytes()) == node for f, node in zip(found, batch.column("_node").to_pylist())]
        yield batch.filter(pa.array(own, pa.bool_()))


def _similar(left: np.ndarray, right: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= round(100 * threshold) * (len(left) + len(right) - both)


def _confirm(threshold: float):
    """Pairs whose full sets are similar enough."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(shingle_sets(batch.column("_ta")), shingle_sets(batch.column("_tb")))
            chosen = batch.filter(pa.array([_similar(a, b, threshold) for a, b in sides], pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column("_a"), chosen.column("_b")], names=["a", "b"])

    return read


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some sets with some others, by products of presence matrices.

    Only shingles of two sets or more can be shared; they are taken some thousands at a time, so the matrices stay small.
    """
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=bool)
    number = np.cumsum(fresh) - 1
    often = np.bincount(number)[number] > 1 if len(number) else fresh
    owner, number = owner[often], number[often]
    _, number = np.unique(number, return_inverse=True)
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for low in range(0, int(number.max()) + 1 if len(number) else 0, _SHINGLES):
        here = (number >= low) & (number < low + _SHINGLES)
        present = np.zeros((len(sets), _SHINGLES), dtype=np.float32)
        present[owner[here], number[here] - low] = 1
        total += present[rows] @ present[columns].T
    return total.astype(np.int64)


def _block_links(threshold: float):
    bound = round(100 * threshold)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between components among the members of two blocks, or within one."""
        _, i, j = key
        rows = rows.sort_values(["_x", "_node"]).reset_index(drop=True)
        block, nodes = rows["_block"].to_numpy(), rows["_node"].tolist()
        part = np.unique(rows["_label"].to_numpy(), return_inverse=True)[1]
        sets = list(shingle_sets(pa.array(rows["_text"], pa.string())))
        sizes = np.array([len(x) for x in sets])
        ours, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = intersections(sets, ours, theirs)
        linked = 100 * both >= bound * (sizes[ours][:, None] + sizes[theirs][None, :] - both)
        found = []
        for k, hits in zip(ours.tolist(), linked):
            others = theirs[hits]
            others = others[part[others] != part[k]]
            # One link for each other component; it then belongs to this one.
            for m in others[np.unique(part[others], return_index=True)[1]].tolist():
                part[part == part[m]] = part[k]
                found.append((nodes[k], nodes[m]))
        return pd.DataFrame(found, columns=["a", "b"])

    return compare


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of node hashes whose registers allow a link."""
    side = lambda s: nodes.select(F.col("_x").alias(f"_x{s}"), F.col("_n").alias(f"_n{s}"), F.col("_regs").alias(f"_r{s}"))
    scored = pairs.join(side("a"), "_xa").join(side("b"), "_xb").mapInArrow(_keep_plausible(threshold), "_xa bigint, _xb bigint")
    return store(scored, "likely").df


def _star_links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Confirmed links (``a``, ``b``) among pairs of members and hubs."""
    side = lambda s: texts.select(F.col("_x").alias(f"_x{s}"), F.col("_node").alias(f"_{s}"), F.col("_text").alias(f"_t{s}"))
    both = pairs.join(side("b"), "_xb").join(side("a"), "_xa").select("_a", "_b", "_ta", "_tb")
    return store(both.mapInArrow(_confirm(threshold), "a binary, b binary").distinct(), "confirmed").df


def _hidden_links(members: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame | None:
    """Confirmed links that no hub saw; None where every bucket lies in one component."""
    of = labels.select(F.xxhash64("node").alias("_x"), F.xxhash64("label").alias("_label"))
    placed = members.filter("_size > 2").join(of, "_x", "left").withColumn("_label", F.coalesce("_label", "_x"))
    placed = store(placed, "members").df
    mixed = placed.groupBy("_bucket").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high")).filter("_low <> _high")
    still = store(placed.join(mixed.select("_bucket"), "_bucket"), "open")
    if not still.rows:
        return None
    clusters = components(still.df.select(F.col("_hub").alias("a"), F.col("_x").alias("b")))
    clusters = clusters.select(F.col("node").alias("_x"), F.col("label").alias("_cluster"))
    # A hub is a member of its bucket, so every open member has a cluster.
    lengths = texts.select("_x", F.col("_n").alias("_length"))
    open_nodes = store(still.df.select("_x", "_label").distinct().join(clusters, "_x").join(lengths, "_x"), "clusters").df
    fill = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("_length") / BLOCK_SHINGLES)
    sizes = open_nodes.groupBy("_cluster").agg(F.ceil(fill).cast("int").alias("_blocks"))
    blocks = open_nodes.join(sizes, "_cluster").withColumn("_block", F.pmod(F.xxhash64("_x", F.lit(1)), F.col("_blocks")).cast("int"))
    dealt = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).join(texts, "_x")
    found = dealt.select("_cluster", "_i", "_j", "_x", "_label", "_block", "_node", "_n", "_regs", "_text")
    return store(found.groupBy("_cluster", "_i", "_j").applyInPandas(_block_links(threshold), "a binary, b binary"), "hidden").df


def _judged(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """For each row ``_id``, a hash of its text, the size of its set, its component and whether it is the one that stays."""
    ready(docs.sparkSession)
    id_type = type_of(docs, id_col)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    hashed = source.select("_id", F.xxhash64("_text").alias("_hash"), "_text")
    sketched = hashed.mapInArrow(_sketch, schema_of(("_id", id_type), ("_hash", "bigint"), ("_n", "bigint"), ("_node", "binary"), ("_regs", "binary")))
    rows = store(sketched, "sketch").df
    per_node = rows.filter("_n > 0").groupBy("_node").agg(
        F.first("_n").alias("_n"), F.first("_regs").alias("_regs"),
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))).alias("_pick"),
    )
    picked = per_node.select("_node", "_n", "_regs", F.col("_pick.id").alias("_id"), F.col("_pick.hash").alias("_text_hash"))
    nodes = store(picked.withColumn("_x", F.xxhash64("_node")), "nodes").df
    band = lambda k: F.xxhash64(k, F.expr(f"substring(_regs, band * {2 * BAND_ROWS} + 1, {2 * BAND_ROWS})"))
    bands = nodes.select("_x", "_regs", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    bands = bands.select("_x", band(F.col("band")).alias("_bucket"))
    shared = bands.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"), F.min("_x").alias("_hub")).filter("_size > 1")
    # Spark sizes an exploded table by its input, so it would broadcast bands of many times that; both sides grow with the input.
    members = store(bands.hint("merge").join(shared, "_bucket"), "buckets").df
    stars = members.filter("_x <> _hub").select(F.col("_hub").alias("_xa"), F.col("_x").alias("_xb")).distinct()
    stars = store(stars, "stars").df
    wanted = members.select("_x").distinct().join(nodes, "_x").withColumnRenamed("_id", "_want")
    # By identifier and text, so rows without one, or with the same, meet their own node only.
    own = F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_hash") == F.col("_text_hash"))
    fetched = hashed.join(wanted, own).select("_x", "_node", "_n", "_regs", "_text")
    texts = store(fetched.mapInArrow(_own_texts, fetched.schema), "texts").df
    links = _star_links(_likely(stars, nodes, threshold), texts, threshold)
    labels = components(links)
    hidden = _hidden_links(members, texts, labels, threshold)
    if hidden is not None:
        labels = components(links.unionByName(hidden))
    linked = labels.join(nodes.select(F.col("_node").alias("node"), "_id"), "node")
    least = linked.groupBy("label").agg(F.min("_id").alias("_least"))
    named = linked.join(least, "label").select(F.col("node").alias("_node"), "_least")
    known = nodes.select("_node", "_id").join(named, "_node", "left").select("_node", F.coalesce("_least", "_id").alias("_component"))
    placed = rows.select("_id", "_hash", "_n", "_node").join(known, "_node", "left")
    component = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_component"))
    return placed.select("_id", "_hash", "_n", component.alias("_component"), F.col("_id").eqNullSafe(component).alias("_kept"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """One row for each input row: identifier, ``n_shingles``, ``component_id``, ``kept``."""
    return _judged(docs, id_col, text_col, threshold).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with its identifier."""
    judged = _judged(docs, id_col, text_col, threshold)
    gone = store(judged.filter(~F.col("_kept")).select("_id", "_hash").distinct(), "dropped").df
    same = docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_hash"])
    return docs.join(gone, same, "left_anti")
