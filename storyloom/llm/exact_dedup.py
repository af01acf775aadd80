"""Exact deduplication by sorting contents.

Splitters are sampled on a bounded key, the first normalised bytes and the SHA-256 of all of them, then the identifier.
They range-partition the texts, each partition is sorted externally, so equal texts lie next to each other, and every
text is compared in full with the one before it. Because the identifier takes part in the key, a group of copies of any
size spreads over as many partitions as it fills. A partition reports its first and last run with their text; runs that
meet at a border are joined by comparing those few texts, at most two for each partition.

Defined results: a null text counts as empty; a null identifier orders after all others, so it is kept only where no
other is there; of rows that share identifier and text exactly one is kept; no rows give no rows. Other columns pass
through untouched whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.llm.common import ready, schema_of, text_or_empty, type_of
from storyloom.scratch import store

# Normalised bytes that take part in the splitters.
HEAD_BYTES = 32


def _lowered(text: pa.Array) -> pa.Array:
    """A-Z in lower case, all else unchanged; null as empty."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norm = [bytes(x, "utf-8") for x in _lowered(batch.column("_text")).to_pylist()]
        head = pa.array([x[:HEAD_BYTES] for x in norm], pa.binary())
        digest = pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, head, digest], names=[*batch.schema.names, "_head", "_digest"]
        )


def _starts(norm: pa.Array, before: str | None) -> np.ndarray:
    """Rows whose text differs from the one before."""
    fresh = np.ones(len(norm), dtype=bool)
    fresh[0] = before is None or norm[0].as_py() != before
    fresh[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


class _Runs:
    """Runs of one sorted partition. Of a run only identifiers are held, and of the partition two texts."""

    def __init__(self):
        self.part = TaskContext.get().partitionId()
        self.run, self.text, self.ids, self.sha = -1, None, [], ""
        self.first_edge = None

    def edges(self) -> list[tuple]:
        if self.run < 0:
            return []
        last = (self.run, self.text, self.ids[0], len(self.ids))
        return [last] if self.run == 0 else [self.first_edge, last]

    def close(self) -> tuple:
        if self.run == 0:
            self.first_edge = (0, self.text, self.ids[0], len(self.ids))
        return self.run, self.ids, self.sha


def _all_rows(names: list[str], id_type: pa.DataType):
    """Every row with its run, and the runs at the borders with their text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()

        def made(done: list[tuple]) -> pa.RecordBatch:
            sizes = [len(ids) for _, ids, _ in done]
            total = sum(sizes)
            first = np.zeros(total, dtype=bool)
            first[np.cumsum([0, *sizes[:-1]])] = True
            columns = [
                pa.array([i for _, ids, _ in done for i in ids], id_type),
                pa.array(np.full(total, runs.part, dtype=np.int32)),
                pa.array(np.repeat(np.array([r for r, _, _ in done], dtype=np.int64), sizes)),
                pa.array(first),
                pa.array(np.repeat(np.array(sizes, dtype=np.int64), sizes)),
                pa.array([k for (_, ids, _), n in zip(done, sizes) for k in [ids[0]] * n], id_type),
                pa.array([s for (_, _, s), n in zip(done, sizes) for s in [s] * n], pa.string()),
                pa.nulls(total, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            norm, ids = _lowered(batch.column("_text")), batch.column("_id").to_pylist()
            digests = batch.column("_digest")
            cuts = [*_starts(norm, runs.text).tolist(), len(ids)]
            done = []
            if runs.run >= 0:
                runs.ids.extend(ids[: cuts[0]])
            for low, high in zip(cuts, cuts[1:]):
                if runs.run >= 0:
                    done.append(runs.close())
                runs.run, runs.text = runs.run + 1, norm[low].as_py()
                runs.ids, runs.sha = ids[low:high], digests[low].as_py().hex()
            if done:
                yield made(done)
        if runs.run >= 0:
            edges = runs.edges()
            yield made([runs.close()])
            yield _edge_rows(names, edges, runs.part, id_type)

    return read


def _edge_rows(names: list[str], edges: list[tuple], part: int, id_type: pa.DataType) -> pa.RecordBatch:
    run, text, keep, size = zip(*edges)
    n = len(edges)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, id_type), pa.array([part] * n, pa.int32()), pa.array(run, pa.int64()), pa.array([False] * n),
            pa.array(size, pa.int64()), pa.array(keep, id_type), pa.nulls(n, pa.string()), pa.array(text, pa.string()),
        ],
        names=names,
    )


def _first_rows(names: list[str]):
    """The first row of each run with all its columns, and the runs at the borders with their text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, before, first = TaskContext.get().partitionId(), -1, None, None
        schema = None

        def rows(batch: pa.RecordBatch, numbers: np.ndarray, edges: list[str | None]) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names[:-3]), pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(numbers.astype(np.int64)), pa.array(edges, pa.string()),
                ],
                names=names,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            norm = _lowered(batch.column("_text"))
            starts = _starts(norm, before)
            if len(starts):
                yield rows(batch.take(pa.array(starts)), run + 1 + np.arange(len(starts)), [None] * len(starts))
                if run < 0:
                    first = norm[0].as_py()
                run += len(starts)
            before = norm[len(norm) - 1].as_py()
        if run >= 0:
            edges = [(run, before)] if run == 0 else [(0, first), (run, before)]
            blank = pa.RecordBatch.from_arrays([pa.nulls(len(edges), f.type) for f in schema], schema=schema)
            yield rows(blank, np.array([r for r, _ in edges]), [t for _, t in edges])

    return read


def _sorted(keyed: DataFrame, keep: str) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep 'smallest' or 'largest'")
    number = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    order = [F.col("_head"), F.col("_digest"), number]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _spans(edges: DataFrame) -> DataFrame:
    """Runs that go on across borders: for each its part and run, the first of them, and what they add up to.

    At most two rows for each partition, so the result can be broadcast.
    """
    place = F.struct("_part", "_run")
    joined = edges.groupBy("_edge").agg(F.collect_set(place).alias("_runs"), *_totals(edges, place))
    wide = joined.filter(F.size("_runs") > 1).withColumn("_place", F.explode("_runs"))
    return wide.select(
        F.col("_place._part").alias("_part"), F.col("_place._run").alias("_run"), F.col("_head"), *_total_names(edges)
    )


def _totals(edges: DataFrame, place) -> list:
    made = [F.min(place).alias("_head")]
    if "_size" in edges.columns:
        made += [F.sum("_size").alias("_span_size"), F.min_by("_keep", place).alias("_span_keep")]
    return made


def _total_names(edges: DataFrame) -> list[str]:
    return ["_span_size", "_span_keep"] if "_size" in edges.columns else []


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each input row: identifier, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    ready(docs.sparkSession)
    id_type = type_of(docs, id_col)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    keyed = source.mapInArrow(
        _keys, schema_of(("_id", id_type), ("_text", "string"), ("_head", "binary"), ("_digest", "binary"))
    )
    out = schema_of(
        ("_id", id_type), ("_part", "int"), ("_run", "bigint"), ("_first", "boolean"), ("_size", "bigint"),
        ("_keep", id_type), ("_sha", "string"), ("_edge", "string"),
    )
    stored = store(_sorted(keyed, keep).mapInArrow(_all_rows(out.names, to_arrow_type(id_type)), out), "exact").df
    spans = _spans(stored.filter(F.col("_edge").isNotNull()).select("_part", "_run", "_size", "_keep", "_edge"))
    rows = stored.filter(F.col("_edge").isNull()).join(F.broadcast(spans), ["_part", "_run"], "left")
    alone = F.col("_head").isNull()
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_keep")).otherwise(F.col("_span_keep")).alias("keep_id"),
        F.when(alone, F.col("_size")).otherwise(F.col("_span_size")).alias("group_size"),
        (F.col("_first") & (alone | (F.col("_head") == F.struct("_part", "_run")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with all their columns."""
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    columns = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")]
    columns += [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)]
    source = docs.select(*columns)
    fields = [(f.name, f.dataType) for f in source.schema.fields]
    keyed = source.mapInArrow(_keys, schema_of(*fields, ("_head", "binary"), ("_digest", "binary")))
    out = schema_of(*fields, ("_part", "int"), ("_run", "bigint"), ("_edge", "string"))
    stored = store(_sorted(keyed, keep).mapInArrow(_first_rows(out.names), out), "exact").df
    spans = _spans(stored.filter(F.col("_edge").isNotNull()).select("_part", "_run", "_edge"))
    rows = stored.filter(F.col("_edge").isNull()).join(F.broadcast(spans), ["_part", "_run"], "left")
    kept = rows.filter(F.col("_head").isNull() | (F.col("_head") == F.struct("_part", "_run")))
    back = {id_col: "_id", text_col: "_text"} | {c: f"_c{i}" for i, c in enumerate(others)}
    return kept.select(*(F.col(back[c]).alias(c) for c in docs.columns))
