"""A Merkle manifest of a dataset: one leaf for each row, one subtree for each source, one root, and a witness for each leaf.

A leaf is the SHA-256 of the row's fields. The leaves of a source stand in order of identifier; every ``RUN`` consecutive nodes
become one node, until one is left. The subroots of the sources, in order of source, are joined the same way.

Witnesses are made incrementally. The leaves of a source are cut into aligned blocks of ``BLOCK`` nodes, a power of ``RUN``, so a
block is a subtree of its own. Within a block nodes are appended one after another: a node's partial witness stays attached to
the open subtree that holds it, and each time the siblings of that subtree are complete, they extend every witness attached to
it. The root of a block is a further append to the level above, in blocks again, until a source has one node. On the way
back every block hands the witness of its own root down to the nodes in it. A task sees one block at a time, whatever the size
of a source; the driver sees how many nodes the longest level has.

Defined results: a null field is written as ``-``; a null source is a source of its own and comes first; null identifiers come
first in their source; rows that share an identifier follow one another by their leaf; no rows give no rows; other columns do not
take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import ready, type_of
from storyloom.operators.lookup import lookup_join
from storyloom.operators.positions import ordered_table
from storyloom.scratch import StoredTable, store

# Fixed value: nodes that become one.
RUN = 16
# Levels of a block, and the nodes it holds.
BLOCK_LEVELS = 3
BLOCK = RUN**BLOCK_LEVELS
# Sources of at least this share of all rows are spread where the table of sources is too large to broadcast.
HEAD_SOURCES = 100_000
STEPS = "array<struct<place:int,siblings:string>>"
_HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """One aligned subtree that grows by appends. Witnesses are lists of (place in the run, the siblings' digests)."""

    def __init__(self, height: int):
        self.open: list[list] = [[] for _ in range(height)]
        self.root: str | None = None

    def append(self, node: str) -> list:
        """The witness of ``node``, which later appends and ``finish`` extend."""
        witness: list = []
        self._attach(0, node, [witness])
        return witness

    def _attach(self, level: int, node: str, below: list) -> None:
        if level == len(self.open):
            self.root = node
            return
        self.open[level].append((node, below))
        if len(self.open[level]) == RUN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        joined = "".join(node for node, _ in run)
        for place, (_, below) in enumerate(run):
            step = (place, joined[: _HEX * place] + joined[_HEX * (place + 1) :])
            for witness in below:
                witness.append(step)
        self._attach(level + 1, digest(joined), [w for _, below in run for w in below])

    def finish(self) -> str:
        """Complete what is still open, from below, and return the root."""
        for level, run in enumerate(self.open):
            if run:
                self._complete(level)
        return self.root


def fold(node: str, steps) -> str:
    """The root that ``node`` and its witness lead to."""
    for step in steps:
        at = _HEX * step["place"]
        node = digest(step["siblings"][:at] + node + step["siblings"][at:])
    return node


def _height(nodes: int) -> int:
    """Levels of one block; every block of a longer row of nodes is as high as a full one."""
    height = 0
    while nodes > 1 and height < BLOCK_LEVELS:
        nodes, height = -(-nodes // RUN), height + 1
    return height


def _block_root(rows: pd.DataFrame) -> pd.DataFrame:
    grown = Appender(_height(int(rows["_n"].iloc[0])))
    for node in rows.sort_values("_at")["_node"]:
        grown.append(node)
    return pd.DataFrame({"_tree": rows["_tree"].iloc[:1], "_n": [-(-int(rows["_n"].iloc[0]) // BLOCK)], "_at": rows["_block"].iloc[:1], "_node": [grown.finish()]})


def _block_witnesses(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_at")
    grown = Appender(_height(int(rows["_n"].iloc[0])))
    made = [grown.append(node) for node in rows["_node"]]
    grown.finish()
    rest = list(above["_steps"].iloc[0])
    steps = [[{"place": p, "siblings": s} for p, s in witness] + rest for witness in made]
    return rows[["_tree", "_at", "_key", "_node", "_changed"]].assign(_steps=steps, _top=above["_top"].iloc[0])


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("bigint"))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of block roots above ``nodes`` (``_tree``, ``_n`` nodes in it, ``_at`` from 0, ``_node``), and the root of each tree."""
    levels = [nodes]
    while True:
        up = _blocked(levels[-1].select("_tree", "_n", "_at", "_node")).groupBy("_tree", "_block").applyInPandas(_block_root, "_tree string, _n bigint, _at bigint, _node string")
        up = store(up, "merkle-blocks").df
        if (up.agg(F.max("_n")).first()[0] or 1) <= 1:
            return levels, up
        levels.append(up)


def attach(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with ``_steps`` and ``_top``. ``tops`` gives each tree's ``_steps`` and ``_top`` from its root on.

    What a node carries besides (``_key``, ``_changed``) stays with it, so a witness is never shuffled after it is made.
    """
    above = tops.withColumn("_block", F.lit(0).cast("bigint"))
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        for extra in ("_key", "_changed"):
            nodes = nodes if extra in nodes.columns else nodes.withColumn(extra, F.lit(None).cast("string"))
        pair = _blocked(nodes).groupBy("_tree", "_block").cogroup(above.select("_tree", "_block", "_steps", "_top").groupBy("_tree", "_block"))
        found = pair.applyInPandas(
            _block_witnesses, f"_tree string, _at bigint, _key string, _node string, _changed string, _steps {STEPS}, _top string"
        )
        if level:
            found = store(found, "merkle-witnesses").df
        above = found.withColumnRenamed("_at", "_block")
    return found


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 bytes behind their number and a colon."""
    texts = [f.cast("string") for f in fields]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*written), 256)


def _tree_name(source: Column) -> Column:
    """Never null, and different for different sources."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _placed(leaves: StoredTable) -> tuple[DataFrame, StoredTable]:
    """Leaves with their tree, its number of leaves and their place in it; and the trees in order."""
    order = [F.col("_source").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("_leaf").asc()]
    table, total = ordered_table(leaves.df, order, "_all")
    placed = table.df.withColumn("_tree", _tree_name(F.col("_source")))
    sizes = placed.groupBy("_tree").agg(F.count(F.lit(1)).alias("_n"), F.min("_all").alias("_base"), F.first("_source").alias("_of"))
    ranked, trees = ordered_table(sizes, [F.col("_base").asc()], "_rank")
    ranked = store(ranked.df.withColumn("_trees", F.lit(trees).cast("bigint")), "merkle-trees")
    found = lookup_join(placed, ranked.select("_tree", "_n", "_base"), ["_tree"], ["_all"], F.col("_n") * HEAD_SOURCES >= total)
    return found.withColumn("_at", F.col("_all") - F.col("_base")), ranked


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: list[str] | None = None,
    altered: dict[str, Callable[[Column], Column]] | None = None, altered_where: Column | None = None,
) -> DataFrame:
    """One row for each input row: identifier, ``leaf``, ``subroot``, ``root``, ``witness`` and ``altered_leaf``.

    ``fields`` are hashed into a leaf, in order. ``altered`` says how fields change in a tampered copy of the rows in
    ``altered_where``, whose leaf is ``altered_leaf`` (null elsewhere).
    """
    ready(docs.sparkSession)
    fields = fields or [id_col, source_col, "lang", "n_chars", "text"]
    columns = {f: F.col(f"`{f}`") for f in fields}
    other = {f: (altered or {}).get(f, lambda c: c)(c) for f, c in columns.items()}
    changed = F.when(altered_where, leaf_hash([*other.values()])) if altered_where is not None else F.lit(None).cast("string")
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), leaf_hash([*columns.values()]).alias("_leaf"), changed.alias("_changed")
    )
    placed, trees = _placed(store(leaves, "merkle-leaves"))
    key = F.col("_id").cast("string").alias("_key")
    rows = store(placed.select("_tree", "_n", "_at", key, F.col("_leaf").alias("_node"), "_changed"), "merkle-placed").df
    levels, subroots = grow(rows)
    joined = trees.df.select("_tree", "_rank", "_trees").join(subroots.select("_tree", "_node"), "_tree")
    tops = joined.select(F.lit("").alias("_tree"), F.col("_trees").alias("_n"), (F.col("_rank") - 1).alias("_at"), "_node", F.col("_tree").alias("_of"))
    tops = store(tops, "merkle-subroots").df
    upper, root = grow(tops.select("_tree", "_n", "_at", "_node"))
    none = F.array().cast(STEPS)
    ends = attach(upper, root.select("_tree", none.alias("_steps"), F.col("_node").alias("_top")))
    ends = tops.select("_at", "_of", "_node").join(ends.select("_at", "_steps", "_top"), "_at")
    # A tree's top carries its subroot and the root in one text, so both come down with the witness.
    ends = ends.select(F.col("_of").alias("_tree"), "_steps", F.concat("_node", "_top").alias("_top"))
    found = attach(levels, store(ends, "merkle-tops").df)
    return found.select(
        F.col("_key").cast(type_of(docs, id_col)).alias(id_col), F.col("_node").alias("leaf"), F.substring("_top", 1, _HEX).alias("subroot"),
        F.substring("_top", _HEX + 1, _HEX).alias("root"), F.col("_steps").alias("witness"), F.col("_changed").alias("altered_leaf"),
    )


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, folded = [], []
        for steps, node in zip(batch.column("witness").to_pylist(), batch.column("_node").to_pylist()):
            proofs.append(digest("".join(s["siblings"] for s in steps)))
            folded.append(fold(node, steps))
        kept = [c for c in batch.schema.names if c not in ("witness", "_node")]
        columns = [*(batch.column(c) for c in kept), pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "proof_sha256", "folded_root"])


def audit(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``manifest``'s rows with a digest of each witness, the root folded from it and the altered (else own) leaf, and whether it is the root."""
    kept = rows.select(F.col(f"`{id_col}`"), "leaf", "subroot", "root", "witness", F.coalesce("altered_leaf", "leaf").alias("_node"))
    out = kept.drop("witness", "_node").schema.add("proof_sha256", "string").add("folded_root", "string")
    return kept.mapInArrow(_audited, out).withColumn("verified", F.col("folded_root") == F.col("root"))
