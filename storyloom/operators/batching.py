"""Batches, padding and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import arrays
from storyloom.operators.positions import ordered_position, seeded_position


def batch_positions(positions: DataFrame, batch_size: int, lengths: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``batch_id`` and, for each length column, its maximum in the batch. The last batch may be short."""
    numbered = positions.withColumn("batch_id", F.floor((F.col("position") - 1) / batch_size).cast("bigint"))
    same = Window.partitionBy(*(by or []), "batch_id")
    for name in lengths:
        numbered = numbered.withColumn(f"max_{name}", F.max(name).over(same))
    return numbered


def assign_batches(keys: DataFrame, batch_size: int, lengths: list[str], order: list[Column]) -> DataFrame:
    """Batches over a corpus in key order. Works on keys and lengths alone; ids are joined afterwards."""
    return batch_positions(ordered_position(keys, order), batch_size, lengths).drop("position")


def shuffled_batches(keys: DataFrame, batch_size: int, lengths: list[str], seed: int, epoch: int) -> DataFrame:
    return batch_positions(seeded_position(keys, [seed, epoch]), batch_size, lengths).drop("position", "total")


def pad_batches(
    examples: DataFrame, batches: DataFrame, columns: dict[str, str], key: str = "doc_id", pad: int = 0
) -> DataFrame:
    """Pad each column to the batch maximum that ``columns`` names for it and add a mask of real positions."""
    joined = examples.join(batches, key)
    padded = [
        column
        for name, longest in columns.items()
        for column in (
            arrays.pad_to(F.col(name), F.col(longest), pad).alias(name),
            arrays.length_mask(F.col(name), F.col(longest)).alias(f"{name}_mask"),
        )
    ]
    others = [c for c in batches.columns if c != key]
    return joined.select(key, *others, *padded)


def padding_efficiency(batches: DataFrame, length: str) -> DataFrame:
    return batches.groupBy("batch_id").agg(
        F.sum(length).cast("bigint").alias("real_cells"),
        (F.count(F.lit(1)) * F.max(length)).cast("bigint").alias("padded_cells"),
    )


def epoch_order(keys: DataFrame, seed: int, epochs: int, key: str = "doc_id") -> DataFrame:
    """Every epoch's seeded order of the corpus."""
    copies = keys.select(key, F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch"))
    return seeded_position(copies, [seed, F.col("epoch")], ["epoch"], key)


def shard_positions(positions: DataFrame, world: int) -> DataFrame:
    """Deal positions out to ``world`` shards of equal size.

    The last round is filled by starting again at the front: a row also stands at every position that is its own
    plus a multiple of the total, up to the next multiple of ``world``.
    """
    goal = F.ceil(F.col("total") / world) * world
    places = F.sequence(F.col("position"), goal, F.col("total"))
    dealt = positions.withColumn("place", F.explode(places))
    return dealt.select(
        *[c for c in positions.columns if c not in ("position", "total")],
        ((F.col("place") - 1) % world).cast("int").alias("rank"),
        F.floor((F.col("place") - 1) / world).cast("bigint").alias("slot"),
    )
