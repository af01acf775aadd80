"""Connected components of a links table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.scratch import store


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` for every node of ``links`` (columns ``a`` and ``b``): one label for each component.

    Each round gives the nodes a new pseudo-random order, points every node at the first of itself and its neighbours and
    replaces it by that in all links; links that become loops go. Connectivity is preserved, and as the order is random
    the nodes that are left shrink by a constant factor, so a chain of any length takes a logarithmic number of rounds.
    Firsts are combined before the shuffle, so a hub costs its task no more than one row from every other task. Rounds
    are written tables; the driver sees only how many links are left.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    left, steps = store(edges, "links"), []
    while left.rows:
        turn = len(steps)
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = left.df.unionByName(left.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        step = store(near.select(F.col("a").alias("node"), F.least(place("a"), "first")["v"].alias("up")), "parents").df
        steps.append(step)
        first = step.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        second = step.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = left.df.join(first, "a").join(second, "b").filter("ua <> ub")
        left = store(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    if not steps:
        return left.df.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # From the last round, which has the fewest nodes, back to the first.
    labels = steps[-1].select("node", F.col("up").alias("label"))
    for step in reversed(steps[:-1]):
        further = labels.select(F.col("node").alias("up"), "label")
        labels = store(step.join(further, "up", "left").select("node", F.coalesce("label", "up").alias("label")), "components").df
    return labels
