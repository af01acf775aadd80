"""Losses over epochs, batches and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a loss above this is taken as broken.
MAX_LOSS = 1000.0


def is_valid_loss(loss: Column) -> Column:
    return ~F.isnan(loss) & (F.abs(loss) != float("inf")) & (loss <= MAX_LOSS)


def valid_losses(metrics: DataFrame) -> DataFrame:
    return metrics.filter(is_valid_loss(F.col("loss")))


def epoch_loss(metrics: DataFrame) -> DataFrame:
    """Unweighted mean of batch means. Broken batches add nothing but still count in ``epoch_loss``; they are left
    out altogether in ``epoch_loss_valid``."""
    good = F.when(is_valid_loss(F.col("loss")), F.col("loss"))
    return metrics.groupBy("epoch").agg(
        (F.coalesce(F.sum(good), F.lit(0.0)) / F.count(F.lit(1))).alias("epoch_loss"),
        F.avg(good).alias("epoch_loss_valid"),
        F.count(F.lit(1)).alias("batches"),
    )


def rank_mean_loss(metrics: DataFrame) -> DataFrame:
    """Mean over ranks of each rank's mean."""
    by_rank = metrics.groupBy("epoch", "rank").agg(F.avg("loss").alias("rank_loss"))
    return by_rank.groupBy("epoch").agg(F.avg("rank_loss").alias("loss"), F.count(F.lit(1)).alias("ranks"))


def best_epochs(epochs: DataFrame, loss: str = "loss", run: list[str] | None = None) -> DataFrame:
    """Epochs strictly below all earlier ones. There are few epochs in a run."""
    earlier = Window.partitionBy(*(run or [F.lit(0)])).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.min(loss).over(earlier), F.lit(float("inf")))
    return epochs.withColumn("best_before", best).filter(F.col(loss) < F.col("best_before")).drop("best_before")


def every_nth(metrics: DataFrame, n: int, number: str = "batch_id") -> DataFrame:
    """Batches whose 1-based number is a multiple of ``n``."""
    return metrics.filter((F.col(number) + 1) % n == 0)
