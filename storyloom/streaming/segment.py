"""The stateless operators on a stream of story files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.operators.examples import segmented
from storyloom.sources.corpus import KEYED_SCHEMA, require_text


def read_story_stream(spark: SparkSession, folder: str, schema: str = KEYED_SCHEMA) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    return require_text(reader.json(folder))


def write_segments(stories: DataFrame, target: str, checkpoint: str):
    """Segment everything that has arrived and append it as Parquet; the checkpoint makes each file count once."""
    return (
        segmented(stories)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
