"""A user function over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def batched_map(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, pa.Array]], adds: str | T.StructType, drop: list[str] | None = None
) -> DataFrame:
    """``df`` with the columns that ``function`` makes of each Arrow batch, and without those in ``drop``.

    ``adds`` is the schema of the new columns; one that is there already is replaced. The function sees whole batches, so it
    can work with vectorized kernels; rows stay where they are.
    """
    added = T._parse_datatype_string(adds) if isinstance(adds, str) else adds
    gone = {*(drop or []), *added.names}
    kept = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in kept] + added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            columns = [batch.column(f.name) for f in kept] + [made[n] for n in added.names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, T.StructType([*kept, *added.fields]))
