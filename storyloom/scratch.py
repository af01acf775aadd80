"""Intermediate tables in the cluster's shared checkpoint folder.

A stored table cuts lineage, survives the loss of executors, is computed once however many branches read
it, and knows its size, so a join can decide whether broadcasting it is safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Row header and null bits of a Spark row, plus the hash slot that a broadcast relation keeps for it.
_ROW_OVERHEAD = 48
# Folder of the owner in charge; outside of any the application itself is.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)
# Application folders that are already marked for deletion when the application ends.
_marked: set[str] = set()


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the temporary folder of Hadoop's default file system."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(conf)
    return fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(conf.get("hadoop.tmp.dir"))).toString()


def application_folder(spark: SparkSession) -> str:
    """The folder of all that this application stores. Hadoop deletes it when the application ends."""
    folder = f"{scratch_root(spark)}/storyloom/{spark.sparkContext.applicationId}"
    if folder not in _marked:
        fs, path = _filesystem(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_folder.get() or application_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


@contextmanager
def owner(spark: SparkSession) -> Iterator[str]:
    """Everything stored inside the block goes when it ends, so frames made there must be used or written before."""
    folder = new_path(spark, "owner")
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)
        fs, path = _filesystem(spark, folder)
        fs.delete(path, True)


@dataclass(frozen=True)
class StoredTable:
    """A written table. ``memory_bytes`` bounds its size as rows in memory, from what was seen while writing."""

    df: DataFrame
    path: str
    rows: int
    memory_bytes: int

    def select(self, *columns) -> "StoredTable":
        return StoredTable(self.df.select(*columns), self.path, self.rows, self.memory_bytes)

    def discard(self) -> None:
        """Delete the files. Only for a table that no frame in use reads any more."""
        fs, path = _filesystem(self.df.sparkSession, self.path)
        fs.delete(path, True)


def _variable_bytes(field: T.StructField):
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        size = F.size(column) * (16 + 8 * len(kind.elementType.fields))
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StringType):
        size = F.size(column) * 8
    elif isinstance(kind, T.ArrayType):
        size = F.octet_length(F.array_join(column, "")) + F.size(column) * 24
    else:
        return None
    return F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))


@contextmanager
def shuffled_in(spark: SparkSession, partitions: int) -> Iterator[None]:
    """What runs inside the block is shuffled into at least this many partitions, which adaptive execution may merge."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), partitions))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What a write inside the block has shuffled is deleted when it ends, and not when the driver comes to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def store(df: DataFrame, tag: str) -> StoredTable:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    The counts come from an observation on the write itself, so no second pass is needed. A task that runs
    twice can only make them larger, which errs on the side of not broadcasting.
    """
    return _written(df, new_path(df.sparkSession, tag))


def store_made(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> StoredTable:
    """Store the frame that ``make`` builds; what was stored to build it goes."""
    path = new_path(spark, tag)
    with owner(spark):
        return _written(make(), path)


def _written(df: DataFrame, path: str) -> StoredTable:
    sizes = [size for size in map(_variable_bytes, df.schema.fields) if size is not None]
    variable = F.sum(sum(sizes[1:], sizes[0])) if sizes else F.lit(0).cast("bigint")
    seen = Observation()
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.coalesce(variable, F.lit(0)).cast("bigint").alias("variable")
    ) if sizes else df.observe(seen, F.count(F.lit(1)).alias("rows"))
    with _shuffles_go(df.sparkSession):
        counted.write.parquet(path)
    metrics = seen.get
    rows = int(metrics["rows"])
    fixed = rows * (_ROW_OVERHEAD + 8 * len(df.schema.fields))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return StoredTable(back, path, rows, fixed + int(metrics.get("variable", 0) or 0))


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application stored. Call it when no frame that reads stored tables is needed any more."""
    fs, path = _filesystem(spark, application_folder(spark))
    fs.delete(path, True)
