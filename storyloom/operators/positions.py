"""Global row numbers without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.seeded import order_key
from storyloom.scratch import StoredTable, store

# monotonically_increasing_id keeps the partition above this bit and the row inside it below.
_ROW_BITS = 33
# Hexadecimal digits of the digest that form a bucket: 65,536 buckets of equal expected size.
_BUCKET_DIGITS = 4


def ordered_table(keys: DataFrame, order: list[Column], name: str = "position") -> tuple[StoredTable, int]:
    """``keys`` with its 1-based position in ``order``, which must be a total order, and the number of rows.

    Range partitioning puts the keys in order across partitions, each partition numbers its own rows, and the
    sizes of the partitions before it are added. Pass only the columns that are needed: all are shuffled once.
    """
    spark = keys.sparkSession
    # Range partitioning reads its input twice, once to sample it; what is read must not be worked out twice.
    keys = store(keys, "keys").df
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = (
        keys.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    written = store(laid_out, "ordered")
    rows = written.df.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], 0
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    # One row for each range partition.
    starts = spark.createDataFrame(offsets, "_part bigint, _before bigint")
    inside = F.col("_row") - F.shiftleft(F.col("_part"), _ROW_BITS)
    numbered = (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + inside + 1)
        .drop("_row", "_part", "_before")
    )
    return StoredTable(numbered, written.path, written.rows, written.memory_bytes), before


def ordered_position(keys: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    return ordered_table(keys, order, name)[0].df


def _bucketed(keys: DataFrame, by: list[str], seed_parts: list, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys with digest and bucket, and per bucket the number of rows in it and in the buckets before it."""
    hashed = keys.withColumn("_digest", order_key(*seed_parts, F.col(key))).withColumn(
        "_bucket", F.substring("_digest", 1, _BUCKET_DIGITS)
    )
    # At most 65,536 rows for each value of ``by``, whatever the size of the corpus.
    sizes = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    return hashed, _with_totals(sizes, by)


def _with_totals(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Rows in the buckets before each one, and in all."""
    upto = Window.partitionBy(*by).orderBy("_bucket")
    return sizes.withColumn("_before", F.sum("_size").over(upto) - F.col("_size")).withColumn(
        "_total", F.sum("_size").over(Window.partitionBy(*by))
    )


def seeded_position(
    keys: DataFrame, seed_parts: list, by: list[str] | None = None, key: str = "doc_id", name: str = "position"
) -> DataFrame:
    """``keys`` with the 1-based position in seeded order, within each value of ``by``, and the ``total``.

    Digests are uniform, so their leading digits cut the order into even buckets: count the buckets, number the
    rows inside each, add the counts before. ``by`` must have few values, such as splits or epochs.
    """
    by = by or []
    hashed, sizes = _bucketed(keys, by, seed_parts, key)
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_digest", key))
    return (
        hashed.withColumn("_inside", inside)
        .join(sizes, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .withColumn("total", F.col("_total"))
        .drop("_digest", "_bucket", "_inside", "_before", "_size", "_total")
    )


def seeded_subset(df: DataFrame, n: int, seed: int, by: str | None = None, key: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows (per value of ``by``), the first in seeded order; all rows where there are no more.

    Rows that share a key follow one another by a digest of all their columns. Only keys and digests are counted
    and ordered: they give the place of the n-th row, and the rows are then filtered in place against it. Where equal rows
    lie on the border, the ones that are too many are numbered, and nothing else.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    spark_by = [by] if by else []
    marked = df.withColumn("_digest", order_key(seed, F.col(key))).withColumn("_same", row_digest(df))
    keys = marked.select(*spark_by, "_digest", "_same")
    hashed = keys.withColumn("_bucket", F.substring("_digest", 1, _BUCKET_DIGITS))
    sizes = _with_totals(hashed.groupBy(*spark_by, "_bucket").agg(F.count(F.lit(1)).alias("_size")), spark_by)
    edge = sizes.filter((F.col("_before") < n) & (n <= F.col("_before") + F.col("_size"))).select(*spark_by, "_bucket", "_before")
    # One bucket for each value of ``by``: a 65,536th of the keys, combined by digest before it is ordered.
    edge = edge.select(*(F.col(c).alias(f"_edge_{c}") for c in [*spark_by, "_bucket"]), "_before")
    on = F.col("_bucket") == F.col("_edge__bucket")
    for c in spark_by:
        on = on & F.col(c).eqNullSafe(F.col(f"_edge_{c}"))
    # One row for each value of ``by``.
    within = hashed.join(F.broadcast(edge), on).groupBy(*spark_by, "_before", "_digest", "_same").agg(F.count(F.lit(1)).alias("_copies"))
    upto = Window.partitionBy(*spark_by).orderBy("_digest", "_same").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = within.withColumn("_upto", F.col("_before") + F.sum("_copies").over(upto)).filter(
        (F.col("_upto") >= n) & (F.col("_upto") - F.col("_copies") < n)
    ).collect()
    inside, border, cut, surplus = F.lit(False), F.lit(False), F.lit(False), {}
    for row in last:
        mine = F.col(by).eqNullSafe(F.lit(row[by])) if by else F.lit(True)
        same = F.col("_digest") == row["_digest"]
        at = mine & same & (F.col("_same") == row["_same"])
        cut = cut | mine
        inside = inside | (mine & ((F.col("_digest") < row["_digest"]) | (same & (F.col("_same") < row["_same"]))))
        if row["_upto"] == n:
            inside = inside | at
        else:
            border = border | at
            surplus[row[by] if by else None] = n - (row["_upto"] - row["_copies"])
    # A value of ``by`` without an edge has no more than n rows.
    short = ~cut
    kept = marked.filter(short | inside)
    if surplus:
        # Equal rows: any of them will do, so as many as are needed are taken.
        kept = kept.unionByName(_first_copies(marked.filter(border), surplus, by))
    return kept.select(*df.columns)


def _first_copies(rows: DataFrame, wanted: dict, by: str | None) -> DataFrame:
    parts = [
        (rows.filter(F.col(by).eqNullSafe(F.lit(value))) if by else rows).limit(int(n)) for value, n in wanted.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_digest(df: DataFrame) -> Column:
    """A hash of all columns, so equal for equal rows only."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


def first_rows(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by key, nulls first, rows of one key by a digest of their columns; exactly ``n`` if there are.

    Works the same for every ``n``: keys and digests are numbered without passing through one task, the place of the
    n-th row is found, and rows are filtered in place against it.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    marked = df.withColumn("_same", row_digest(df))
    counted = marked.groupBy(F.col(key).alias("_key"), "_same").agg(F.count(F.lit(1)).alias("_copies"))
    order = [F.col("_key").asc_nulls_first(), F.col("_same").asc()]
    edge = nth_row(counted, order, n)
    if edge is None:
        return df
    at_key = F.col(key).eqNullSafe(F.lit(edge["_key"]))
    before = F.lit(False) if edge["_key"] is None else F.col(key).isNull() | (F.col(key) < edge["_key"])
    inside = F.coalesce(before, F.lit(False)) | (at_key & (F.col("_same") < edge["_same"]))
    border = at_key & (F.col("_same") == edge["_same"])
    return marked.filter(inside).unionByName(marked.filter(border).limit(int(edge["_room"]))).select(*df.columns)


def nth_row(counted: DataFrame, order: list[Column], n: int):
    """The row of ``counted`` in which the n-th copy lies, and how many of its copies still fit; None if there are fewer.

    Range partitions are added up first; only the one that holds the edge is gone through.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = counted.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    written = store(laid_out, "ordered").df
    before = 0
    for r in written.groupBy("_part").agg(F.sum("_copies").alias("n")).orderBy("_part").collect():
        if before + r["n"] >= n:
            upto = F.sum("_copies").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            inside = written.filter(F.col("_part") == r["_part"]).withColumn("_upto", F.lit(before) + upto)
            return inside.filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_copies") < n)).withColumn(
                "_room", F.lit(n) - (F.col("_upto") - F.col("_copies"))
            ).first()
        before += r["n"]
    return None
