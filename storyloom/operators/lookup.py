"""Joins of a large row stream with a keyed table whose size is known."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.scratch import StoredTable

# A table is broadcast only when its rows, as measured while it was written, fit in this many bytes.
BROADCAST_BYTES = 256 * 1024 * 1024


def fits_broadcast(table: StoredTable, limit: int | None = None) -> bool:
    return table.memory_bytes <= (BROADCAST_BYTES if limit is None else limit)


def lookup_join(
    rows: DataFrame, table: StoredTable, keys: list[str], scatter_by: list[str], head: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Left join of ``rows`` with ``table``, which holds each key once.

    A table of checked size is broadcast, so no row moves. A larger one is split: its ``head`` (a predicate that
    can hold for a bounded number of keys only, those that occur most) is broadcast and serves most rows in place. All rows
    then meet the rest of the table in one shuffled join; rows that the head served, and rows without a key, have a key
    there that cannot match and are scattered by a hash of ``scatter_by``. So ``rows`` are read once, and chained lookups stay
    a chain. A key that is neither in the head nor rare, such as one the whole table lacks, is left to Spark's
    handling of skewed joins.
    """
    if fits_broadcast(table, limit):
        return rows.join(F.broadcast(table.df), keys, "left")
    values = [c for c in table.df.columns if c not in keys]
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    served = rows
    if head is not None:
        top = table.df.filter(head).select(*keys, *(F.col(v).alias(f"_top_{v}") for v in values), F.lit(True).alias("_known"))
        served = rows.join(F.broadcast(top), keys, "left")
        absent = absent | F.col("_known").isNotNull()
    placed = served.withColumn("_away", F.when(absent, F.xxhash64(*scatter_by)))
    asked = [F.when(F.col("_away").isNull(), F.col(k)).alias(f"_key_{k}") for k in keys]
    placed = placed.select("*", *asked, F.coalesce("_away", F.lit(0).cast("bigint")).alias("_spot"))
    rest = table.df if head is None else table.df.filter(~F.coalesce(head, F.lit(False)))
    rest = rest.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(F.col(v).alias(f"_rest_{v}") for v in values), F.lit(0).cast("bigint").alias("_spot"))
    found = placed.join(rest, [*(f"_key_{k}" for k in keys), "_spot"], "left")
    given = [F.coalesce(f"_top_{v}", f"_rest_{v}").alias(v) if head is not None else F.col(f"_rest_{v}").alias(v) for v in values]
    return found.select(*keys, *(c for c in rows.columns if c not in keys), *given)


def gather_lookups(
    rows: DataFrame, table: StoredTable, on: str, value: str, key: str, lists: dict[str, Column], missing: Column | None = None,
    head: Column | None = None, limit: int | None = None,
) -> DataFrame:
    """``key`` and, for each of ``lists``, what its rows find in ``table``, in order of ``pos`` and of what is found.

    ``rows`` hold ``key``, ``pos`` and ``on``; a list is a condition on them, and a row belongs to the first that holds. A row of none, such as
    that of an empty key, adds nothing; one that finds nothing adds ``missing``. A table too large to broadcast serves its ``head`` where the rows lie, and they are gathered
    at once; then a key is one row of what it has, and one for each place still sought, and only these meet the rest.
    """
    names, found = list(lists), F.coalesce(value, missing) if missing is not None else F.col(value)
    which = reduce(lambda done, k: done.when(lists[names[k]], k), range(1, len(names)), F.when(lists[names[0]], 0))
    rows = rows.select(key, "pos", on, which.alias("_list"))
    entry = F.struct("pos", found.alias("_v"))
    if fits_broadcast(table, limit) or head is None:
        joined = lookup_join(rows, table.select(on, value), [on], [key, "pos"], limit=limit)
        gathered = joined.groupBy(key).agg(*[F.collect_list(F.when(F.col("_list") == k, entry)).alias(n) for k, n in enumerate(names)])
        return gathered.select(key, *[F.sort_array(n)["_v"].alias(n) for n in names])
    top = table.df.filter(head).select(on, F.col(value).alias("_top"), F.lit(True).alias("_known"))
    served = rows.join(F.broadcast(top), on, "left")
    have = [
        F.collect_list(F.when((F.col("_list") == k) & F.col("_known").isNotNull(), F.struct("pos", F.col("_top").alias("_v")))).alias(f"_h{k}")
        for k in range(len(names))
    ]
    asks = F.when(F.col("_list").isNotNull() & F.col("_known").isNull(), F.struct("_list", "pos", on))
    first = served.groupBy(key).agg(*have, F.collect_list(asks).alias("_asks"))
    # Places and values in lists of their own take a third of the bytes.
    packed = [F.struct(F.col(f"_h{k}")["pos"].alias("p"), F.col(f"_h{k}")["_v"].alias("v")).alias(f"_h{k}") for k in range(len(names))]
    first = first.select(key, "_asks", *packed)
    fields = {f.name: f.dataType for f in first.schema["_asks"].dataType.elementType.fields}
    absent = [F.lit(None).cast(t).alias(n) for n, t in fields.items()]
    kept = F.struct(*absent, *[F.col(f"_h{k}") for k in range(len(names))])
    empty = [F.lit(None).cast(first.schema[f"_h{k}"].dataType).alias(f"_h{k}") for k in range(len(names))]
    sought = F.transform("_asks", lambda a: F.struct(*[a[n].alias(n) for n in fields], *empty))
    spread = first.select(key, F.inline(F.concat(F.array(kept), sought)))
    rest = replace(table, df=table.df.filter(~F.coalesce(head, F.lit(False))).select(on, value))
    joined = lookup_join(spread, rest, [on], [key, "pos"], limit=limit)
    gathered = joined.groupBy(key).agg(
        *[F.first(f"_h{k}", ignorenulls=True).alias(f"_h{k}") for k in range(len(names))],
        *[F.collect_list(F.when(F.col("_list") == k, entry)).alias(f"_r{k}") for k in range(len(names))],
    )
    both = [F.concat(F.arrays_zip(F.col(f"_h{k}")["p"].alias("pos"), F.col(f"_h{k}")["v"].alias("_v")), f"_r{k}") for k in range(len(names))]
    return gathered.select(key, *[F.sort_array(b)["_v"].alias(n) for b, n in zip(both, names)])
