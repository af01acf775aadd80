import hashlib
import math

import pytest
from pyspark.sql import functions as F

from storyloom.operators import batching, positions


def seeded(ids, *parts):
    return sorted(ids, key=lambda i: (hashlib.md5(":".join(map(str, (*parts, i))).encode()).hexdigest(), i))


def test_ordered_position(spark):
    keys = spark.range(1000).select((F.col("id") * 37 % 1000).alias("doc_id"), (F.col("id") % 3).alias("g"))
    table, total = positions.ordered_table(keys, [F.desc("g"), F.asc("doc_id")])
    got = [r["doc_id"] for r in table.df.orderBy("position").collect()]
    want = [r["doc_id"] for r in keys.orderBy(F.desc("g"), "doc_id").collect()]
    assert got == want and total == 1000
    assert sorted(r["position"] for r in table.df.collect()) == list(range(1, 1001))


def test_seeded_position_matches_plain_sort(spark):
    keys = spark.range(500).select(F.col("id").alias("doc_id"))
    rows = positions.seeded_position(keys, [42]).orderBy("position").collect()
    assert [r["doc_id"] for r in rows] == seeded(range(500), 42)
    assert {r["total"] for r in rows} == {500}


def test_subsets(spark):
    keys = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "a").otherwise("b").alias("split"))
    pick = lambda n: {r["doc_id"] for r in positions.seeded_subset(keys, n, 7).collect()}
    assert pick(10) == set(seeded(range(300), 7)[:10]) and pick(10) < pick(40)
    assert len(pick(300)) == len(pick(1000)) == 300 and pick(0) == set()
    by = positions.seeded_subset(keys, 30, 7, by="split").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in by} == {"a": 20, "b": 30}


def test_first_rows(spark):
    keys = spark.range(200).select((F.col("id") * 3).alias("doc_id"))
    got = sorted(r["doc_id"] for r in positions.first_rows(keys, 17).collect())
    assert got == [3 * i for i in range(17)]
    assert positions.first_rows(keys, 500).count() == 200 and positions.first_rows(keys, 0).count() == 0


def test_repeated_and_null_keys_give_exactly_n(spark):
    rows = [(1, "a"), (1, "b"), (2, "c"), (2, "c"), (2, "c"), (3, "d"), (None, "e"), (None, "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n in range(1, 10):
        first = positions.first_rows(df, n).collect()
        assert len(first) == min(n, 8)
        assert sum(r.doc_id is None for r in first) == min(n, 2)
        assert {r.doc_id for r in first if r.doc_id is not None} == {k for k in (1, 2, 3) if n > {1: 2, 2: 4, 3: 7}[k]}
        chosen = positions.seeded_subset(df, n, 7).collect()
        assert len(chosen) == min(n, 8) and sorted(map(str, chosen)) == sorted(map(str, positions.seeded_subset(df.repartition(3), n, 7).collect()))
    by = df.withColumn("split", F.when(F.col("doc_id") == 2, "x").when(F.col("doc_id").isNotNull(), "y"))
    counts = {r["split"]: r["count"] for r in positions.seeded_subset(by, 2, 7, by="split").groupBy("split").count().collect()}
    assert counts == {"x": 2, "y": 2, None: 2}


@pytest.mark.parametrize("n, world", [(10, 4), (12, 4), (3, 7), (1, 4)])
def test_shards_are_even_and_cover(spark, n, world):
    keys = spark.range(n).select(F.col("id").alias("doc_id"))
    dealt = batching.shard_positions(batching.epoch_order(keys, 42, 2), world).collect()
    for epoch in (0, 1):
        order = seeded(range(n), 42, epoch)
        filled = (order * world)[: math.ceil(n / world) * world]
        for rank in range(world):
            mine = sorted((r["slot"], r["doc_id"]) for r in dealt if r["epoch"] == epoch and r["rank"] == rank)
            assert [d for _, d in mine] == filled[rank::world]


def test_batches(spark):
    keys = spark.range(10).select(F.col("id").alias("doc_id"), (F.col("id") + 1).alias("n"))
    rows = {r["doc_id"]: r for r in batching.assign_batches(keys, 4, ["n"], [F.col("doc_id")]).collect()}
    assert [rows[i]["batch_id"] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert [rows[i]["max_n"] for i in (0, 4, 9)] == [4, 8, 10]
    cells = batching.padding_efficiency(batching.assign_batches(keys, 4, ["n"], [F.col("doc_id")]), "n")
    assert {(r["real_cells"], r["padded_cells"]) for r in cells.collect()} == {(10, 16), (26, 32), (19, 20)}


def test_shuffled_batches_and_padding(spark):
    keys = spark.range(9).select(F.col("id").alias("doc_id"), F.lit(1).alias("n"))
    rows = batching.shuffled_batches(keys, 4, ["n"], 42, 1).collect()
    order = seeded(range(9), 42, 1)
    assert all(r["batch_id"] == order.index(r["doc_id"]) // 4 for r in rows)
    seqs = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "doc_id bigint, ids array<bigint>")
    placed = batching.assign_batches(seqs.select("doc_id", F.size("ids").alias("n")), 2, ["n"], [F.col("doc_id")])
    out = {r["doc_id"]: (r["ids"], r["ids_mask"]) for r in batching.pad_batches(seqs, placed, {"ids": "max_n"}).collect()}
    assert out == {0: ([1, 2, 3], [1, 1, 1]), 1: ([4, 0, 0], [1, 0, 0])}
