import pytest
from pyspark.sql import functions as F

from storyloom.functions import arrays
from tests import plain


def calc(spark, fn, **values):
    schema = ", ".join(f"{k} {'array<bigint>' if isinstance(v, list) else 'int'}" for k, v in values.items())
    row = spark.createDataFrame([tuple(values.values())], schema)
    return row.select(fn(*[F.col(k) for k in values]).alias("x")).first()["x"]


def test_shifts(spark):
    assert calc(spark, arrays.shifted_input, a=[1, 2, 3]) == [1, 2]
    assert calc(spark, arrays.shifted_target, a=[1, 2, 3]) == [2, 3]
    assert calc(spark, lambda a: arrays.decoder_shift(a, 2), a=[7, 8, 9]) == [2, 7, 8]
    for fn in (arrays.shifted_input, arrays.shifted_target):
        assert calc(spark, fn, a=[]) == [] and calc(spark, fn, a=[5]) == []


def test_padding(spark):
    assert calc(spark, lambda a: arrays.pad_to(a, 4), a=[5, 6]) == [5, 6, 0, 0]
    assert calc(spark, lambda a: arrays.pad_to(a, 1), a=[5, 6]) == [5, 6]
    assert calc(spark, lambda a: arrays.length_mask(a, 4), a=[5, 0]) == [1, 1, 0, 0]
    assert calc(spark, lambda a: arrays.value_mask(a, 0), a=[5, 0, 0]) == [False, True, True]


def test_blank(spark):
    assert calc(spark, lambda a: arrays.blank_position(a, 9), a=[5, 6, 7, 8]) == 2
    assert calc(spark, lambda a: arrays.blank_position(a, 9), a=[5, 9, 7, 9]) == 1
    moved = lambda a: arrays.blank_advance(a, F.lit(1), F.lit(4), 9, 4)
    assert calc(spark, moved, a=[5, 9, 7, 8]) == [5, 4, 9, 7]


def test_middle_ids(spark):
    fn = lambda a, f, l: arrays.middle_ids(a, f, l)
    assert calc(spark, fn, a=[1, 2, 3, 4, 5], f=1, l=1) == [2, 3, 4]
    assert calc(spark, fn, a=[1, 2, 3, 4, 5], f=3, l=3) == [4, 5]
    assert calc(spark, fn, a=[1, 2], f=3, l=3) == []


@pytest.mark.parametrize(
    "context, reference, step, fallback, expected",
    [
        ([2], [1, 2], 0, 9, 1),
        ([], [1, 2], 0, 9, 9),
        ([1], [1, 2, 3], 0, 9, 1),
        ([1], [1, 2, 3], 2, 9, 2),
        ([1, 2], [1, 2], 0, 0, 0),
        ([2], [1, 2, 2, 3], 0, 9, 2),
    ],
)
def test_context_match(spark, context, reference, step, fallback, expected):
    assert calc(spark, arrays.context_match, c=context, r=reference, s=step, f=fallback) == expected


def test_cut_at(spark):
    fn = lambda a: arrays.cut_at(a, 3, 2)
    assert calc(spark, fn, a=[2, 7, 3, 8]) == [7]
    assert calc(spark, fn, a=[7, 8]) == [7, 8]
    assert calc(spark, fn, a=[2, 3]) == []


def closed_form(n, size, overlap):
    """The k-th start lies (2**k - 1) * (size - overlap) in; starts stop where less than half a piece is left."""
    starts = [(2**k - 1) * (size - overlap) for k in range(12)]
    return [s for s in starts if s == 0 or (n > size and s < n and min(s + size, n) - s >= size // 2)]


@pytest.mark.parametrize("size, overlap", [(50, 15), (50, 25), (50, 0), (7, 3)])
def test_chunk_starts_follow_the_walk(spark, size, overlap):
    rows = spark.range(1, 700).select("id", arrays.chunk_starts(F.col("id"), size, overlap).alias("s")).collect()
    assert all(r["s"] == closed_form(r["id"], size, overlap) for r in rows)


def test_chunk_rules(spark):
    assert calc(spark, lambda n: arrays.chunk_starts(n, 50, 15), n=200) == [0, 35, 105]
    assert calc(spark, lambda n: arrays.chunk_starts(n, 50, 15), n=60) == [0, 35]
    # A piece that ends with the text moves the start by what is left, not by a whole piece.
    assert calc(spark, lambda n: arrays.chunk_starts(n, 50, 45), n=60) == [0, 5, 15, 30]
    assert calc(spark, lambda n: arrays.chunk_starts(n, 50, 45), n=100) == [0, 5, 15, 35, 75]
    assert calc(spark, lambda n: arrays.chunk_starts(n, 50, 15, "uniform"), n=120) == [0, 35, 70]
    for overlap in (50, -1):
        with pytest.raises(ValueError):
            arrays.chunk_starts(F.lit(60), 50, overlap)
