"""Array expressions that build training examples from id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def tail_length(ids: Column) -> Column:
    return F.greatest(F.size(ids) - 1, F.lit(0))


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def shifted_input(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), tail_length(ids))


def shifted_target(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), tail_length(ids))


def decoder_shift(target: Column, bos: int | Column) -> Column:
    return F.concat(F.array(_long(bos)), shifted_input(target))


def pad_to(ids: Column, length: int | Column, pad: int = 0) -> Column:
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(_long(pad), missing))


def length_mask(ids: Column, length: int | Column) -> Column:
    """1 for each real position, 0 for padding up to ``length``."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))


def value_mask(ids: Column, pad: int | Column = 0) -> Column:
    return F.transform(ids, lambda x: x == _long(pad))


def blank_position(ids: Column, blank: int | Column) -> Column:
    """Zero-based index of the blank; the middle of the list when there is none."""
    at = F.array_position(ids, _long(blank))
    return F.when(at > 0, at - 1).otherwise(F.floor(F.size(ids) / 2)).cast("bigint")


def middle_ids(truth: Column, n_first: Column, n_last: Column) -> Column:
    """Truth ids without as many as the first sentence has in front and the last sentence at the end; if that
    leaves nothing, all after the first sentence."""
    inner = F.size(truth) - n_first - n_last
    rest = F.greatest(F.size(truth) - n_first, F.lit(0))
    return F.slice(truth, (n_first + 1).cast("int"), F.when(inner > 0, inner).otherwise(rest).cast("int"))


def context_match(context: Column, reference: Column, step: Column, fallback: Column) -> Column:
    """Position after the first place where ``context`` occurs in ``reference`` (the very last alignment is not
    tried), moved on by ``step``; otherwise the fallback, kept inside the reference."""
    m, n = F.size(context), F.size(reference)
    starts = F.when((m > 0) & (n > m), F.sequence(F.lit(0), n - m - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(reference, i + 1, m) == context)
    found = F.try_element_at(hits, F.lit(1)) + m + step
    inside = F.when(found.isNotNull() & (found < n), found).otherwise(F.least(fallback, n - 1))
    return F.when(m == 0, fallback).otherwise(inside).cast("bigint")


def blank_advance(ids: Column, position: Column, token: Column, blank: int | Column, max_length: int) -> Column:
    """Put ``token`` in front of the blank at ``position`` and cap the length."""
    at = position.cast("int")
    after = F.greatest(F.size(ids) - at - 1, F.lit(0))
    grown = F.concat(F.slice(ids, F.lit(1), at), F.array(_long(token), _long(blank)), F.slice(ids, at + 2, after))
    return F.slice(grown, 1, max_length)


def cut_at(ids: Column, stop: int | Column, lead: int | Column) -> Column:
    """Ids before the first ``stop``, without a leading ``lead``."""
    body = F.when(F.element_at(ids, 1) == _long(lead), F.slice(ids, F.lit(2), tail_length(ids))).otherwise(ids)
    at = F.array_position(body, _long(stop)).cast("int")
    return F.when(at > 0, F.slice(body, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(body)


def chunk_starts(length: Column, max_length: int, overlap: int, stride: str = "reference") -> Column:
    """Zero-based starts of the pieces a sequence of ``length`` is cut into.

    ``reference``: each next start is the old start plus the old end minus the overlap, so while whole windows
    fit the i-th start is (L-o)(2^i - 1). The closed form gives all of those at once; only the first window that
    reaches the end can be followed by one more with a different step, which is added after it.
    ``uniform``: starts grow by L-o.
    A window shorter than L div 2 ends the list; a sequence of at most L is one piece.
    """
    if not 0 <= overlap < max_length:
        raise ValueError("overlap must be at least 0 and below max_length")
    step, half = max_length - overlap, max_length // 2
    n = length.cast("bigint")
    if stride == "uniform":
        starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), F.lit(step).cast("bigint"))
    elif stride == "reference":
        # 2^i - 1 for i up to 40 covers any array length.
        doubling = F.array(*[F.lit(step * (2**i - 1)).cast("bigint") for i in range(40)])
        whole = F.filter(doubling, lambda s: s + max_length < n)
        ended = F.element_at(F.filter(doubling, lambda s: s + max_length >= n), 1)
        # From a window that ends at n, starts keep growing by n - overlap; only windows below n count.
        rest = F.when(
            ended < n,
            F.sequence(ended, n - 1, F.greatest(n - overlap, F.lit(1).cast("bigint"))),
        ).otherwise(F.array().cast("array<bigint>"))
        starts = F.concat(whole, rest)
    else:
        raise ValueError("stride is 'reference' or 'uniform'")
    kept = F.filter(starts, lambda s: F.least(s + max_length, n) - s >= half)
    return F.when(n <= max_length, F.array(F.lit(0).cast("bigint"))).otherwise(kept)


def chunk_structs(ids: Column, max_length: int, overlap: int, stride: str = "reference") -> Column:
    starts = chunk_starts(F.size(ids), max_length, overlap, stride)
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.cast("bigint").alias("chunk_no"),
            s.alias("start"),
            F.slice(ids, (s + 1).cast("int"), F.lit(max_length)).alias("ids"),
        ),
    )
