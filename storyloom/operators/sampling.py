"""Scores, filtered candidate distributions and draws, grouped by context.

A context has at most one row for each token of the vocabulary. Ordinary contexts are windows, and Spark applies top-k limits on
both sides of the shuffle. A context of very many rows is cut to slices, in order of score, on which the same windows run; sums and
maxima are added up over the slices, and running sums are shifted by those of the slices before. No task holds such a context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.seeded import uniform_draw
from storyloom.operators.lookup import lookup_join
from storyloom.scratch import StoredTable, store

# Rounding room when mass is compared with top-p, so that exact ties do not hang on the last bit of a sum.
MASS_EPSILON = 1e-9
# Candidates of a context are kept in array rows of at most this many entries.
CHUNK_ENTRIES = 1024
# A context with more rows is cut to slices; so many contexts at most, the largest.
SLICE_ROWS = 1_000_000
MOST_LARGE = 10_000


def sanitize(score: Column, low: float = -50.0, high: float = 50.0) -> Column:
    """NaN and infinities become 0, everything else is clamped."""
    odd = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(odd, F.lit(0.0)).otherwise(F.greatest(F.least(score, F.lit(high)), F.lit(low)))


def tempered(score: Column, temperature: Column | float, floor: float | None = None) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return score / (t if floor is None else F.greatest(t, F.lit(floor)))


def _order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("token")]


def _same(by: list[str], other: str) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return on


def sliced_parts(df: DataFrame, by: list[str], score: str = "score") -> list[DataFrame]:
    """The rows of ordinary contexts, and those of contexts with more than ``SLICE_ROWS`` rows, which get a ``_slice``.

    Large contexts are laid out by range of context, falling score and token, so one of any size spreads over as many
    tasks as its rows fill; its slices follow one another in that order. At most ``MOST_LARGE`` contexts are large.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > SLICE_ROWS)
    large = store(sizes.orderBy(F.desc("_size")).limit(MOST_LARGE).select(*(F.col(c).alias(f"_large_{c}") for c in by)), "large-contexts")
    if not large.rows:
        return [df]
    found = F.broadcast(large.df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.join(found, _same(by, "_large_"), "left_semi").repartitionByRange(parts, *by, *_order(score))
    return [df.join(found, _same(by, "_large_"), "left_anti"), store(rows.withColumn("_slice", F.spark_partition_id()), "slices").df]


def _group(df: DataFrame, by: list[str]) -> list[str]:
    return [*by, "_slice"] if "_slice" in df.columns else by


def _whole(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """An aggregate of each row's context: by one window, or added up over the slices, one row for each large context."""
    if "_slice" not in df.columns:
        return df.withColumn(name, value.over(Window.partitionBy(*by)))
    kept = store(df, "slices").df
    of_all = kept.groupBy(*by).agg(value.alias(name)).select(*(F.col(c).alias(f"_of_{c}") for c in by), name)
    return kept.join(F.broadcast(of_all), _same(by, "_of_"), "left").select(*df.columns, name)


def _before(df: DataFrame, by: list[str], value: Column, order: list[Column], name: str) -> DataFrame:
    """The sum over the rows of the context before this one: inside its slice, and of all slices before."""
    inside = Window.partitionBy(*_group(df, by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0).cast("double")))
    if "_slice" not in df.columns:
        return local
    kept = store(local, "slices").df
    # One row for each large context and slice.
    totals = kept.groupBy(*by, "_slice").agg(F.sum(value).cast("double").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, "_slice"]), F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_shift"))
    moved = kept.join(F.broadcast(shifts), _same([*by, "_slice"], "_of_"), "left")
    return moved.select(*df.columns, (F.col(name) + F.col("_shift")).alias(name))


def _over_parts(df: DataFrame, by: list[str], change: Callable[[DataFrame], DataFrame], score: str = "score") -> DataFrame:
    """The same change of ordinary and of large contexts."""
    out, *more = [change(part).drop("_slice") for part in sliced_parts(df, by, score)]
    for part in more:
        out = out.unionByName(part)
    return out


def _softmax(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    lifted = _whole(df, by, F.max(score), "_top").withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    return _whole(lifted, by, F.sum("_e"), "_sum").withColumn(out, F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def softmax(df: DataFrame, by: list[str], score: str = "score", out: str = "p") -> DataFrame:
    return _over_parts(df, by, lambda part: _softmax(part, by, score, out), score)


def _top_k(df: DataFrame, by: list[str], k: Column | int, ties: bool, score: str) -> DataFrame:
    if isinstance(k, int) and k <= 0:
        return df
    group = Window.partitionBy(*_group(df, by))
    place = F.rank().over(group.orderBy(F.desc(score))) if ties else F.row_number().over(group.orderBy(*_order(score)))
    within = lambda c: c <= k if isinstance(k, int) else (k <= 0) | (c <= k)
    kept = df.withColumn("_place", place).filter(within(F.col("_place"))).drop("_place")
    if "_slice" not in df.columns:
        return kept
    # What is not among the best of its slice is not among the best of all.
    placed = _before(kept, by, F.lit(1), _order(score), "_n")
    if not ties:
        return placed.filter(within(F.col("_n") + 1)).drop("_n")
    edge = _whole(placed, by, F.max(F.when(F.col("_n") + 1 == k, F.col(score))), "_edge")
    return edge.filter(F.col("_edge").isNull() | (F.col(score) >= F.col("_edge"))).drop("_n", "_edge")


def top_k(df: DataFrame, by: list[str], k: Column | int, ties: bool, score: str = "score") -> DataFrame:
    """The best ``k`` by score: with ``ties`` all that equal the k-th, otherwise exactly ``k``, lower token first.

    ``k`` of zero or less keeps all.
    """
    return _over_parts(df, by, lambda part: _top_k(part, by, k, ties, score), score)


def best_of_all(scores: DataFrame, k: Column | int, ties: bool) -> DataFrame:
    """``top_k`` of a table without groups. A fixed ``k`` is taken by a top-n in every task, never by one window."""
    if not isinstance(k, int) or k <= 0:
        return scores
    first = scores.orderBy(F.desc("score"), F.asc("token")).limit(k)
    if not ties:
        return first
    edge = first.agg(F.min("score")).first()[0]
    return scores.filter(F.lit(False)) if edge is None else scores.filter(F.col("score") >= edge)


def _top_p(df: DataFrame, by: list[str], limit: Column | float, p: str) -> DataFrame:
    led = _before(df, by, F.col(p), _order(p), "_before")
    return led.filter(F.col("_before") <= limit + F.lit(MASS_EPSILON)).drop("_before")


def top_p(df: DataFrame, by: list[str], limit: Column | float, p: str = "p") -> DataFrame:
    """Tokens until the mass before one exceeds ``limit``; the one that crosses it stays."""
    return _over_parts(df, by, lambda part: _top_p(part, by, limit, p), p)


def _renormalize(df: DataFrame, by: list[str], p: str) -> DataFrame:
    return _whole(df, by, F.sum(p), "_sum").withColumn(p, F.col(p) / F.col("_sum")).drop("_sum")


def renormalize(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    return _over_parts(df, by, lambda part: _renormalize(part, by, p), p)


def candidates(
    scores: DataFrame,
    by: list[str],
    temperature: Column | float = 1.0,
    k: Column | int = 50,
    p_limit: Column | float = 0.9,
    ties: bool = True,
    guarded: bool = False,
    bounds: bool = False,
) -> DataFrame:
    """Temperature, top-k, top-p and a final normalisation, in this order. ``guarded`` also floors the temperature
    and cleans the scores; ``bounds`` adds what ``with_bounds`` adds."""
    cooled = tempered(F.col("score"), temperature, 0.1 if guarded else None)
    scored = scores.withColumn("score", sanitize(cooled) if guarded else cooled)

    def filtered(part: DataFrame) -> DataFrame:
        kept = _softmax(_top_k(part, by, k, ties, "score"), by, "score", "p")
        done = _renormalize(_top_p(kept, by, p_limit, "p"), by, "p").select(*_group(part, by), "token", "p")
        return _bounded(done, by) if bounds else done

    return _over_parts(scored, by, filtered)


def greedy(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return top_k(df, by, 1, ties=False, score=score)


def _bounded(df: DataFrame, by: list[str]) -> DataFrame:
    led = _before(df, by, F.col("p"), _order("p"), "_before")
    numbered = _before(led, by, F.lit(1), _order("p"), "_n")
    return numbered.withColumn("high", F.col("_before") + F.col("p")).withColumn("place", (F.col("_n") + 1).cast("bigint")).drop("_before", "_n")


def with_bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """The stretch of [0, 1) that draws each candidate, candidates taken by falling probability."""
    return _over_parts(df, by, lambda part: _bounded(part, by), "p")


@dataclass(frozen=True)
class DrawTable:
    """Candidates by context, ready for draws, and those of the empty context to back off to."""

    chunks: StoredTable
    fallback: StoredTable


def _chunked(bounded: DataFrame) -> DataFrame:
    """Candidates of a context in rows of bounded length. The last row's stretch has no upper end, as a sum of
    probabilities may stop short of one, and every row knows the likeliest token."""
    cut = bounded.withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK_ENTRIES))
    rows = cut.groupBy("context", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("high", "token"))).alias("entries")
    )
    order = Window.partitionBy("context").orderBy("chunk")
    top = F.element_at("entries", -1)["high"]
    return rows.select(
        "context",
        F.coalesce(F.lag(top).over(order), F.lit(0.0)).alias("low"),
        F.when(F.lead("chunk").over(order).isNull(), float("inf")).otherwise(top).alias("upto"),
        "entries",
        F.first(F.element_at("entries", 1)["token"]).over(order).alias("likeliest"),
    )


def draw_table(pair_counts: DataFrame, **settings) -> DrawTable:
    """Filter every context's successors once; generation then only looks contexts up.

    Filtering depends on the context alone, so it is done for the table of contexts and not for each prompt and
    step. Scores are log counts. Candidates are stored in array rows of bounded length.
    """
    scores = pair_counts.select("context", F.col("target").alias("token"), F.log("freq").alias("score"))
    known = candidates(scores, ["context"], bounds=True, **settings)
    unigrams = pair_counts.groupBy("target").agg(F.sum("freq").alias("freq"))
    start = unigrams.select(
        F.lit(None).cast(pair_counts.schema["context"].dataType).alias("context"),
        F.col("target").alias("token"),
        F.log("freq").alias("score"),
    )
    # Temperature does not change the order, so the best are the same before it.
    best = best_of_all(start, settings.get("k", 50), settings.get("ties", True))
    loose = candidates(best, ["context"], bounds=True, **settings)
    fallback = _chunked(loose).select(
        F.lit(1).alias("back"), *(F.col(c).alias(f"b_{c}") for c in ("low", "upto", "entries", "likeliest"))
    )
    return DrawTable(store(_chunked(known), "draws"), store(fallback, "fallback"))


def draw(
    state: DataFrame, table: DrawTable, u: Column, salt_by: list[str], out: str = "token", limit: int | None = None
) -> DataFrame:
    """Add the candidate of ``context`` whose stretch holds ``u``.

    A context of very many candidates has several rows, of which one holds ``u``, so each state row leaves as one. Where
    rounding leaves no stretch for ``u`` the likeliest candidate is taken.
    """
    located = lookup_join(state.withColumn("_u", u), table.chunks, ["context"], salt_by, limit=limit)
    located = located.filter(F.col("entries").isNull() | ((F.col("low") <= F.col("_u")) & (F.col("_u") < F.col("upto"))))
    located = located.withColumn("back", F.when(F.col("entries").isNull(), F.lit(1)))
    located = lookup_join(located, table.fallback, ["back"], salt_by, limit=limit)
    located = located.filter(F.col("b_entries").isNull() | ((F.col("b_low") <= F.col("_u")) & (F.col("_u") < F.col("b_upto"))))
    offered = located.select(
        *state.columns, "_u", F.coalesce("entries", "b_entries").alias("_entries"), F.coalesce("likeliest", "b_likeliest").alias("_likeliest")
    )
    chosen = F.try_element_at(F.filter("_entries", lambda e: e["high"] > F.col("_u")), F.lit(1))["token"]
    return offered.select(*state.columns, F.coalesce(chosen, "_likeliest").alias(out))


def prompt_draw(seed: int, key: str, step: Column | int) -> Column:
    return uniform_draw(seed, F.col(key), step)


def decode_settings(prompts: DataFrame, settings: list[dict]) -> DataFrame:
    """Each prompt once for every setting, as an array literal taken apart; the settings are columns from here on."""
    options = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("setting"),
                F.lit(float(s.get("temperature", 1.0))).alias("temperature"),
                F.lit(int(s.get("top_k", 50))).cast("bigint").alias("top_k"),
                F.lit(float(s.get("top_p", 0.9))).alias("top_p"),
                F.lit(float(s.get("ratio", 0.0))).alias("ratio"),
            )
            for i, s in enumerate(settings)
        ]
    )
    return prompts.withColumn("_s", F.explode(options)).select(*prompts.columns, "_s.*")
