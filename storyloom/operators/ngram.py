"""Count-based next-token model and the losses it gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import framed
from storyloom.operators import packed
from storyloom.operators.lookup import fits_broadcast, lookup_join
from storyloom.operators.vocabulary import HEAD_IDS, HEAD_TOKEN_BYTES, PAD_ID, UNK_ID, Vocabulary
from storyloom.scratch import StoredTable, shuffled_in, store

# A pair that makes up at least 1 / HEAD_PAIRS of all positions belongs to the head; there are at most that many.
HEAD_PAIRS = 500_000


def context_of(ids: Column, at: Column, order: int) -> Column:
    """The ``order - 1`` ids before the 1-based place ``at``: an id for bigrams, else ids joined by spaces."""
    if order == 2:
        return F.element_at(ids, at - 1)
    start = F.greatest(at - (order - 1), F.lit(1))
    return F.array_join(F.slice(ids, start, at - start), " ")


def pair_rows(sequences: DataFrame, ids: str = "ids", order: int = 2, keep: list[str] | None = None) -> DataFrame:
    """One row for each position with a context: ``doc_id``, ``pos``, ``context``, ``target``."""
    column = F.col(ids)
    places = F.when(F.size(column) >= 2, F.sequence(F.lit(2), F.size(column)))
    pairs = F.transform(
        places,
        lambda at: F.struct(
            at.alias("pos"), context_of(column, at, order).alias("context"), F.element_at(column, at).alias("target")
        ),
    )
    return sequences.select("doc_id", *(keep or []), F.explode(pairs).alias("pair")).select(
        "doc_id", *(keep or []), "pair.*"
    )


def ngram_counts(sequences: DataFrame, ids: str = "ids", order: int = 2, partitions: int | None = None) -> DataFrame:
    """Counts of contexts with their targets; dealt to at least ``partitions`` when given, and then stored."""
    counted = pair_rows(sequences, ids, order).groupBy("context", "target").agg(F.count(F.lit(1)).alias("freq"))
    if partitions is None:
        return counted
    with shuffled_in(sequences.sparkSession, partitions):
        return store(counted, "ngrams").df


def bigram_counts(docs: DataFrame, tokens: Column, vocab: Vocabulary, limit: int | None = None) -> DataFrame:
    """Bigram counts of framed stories straight from their tokens.

    Pairs are counted as strings with a partial count in every map task, and only distinct pairs meet the vocabulary.
    No story has to be put together again, so nothing is shuffled but distinct pairs. With a vocabulary too large to broadcast, blocks of
    stories seek their words, and the pairs of ids are counted; a ``limit`` of its own holds a caller to joins.
    """
    framed_tokens = framed(tokens)
    if limit is None and not fits_broadcast(vocab.table) and vocab.size < packed.ID_BOUND:
        rows = docs.select(F.lit(0).alias("_row"), framed_tokens.alias("_t"))
        return packed.Words(rows, {"ids": F.col("_t")}, vocab.df, "_row", UNK_ID).bigrams()
    n = F.size("_t") - 1
    pairs = F.arrays_zip(F.slice("_t", F.lit(1), n).alias("l"), F.slice("_t", F.lit(2), n).alias("r"))
    counted = (
        docs.select(framed_tokens.alias("_t"))
        .select(F.explode(pairs).alias("_p"))
        .groupBy(F.col("_p.l").alias("l"), F.col("_p.r").alias("r"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    ids = vocab.table.select("token", "id")
    for word, out in (("l", "context"), ("r", "target")):
        table = ids.select(F.col("token").alias(word), F.col("id").alias(out))
        head = (F.col(out) < HEAD_IDS) & (F.octet_length(word) <= HEAD_TOKEN_BYTES)
        other = "r" if word == "l" else "context"
        counted = lookup_join(counted, table, [word], [other], head, limit=limit).drop(word)
        counted = counted.withColumn(out, F.coalesce(out, F.lit(UNK_ID).cast("bigint")))
    # Unknown tokens fall together, so equal pairs are added up once more.
    return counted.groupBy("context", "target").agg(F.sum("freq").alias("freq"))


@dataclass(frozen=True)
class NgramModel:
    pairs: StoredTable
    contexts: StoredTable
    positions: int
    vocab_size: int
    alpha: float
    order: int

    def head(self) -> Column:
        return F.col("freq") >= max(1, -(-self.positions // HEAD_PAIRS))


def train_ngram(sequences: DataFrame, vocab_size: int, alpha: float = 1.0, order: int = 2) -> NgramModel:
    """Count pairs and contexts, and keep what add-alpha and label smoothing need of a context."""
    pairs = store(ngram_counts(sequences, order=order), "pairs")
    return model_from_pairs(pairs, vocab_size, alpha, order)


def model_from_pairs(pairs: StoredTable, vocab_size: int, alpha: float, order: int) -> NgramModel:
    smoothed = F.log(F.col("freq") + F.lit(float(alpha)))
    contexts = store(
        pairs.df.groupBy("context").agg(
            F.sum("freq").alias("total"), F.count(F.lit(1)).alias("seen"), F.sum(smoothed).alias("log_sum")
        ),
        "contexts",
    )
    positions = contexts.df.agg(F.sum("total")).first()[0] or 0
    return NgramModel(pairs, contexts, int(positions), vocab_size, float(alpha), order)


def negative_log(p: Column) -> Column:
    return F.when(F.isnan(p), F.lit(float("nan"))).when(p <= 0, F.lit(float("inf"))).otherwise(-F.log(p))


def score_pairs(
    pairs: DataFrame, model: NgramModel, smoothing: float = 0.0, limit: int | None = None
) -> DataFrame:
    """Add ``nll``, the loss of ``target`` after ``context``.

    Each position meets one row of the pair counts and one of the contexts. Label smoothing mixes in the mean
    loss over the whole vocabulary; seen tokens come from the context's stored sum and all others share one term,
    so the vocabulary is never spread out.
    """
    alpha, v = F.lit(model.alpha), F.lit(float(model.vocab_size))
    salt_by = ["doc_id", "pos"]
    found = lookup_join(pairs, model.pairs, ["context", "target"], salt_by, model.head(), limit)
    found = lookup_join(found, model.contexts, ["context"], salt_by, F.col("total") >= _context_cut(model), limit)
    total = F.coalesce("total", F.lit(0)) + alpha * v
    p = F.when(total == 0, F.lit(float("nan"))).otherwise((F.coalesce("freq", F.lit(0)) + alpha) / total)
    loss = negative_log(p)
    if smoothing:
        unseen = (v - F.coalesce("seen", F.lit(0))) * F.log(alpha)
        mean = F.log(total) - (F.coalesce("log_sum", F.lit(0.0)) + unseen) / v
        loss = F.lit(1 - smoothing) * loss + F.lit(smoothing) * mean
    return found.withColumn("nll", loss).drop("freq", "total", "seen", "log_sum")


def _context_cut(model: NgramModel) -> int:
    return max(1, -(-model.positions // HEAD_PAIRS))


def _packs(model: NgramModel, smoothing: float, limit: int | None) -> bool:
    """Whether blocks of sequences ask for their pairs: the counts are too many to go to every worker, where each position would meet them.

    A ``limit`` of its own holds a caller to joins."""
    known = limit is None and model.order == 2 and model.vocab_size < packed.ID_BOUND and (model.alpha > 0 or not smoothing)
    return known and not fits_broadcast(model.pairs)


def _row_losses(sequences: DataFrame, model: NgramModel, smoothing: float, pad: int | None) -> DataFrame:
    known = model.pairs.rows + model.contexts.rows
    return packed.row_losses(sequences, model.pairs.df, model.contexts.df, known, model.alpha, model.vocab_size, smoothing, pad)


def document_losses(
    sequences: DataFrame, model: NgramModel, smoothing: float = 0.0, pad: int = PAD_ID, limit: int | None = None
) -> DataFrame:
    """Per story the summed loss and the number of scored positions; padding targets are not scored."""
    if _packs(model, smoothing, limit):
        rows = _row_losses(sequences, model, smoothing, pad)
        return rows.groupBy("doc_id").agg(F.sum("nll_sum").alias("nll_sum"), F.sum("n_tokens").alias("n_tokens"))
    scored = score_pairs(
        pair_rows(sequences, order=model.order).filter(F.col("target") != pad), model, smoothing, limit
    )
    return scored.groupBy("doc_id").agg(F.sum("nll").alias("nll_sum"), F.count(F.lit(1)).alias("n_tokens"))


def batch_losses(losses: DataFrame, batches: DataFrame, by: list[str]) -> DataFrame:
    """Mean loss over the scored positions of each batch."""
    return (
        batches.join(losses, "doc_id", "left")
        .groupBy(*by)
        .agg(F.sum("nll_sum").alias("_sum"), F.sum("n_tokens").alias("n_tokens"))
        .select(
            *by,
            F.when(F.col("n_tokens") > 0, F.col("_sum") / F.col("n_tokens")).otherwise(float("nan")).alias("loss"),
            F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        )
    )


def infill_losses(truths: DataFrame, model: NgramModel, limit: int | None = None) -> DataFrame:
    """Per story the mean loss of its middle ids, each after the ids to its left."""
    if _packs(model, 0.0, limit):
        # A bigram needs but the last id before the middle.
        seen = F.when(F.size("first") > 0, F.slice("first", -1, 1)).otherwise(F.col("first"))
        rows = _row_losses(truths.filter(F.size("middle") > 0).select("doc_id", F.concat(seen, "middle").alias("ids")), model, 0.0, None)
        return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_steps"), (F.sum("nll_sum") / F.sum("n_tokens")).alias("loss"))
    offset = F.size("first")
    filled = truths.filter(F.size("middle") > 0).select(
        "doc_id", F.concat("first", "middle").alias("ids"), offset.alias("skip")
    )
    pairs = pair_rows(filled, order=model.order, keep=["skip"]).filter(F.col("pos") > F.col("skip"))
    scored = score_pairs(pairs, model, limit=limit)
    return scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_steps"), F.avg("nll").alias("loss"))
