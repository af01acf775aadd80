"""Training examples from stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import arrays, text
from storyloom.operators.tokenizers import Tokenizer
from storyloom.operators.vocabulary import BOS_ID, EOS_ID


# Text that one task takes apart; its token rows take some thirty times as much.
PARTITION_BYTES = 16 * 1024 * 1024


def keyed(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Stories partitioned by key before they are taken apart.

    Texts are shuffled once, as texts. Exploding them, looking tokens up in a broadcast vocabulary, gathering the ids
    and joining them to the story then all stay in the partition; otherwise the larger token rows would move.
    """
    return docs.repartition(F.col("doc_id")) if partitions is None else docs.repartition(partitions, F.col("doc_id"))


def text_partitions(docs: DataFrame) -> int:
    """How many partitions keep the texts of each within ``PARTITION_BYTES``; not fewer than the session shuffles into."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def segmented(docs: DataFrame, at_least: int = 3) -> DataFrame:
    """Stories of enough sentences with ``first_sentence``, ``last_sentence`` and ``middle_part``."""
    # Taken out of an array of one, the sentences are cut once; as a plain column the filter would cut them again.
    cut = docs.select("*", F.explode(F.array(text.sentences(F.col("text")))).alias("_parts")).filter(F.size("_parts") >= at_least)
    parts = F.col("_parts")
    return cut.select(
        "doc_id",
        "text",
        text.first_of(parts).alias("first_sentence"),
        text.last_of(parts).alias("last_sentence"),
        text.middle_of(parts).alias("middle_part"),
    )


def blank_id_column(blank_id: int):
    return F.array(F.lit(blank_id).cast("bigint"))


def prompt_length(max_length: int):
    """Length of ``first <blank> last`` after truncation, from the lengths of its parts."""
    return F.least(F.size("first") + 1 + F.size("last"), F.lit(max_length))


def infill_examples(docs: DataFrame, tokenizer: Tokenizer, max_length: int = 512, min_length: int = 5) -> DataFrame:
    """Decoder-only examples: prompt ids ``first <blank> last`` and the ids of the whole story."""
    cut = segmented(keyed(docs)).select("doc_id", "first_sentence", "last_sentence", F.col("text").alias("full_story"))
    ids = tokenizer.encode(
        cut,
        {"first": F.col("first_sentence"), "last": F.col("last_sentence"), "target_ids": F.col("full_story")},
        max_length,
    )
    kept = ids.filter((prompt_length(max_length) >= min_length) & (F.size("target_ids") >= min_length))
    prompt = F.concat("first", blank_id_column(tokenizer.vocab.blank_id), "last")
    built = kept.select("doc_id", arrays.truncate(prompt, max_length).alias("input_ids"), "target_ids")
    return built.join(cut, "doc_id")


def encoder_decoder_examples(
    docs: DataFrame, tokenizer: Tokenizer, max_length: int = 512, min_length: int = 5
) -> DataFrame:
    """Encoder-decoder examples: prompt ids for the encoder, the middle and its shifted copy for the decoder."""
    cut = segmented(keyed(docs)).withColumnRenamed("text", "full_story")
    ids = tokenizer.encode(
        cut,
        {
            "first": F.col("first_sentence"),
            "last": F.col("last_sentence"),
            "decoder_target_ids": F.col("middle_part"),
        },
        max_length,
    )
    kept = ids.filter((prompt_length(max_length) >= min_length) & (F.size("decoder_target_ids") >= min_length))
    prompt = F.concat("first", blank_id_column(tokenizer.vocab.blank_id), "last")
    built = kept.select(
        "doc_id",
        arrays.truncate(prompt, max_length).alias("encoder_input_ids"),
        arrays.decoder_shift(F.col("decoder_target_ids"), BOS_ID).alias("decoder_input_ids"),
        "decoder_target_ids",
    )
    return built.join(cut, "doc_id")


def framed_ids(docs: DataFrame, tokenizer: Tokenizer, max_length: int | None = None, partitions: int | None = None) -> DataFrame:
    """``doc_id`` and ``<bos> ids <eos>``, cut to ``max_length`` when given."""
    ids = tokenizer.encode(keyed(docs, partitions), {"body": F.col("text")}, max_length)
    framed = F.concat(
        F.array(F.lit(BOS_ID).cast("bigint")), F.col("body"), F.array(F.lit(EOS_ID).cast("bigint"))
    )
    return ids.select("doc_id", (framed if max_length is None else arrays.truncate(framed, max_length)).alias("ids"))


def next_token_pairs(sequences: DataFrame, ids: str = "ids") -> DataFrame:
    return sequences.select(
        "doc_id",
        arrays.shifted_input(F.col(ids)).alias("input_ids"),
        arrays.shifted_target(F.col(ids)).alias("target_ids"),
    )


def chunked(sequences: DataFrame, max_length: int = 50, overlap: int = 25, stride: str = "reference") -> DataFrame:
    """One row for each piece of each sequence."""
    pieces = arrays.chunk_structs(F.col("ids"), max_length, overlap, stride)
    return sequences.select("doc_id", F.explode(pieces).alias("piece")).select("doc_id", "piece.*")


def middle_truth(docs: DataFrame, tokenizer: Tokenizer, max_length: int = 512) -> DataFrame:
    """Per story of at least two sentences: ids of first, last and whole story, and the ids between."""
    cut = segmented(keyed(docs), 2)
    ids = tokenizer.encode(
        cut,
        {"first": F.col("first_sentence"), "last": F.col("last_sentence"), "truth": F.col("text")},
        max_length,
    )
    middle = arrays.middle_ids(F.col("truth"), F.size("first"), F.size("last"))
    return ids.withColumn("middle", middle)
