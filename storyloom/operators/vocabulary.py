"""Token counts, vocabularies and the joins between tokens and ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import BLANK_MARK, BOS, EOS, PAD, UNK
from storyloom.operators import packed
from storyloom.operators.lookup import fits_broadcast, gather_lookups
from storyloom.operators.positions import ordered_table
from storyloom.scratch import StoredTable

# Special tokens and their ids.
SPECIALS = [PAD, UNK, BOS, EOS]
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
# Ids follow frequency, so ids below this bound are the most frequent tokens; their number is fixed.
HEAD_IDS = 100_000
HEAD_TOKEN_BYTES = 256


@dataclass(frozen=True)
class Vocabulary:
    table: StoredTable
    size: int

    @property
    def df(self) -> DataFrame:
        return self.table.df

    @property
    def blank_id(self) -> int:
        """The id that registering the blank marker gives: one more than the largest."""
        return self.size

    def head(self) -> Column:
        return (F.col("id") < HEAD_IDS) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)


def token_rows(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(tokens).alias("pos", "token"))


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def counts_with_first(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """Token counts with the place of first occurrence.

    Key and position are packed in one decimal: unlike a struct it can sit in a hash-aggregation buffer, so
    tokens are combined before the shuffle without sorting them. Positions need 31 bits, keys 64.
    """
    place = F.col(key).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("pos")
    return (
        token_rows(docs, tokens, key)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"), F.min(place).alias("first_place"))
    )


def build_vocabulary(
    docs: DataFrame, tokens: Column, max_size: int | None = None, min_freq: int = 1, key: str = "doc_id"
) -> Vocabulary:
    """Specials first, then tokens by falling frequency, earliest first occurrence first; all of them unless
    ``max_size`` says how many to keep.

    A text may hold the string of a special token; it then has that token's id and no second one.
    """
    counts = counts_with_first(docs, tokens, key).filter(~F.col("token").isin(*SPECIALS))
    if min_freq > 1:
        counts = counts.filter(F.col("freq") >= min_freq)
    ranked, total = ordered_table(counts, [F.desc("freq"), F.asc("first_place")], "rank")
    kept = ranked.df if max_size is None else ranked.df.filter(F.col("rank") <= max_size)
    learned = kept.select("token", (F.col("rank") + len(SPECIALS) - 1).alias("id"), "freq")
    spark = docs.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id bigint, freq bigint")
    size = len(SPECIALS) + (total if max_size is None else min(total, max_size))
    return Vocabulary(StoredTable(specials.unionByName(learned), ranked.path, size, ranked.memory_bytes + 1024), size)


def extend_vocabulary(vocab: Vocabulary, tokens: list[str]) -> Vocabulary:
    """Register special tokens that are not there yet, with the ids after the largest, in the order given."""
    spark = vocab.df.sparkSession
    wanted = list(dict.fromkeys(tokens))
    # At most one row for each wanted token comes back.
    present = {r["token"] for r in vocab.df.filter(F.col("token").isin(wanted)).select("token").collect()}
    missing = [t for t in wanted if t not in present]
    if not missing:
        return vocab
    added = spark.createDataFrame([(t, vocab.size + i, 0) for i, t in enumerate(missing)], "token string, id bigint, freq bigint")
    room = vocab.table.memory_bytes + sum(len(t.encode()) + 128 for t in missing)
    size = vocab.size + len(missing)
    return Vocabulary(StoredTable(vocab.df.unionByName(added), vocab.table.path, size, room), size)


def pad_id(vocab: Vocabulary, pad: str = PAD, eos: str = EOS) -> int | None:
    """Id of the padding token; a vocabulary without one pads with the end of the sequence."""
    ids = {r["token"]: r["id"] for r in vocab.df.filter(F.col("token").isin(pad, eos)).select("token", "id").collect()}
    return ids.get(pad, ids.get(eos))


def encode_tokens(
    docs: DataFrame, tokens: Column, vocab: Vocabulary, out: str = "ids", key: str = "doc_id", limit: int | None = None
) -> DataFrame:
    """``key`` and the ids of its tokens, unknown ones as ``<unk>``."""
    return encode_columns(docs, {out: tokens}, vocab, key, limit)


def encode_columns(
    docs: DataFrame, columns: dict[str, Column], vocab: Vocabulary, key: str = "doc_id", limit: int | None = None
) -> DataFrame:
    """``key`` and the ids of several token lists, encoded in one pass.

    The lists are taken apart end to end with the places where each one ends; ids are gathered into one list for each.
    With the vocabulary broadcast, tokens are looked up where they are and the only shuffle is the one that brings a
    key together, which falls away when ``docs`` is already partitioned by ``key``. With a larger one blocks of texts seek their words;
    a ``limit`` of its own holds a caller to joins.
    """
    if limit is None and not fits_broadcast(vocab.table) and vocab.size < packed.ID_BOUND:
        return packed.encoded(docs, columns, vocab.df, key, UNK_ID)
    names = list(columns)
    lists = docs.select(key, *[c.alias(n) for n, c in columns.items()])
    ends, upto = [], F.lit(0)
    for n in names[:-1]:
        upto = upto + F.size(n)
        ends.append(upto.alias(f"_end_{n}"))
    rows = lists.select(key, *ends, F.posexplode_outer(F.concat(*names)).alias("pos", "token"))
    parts, start = {}, F.lit(0)
    for n in names:
        parts[n] = F.col("pos") >= start
        if n != names[-1]:
            parts[n] = parts[n] & (F.col("pos") < F.col(f"_end_{n}"))
            start = F.col(f"_end_{n}")
    return gather_lookups(rows, vocab.table, "token", "id", key, parts, F.lit(UNK_ID).cast("bigint"), vocab.head(), limit)


def decode_ids(
    rows: DataFrame, ids: Column, vocab: Vocabulary, out: str = "text", key: str = "doc_id", limit: int | None = None
) -> DataFrame:
    """``key`` and the tokens of its ids joined by spaces; special tokens are left out."""
    places = rows.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    found = gather_lookups(places, vocab.table, "id", "token", key, {out: F.col("pos").isNotNull()}, head=vocab.head(), limit=limit)
    shown = F.filter(out, lambda token: token.isNotNull() & ~token.isin(*SPECIALS, BLANK_MARK))
    return found.select(key, F.array_join(shown, " ").alias(out))


def unknown_tokens(docs: DataFrame, tokens: Column, vocab: Vocabulary) -> DataFrame:
    """Tokens of ``docs`` that the vocabulary lacks, with counts. Counted first, so each token is joined once."""
    return token_counts(docs, tokens).join(vocab.df.select("token"), "token", "left_anti")
