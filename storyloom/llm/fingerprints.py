"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every five-word shingle is hashed once; the top seven bits of the hash choose one of 128 bins and a bin keeps its smallest
hash. An empty bin takes the value of another one by optimal densification: a hash of the bin and of the number of the
attempt names bins until one is filled, and after six attempts the filled bin with the smallest hash of the pair decides, so
every choice is the same for all documents. Of each bin the low eight bits are stored. Equal values are expected in a share
``J + (1 - J) / 256`` of the bins; ``likeness`` turns the observed share into an unbiased similarity.

Hashes are sorted once per document, so the first of each bin is its smallest; nothing is exploded and nothing but the texts
themselves is shuffled, once, to put each document beside the next.

Defined results: a null text counts as empty and has the empty fingerprint; texts of one to four words are one shingle, the
whole sequence; two empty fingerprints have likeness 1, an empty one and another 0. Rows that share an identifier follow each
other by the hash of their text, rows without one come last; no rows give no rows. Words are split at the bytes 20 and 09 to
0D and compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import ready, text_or_empty, type_of

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 8
ATTEMPTS = 6
_BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text; a text without any has an empty array."""
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def shingle_hashes(found: Column) -> Column:
    """Sorted hashes of the shingles of an array of words."""
    at = lambda i, k: F.get(found, i + k)
    many = F.transform(F.sequence(F.lit(0), F.size(found) - WORDS), lambda i: F.xxhash64(*(at(i, k) for k in range(WORDS))))
    few = F.array(F.xxhash64(F.size(found), F.array_join(found, " ")))
    none = F.array().cast("array<bigint>")
    return F.sort_array(F.when(F.size(found) >= WORDS, many).when(F.size(found) > 0, few).otherwise(none))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def filled_bins(hashes: Column) -> Column:
    """A map from bin to the low bits of its smallest hash."""
    first = lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(hashes, i - 1)))
    low = lambda x: x.bitwiseAND(F.lit((1 << VALUE_BITS) - 1)).cast("short")
    return F.map_from_entries(F.transform(F.filter(hashes, first), lambda x: F.struct(_bin(x).cast("int"), low(x))))


def densified(filled: Column) -> Column:
    """The stored value of every bin; an empty array where no bin is filled."""

    def value(i: Column) -> Column:
        tried = (F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int") for t in range(1, ATTEMPTS + 1))
        nearest = F.array_min(F.transform(F.map_keys(filled), lambda k: F.struct(F.xxhash64(i, k, F.lit(0)), F.try_element_at(filled, k).alias("v"))))
        return F.coalesce(F.try_element_at(filled, i), *(F.try_element_at(filled, t) for t in tried), nearest["v"])

    every = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)
    return F.when(F.size(filled) > 0, every).otherwise(F.array().cast("array<smallint>"))


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the values of the bins of a text column. Each step is a column of its own, so it is computed once."""
    steps = df.withColumn("_w", words(F.col(text))).withColumn("_h", shingle_hashes(F.col("_w")))
    steps = steps.drop("_w").withColumn("_m", filled_bins(F.col("_h"))).drop("_h")
    return steps.withColumn(name, densified(F.col("_m"))).drop("_m")


def packed(signature: Column) -> Column:
    """The values as hexadecimal digits, two for each bin."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v.cast("bigint"))), VALUE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two signatures, freed of the matches that short values make by chance."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / BINS
    chance = 1 / (1 << VALUE_BITS)
    both = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def _stretches(rows: DataFrame) -> list:
    """Highest identifier, with its hash, and lowest identifier of consecutive stretches in descending order.

    One entry for each shuffle partition; only identifiers and hashes are moved.
    """
    keys = rows.filter(F.col("_id").isNotNull()).select("_id", "_hash")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keys.repartitionByRange(parts, F.col("_id").desc()).withColumn("_part", F.spark_partition_id())
    top = F.max(F.struct("_id", F.negative("_hash").alias("_minus"))).alias("_top")
    return laid.groupBy("_part").agg(top, F.min("_id").alias("_low")).orderBy("_part").collect()


def beside_next(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_next_text`` and ``_next_signature`` of the following row, by descending identifier.

    Rows go to the stretch of their identifier; the first row of each stretch also goes, marked, to the end of the one
    before, and that of the first stretch to the end of the last. Rows without identifier form the last stretch.
    """
    kind = type_of(rows, "_id")
    found = _stretches(rows)
    lows = F.array(*(F.lit(r["_low"]) for r in found)).cast(f"array<{kind.simpleString()}>")
    tops = F.array(*(F.lit(r["_top"]["_id"]) for r in found)).cast(f"array<{kind.simpleString()}>")
    hashes = F.array(*(F.lit(-r["_top"]["_minus"]) for r in found)).cast("array<bigint>")
    lone = rows.filter(F.col("_id").isNull()).agg(F.min("_hash")).first()[0]
    count = len(found) + (lone is not None)
    stretch = F.when(F.col("_id").isNull(), F.lit(len(found))).otherwise(F.size(F.filter(lows, lambda low: low > F.col("_id"))))
    placed = rows.withColumn("_stretch", stretch)
    of_null = F.col("_hash") == F.lit(lone) if lone is not None else F.lit(False)
    head = F.when(F.col("_id").isNull(), of_null).otherwise(
        (F.get(tops, F.col("_stretch")) == F.col("_id")) & (F.get(hashes, F.col("_stretch")) == F.col("_hash"))
    )
    own = F.struct(F.col("_stretch").alias("s"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(F.col("_stretch") - 1, F.lit(max(1, count))).alias("s"), F.lit(1).alias("extra"))
    dealt = placed.withColumn("_place", F.explode(F.when(head, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, F.col("_place.s").alias("_s"), F.col("_place.extra").alias("_extra"))
    order = Window.partitionBy("_s").orderBy("_extra", F.col("_id").desc_nulls_last(), "_hash")
    ahead = [F.lead(c).over(order).alias(f"_next{c}") for c in ("_text", "_signature")]
    return dealt.select(*rows.columns, "_extra", *ahead).filter("_extra = 0")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and how alike they and the next one's are.

    The edited text is the text whose last third is replaced by as much of the beginning of the next document.
    """
    ready(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    signed = with_signature(source, "_text", "_signature")
    joined = beside_next(signed)
    size = F.length("_text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), size - third), F.substring("_next_text", F.lit(1), third))
    pairs = joined.select("_id", size.cast("bigint").alias("n_chars"), edited.alias("_edited"), "_signature", F.col("_next_signature").alias("_after"))
    both = with_signature(pairs, "_edited", "_changed")
    return both.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        packed(F.col("_signature")).alias("fingerprint"), packed(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_signature"), F.col("_changed")).alias("near_edited"), likeness(F.col("_signature"), F.col("_after")).alias("near_next"),
    )
