"""Byte-pair-encoding training and encoding.

A word's symbols are one string with a space on each side of every symbol: ``" t  h  e  </w> "``. Words hold no
blanks, so ``" t  h "`` can only match two whole neighbouring symbols, and replacing it left to right is exactly a
merge. A single merge is such a replacement inside Spark; a list of merges runs over words in Arrow batches, which remember the last ones.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import BLANK_MARK, WORD_END, whitespace_words
from storyloom.operators.lookup import lookup_join
from storyloom.operators.vocabulary import SPECIALS, UNK_ID, Vocabulary
from storyloom.scratch import StoredTable, store

# Leading pairs of a round of training, and the most segments of words that the driver reads merges off.
LEADING_PAIRS = 1024
SEGMENTS = 65_536
SEGMENT_BYTES = 64 * 1024 * 1024
# Encoded words that a task remembers, twice as many at most, and their length; bytes of texts that it encodes at a time.
HEAD_WORDS = 50_000
HEAD_WORD_CHARS = 64
SLICE_BYTES = 4 * 1024 * 1024
# Fixed value: merges learned unless told otherwise.
DEFAULT_MERGES = 1000

MERGE_SCHEMA = "rank int, left string, right string, merged string, freq bigint"


def pattern(left: str | Column, right: str | Column):
    if isinstance(left, str):
        return f" {left}  {right} "
    return F.concat(F.lit(" "), left, F.lit("  "), right, F.lit(" "))


# A word that spells out the word end gets this character in it, so that no merge can make the mark from letters. It is
# a noncharacter, which no text may hold.
_APART = "\uFDD0"


def symbol_string(word: Column) -> Column:
    apart = F.replace(word, F.lit(WORD_END), F.lit(WORD_END[0] + _APART + WORD_END[1:]))
    return F.concat(F.regexp_replace(apart, "(?s)(.)", " $1 "), F.lit(f" {WORD_END} "))


def symbols_of(packed: Column) -> Column:
    return F.split(F.substring(packed, F.lit(2), F.length(packed) - 2), "  ", -1)


def word_counts(docs: DataFrame) -> DataFrame:
    return (
        docs.select(F.explode(whitespace_words(F.col("text"))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def pair_counts(words: DataFrame, packed: str = "packed") -> DataFrame:
    """Neighbouring symbols, weighted by how often the word occurs."""
    parts = F.col("_parts")
    last = F.size(parts) - 1
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), last).alias("left"), F.slice(parts, F.lit(2), last).alias("right"))
    split = words.select(symbols_of(F.col(packed)).alias("_parts"), "freq")
    return (
        split.select(F.explode(pairs).alias("pair"), "freq")
        .groupBy(F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))
        .agg(F.sum("freq").alias("freq"))
    )


def apply_merges(packed: Column, merges: list[tuple[str, str]]) -> Column:
    for left, right in merges:
        packed = F.replace(packed, F.lit(pattern(left, right)), F.lit(f" {left}{right} "))
    return packed


def merge_words(words: DataFrame, left: str, right: str) -> DataFrame:
    return words.withColumn("packed", apply_merges(F.col("packed"), [(left, right)]))


class Segments:
    """Stretches of words in which only leading pairs stand next to each other, with their counts, as merges change them.

    A word is cut between any two neighbours that are no leading pair, so all occurrences of a leading pair are inside
    segments, and what lies across a cut is a pair that occurs at most ``outside`` times. A symbol that one merge makes has one
    first and one last part that stood in the word before; then a pair's occurrences are all inside or all across cuts, and those
    across number at most ``outside``. Where several merges make the same symbol, the bound is multiplied by the ways.
    """

    def __init__(self, counted: list[tuple[list[str], int]], leading: set[tuple[str, str]], outside: int, known: set[str]):
        self.leading, self.outside, self.known = leading, outside, known
        self.symbols = [symbols for symbols, _ in counted]
        self.freq = [freq for _, freq in counted]
        self.count: dict[tuple[str, str], int] = {}
        self.held: dict[tuple[str, str], set[int]] = {}
        self.first: dict[str, set[str]] = {}
        self.last: dict[str, set[str]] = {}
        self.beside: dict[str, set[tuple[str, str]]] = {}
        self.ends, self.several = [1, 1], set()
        for i, symbols in enumerate(self.symbols):
            for s in symbols:
                self.first.setdefault(s, {s})
                self.last.setdefault(s, {s})
            self._add(i, symbols, 1)
        self.queue = [(-n, *pair) for pair, n in self.count.items()]
        heapq.heapify(self.queue)

    def _add(self, i: int, symbols: list[str], sign: int) -> set[tuple[str, str]]:
        pairs = list(zip(symbols, symbols[1:]))
        for pair in pairs:
            self.count[pair] = self.count.get(pair, 0) + sign * self.freq[i]
        for pair in set(pairs):
            if pair not in self.held:
                self.held[pair] = set()
                for s in pair:
                    self.beside.setdefault(s, set()).add(pair)
            self.held[pair].add(i) if sign > 0 else self.held[pair].discard(i)
        return set(pairs)

    def best(self) -> tuple[int, str, str] | None:
        """The most frequent pair, ties by left then right symbol."""
        while self.queue:
            n, left, right = self.queue[0]
            if self.count.get((left, right), 0) == -n and n:
                return -n, left, right
            heapq.heappop(self.queue)
        return None

    def _across(self, left: str, right: str) -> int:
        """Ways in which occurrences of a pair may lie across cuts."""
        return sum((p, q) not in self.leading for p in self.last[left] for q in self.first[right])

    def certain(self, n: int, left: str, right: str) -> bool:
        """Whether no pair can be as frequent as this one, whatever lies across cuts."""
        if n <= self.outside * self.ends[0] * self.ends[1] or self._across(left, right):
            return False
        for a, b in {pair for s in self.several for pair in self.beside.get(s, ())}:
            if (seen := self.count[a, b]) and (ways := self._across(a, b)) and seen + ways * self.outside >= n:
                return False
        return True

    def merge(self, left: str, right: str) -> None:
        made, touched = left + right, set()
        for k, (parts, of) in enumerate(((self.first, left), (self.last, right))):
            # A symbol that stands in words already, in segments or not, is a part of its own.
            parts.setdefault(made, {made} if made in self.known else set()).update(parts[of])
            if len(parts[made]) > 1:
                self.several.add(made)
                self.ends[k] = max(self.ends[k], len(parts[made]))
        for i in list(self.held[(left, right)]):
            touched |= self._add(i, self.symbols[i], -1)
            self.symbols[i] = merged(self.symbols[i], left, right)
            touched |= self._add(i, self.symbols[i], 1)
        for pair in touched:
            if self.count[pair]:
                heapq.heappush(self.queue, (-self.count[pair], *pair))


def merged(symbols: list[str], left: str, right: str) -> list[str]:
    """All occurrences of a pair merged, from left to right."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def rule_ranks(merges: list[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
    """Where in the list a pair stands; it can be learned again after other merges have made it anew."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for rank, pair in enumerate(merges):
        ranks.setdefault(pair, []).append(rank)
    return ranks


def segmented(symbols: list[str], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """All merges in learned order, each once over the word. Takes n log n steps for n symbols, however many merges there are."""
    after, before, symbols = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), list(symbols)
    queue: list[tuple[int, int]] = []

    def offer(at: int, past: int) -> None:
        right = after[at]
        if right < len(symbols):
            places = ranks.get((symbols[at], symbols[right]))
            if places and places[-1] > past:
                heapq.heappush(queue, (places[bisect_right(places, past)], at))

    for at in range(len(symbols) - 1):
        offer(at, -1)
    while queue:
        rank, at = heapq.heappop(queue)
        right = after[at]
        places = ranks.get((symbols[at], symbols[right])) if symbols[at] is not None and right < len(symbols) else None
        if not places or rank not in places:
            continue
        symbols[at] += symbols[right]
        symbols[right] = None
        after[at] = after[right]
        if after[at] < len(symbols):
            before[after[at]] = at
        offer(at, rank)
        if before[at] >= 0:
            offer(before[at], rank)
    return [s for s in symbols if s is not None]


@dataclass
class BpeModel:
    """Merges in learned order, and the training words in their final segmentation."""

    merges: list[tuple[int, str, str, str, int]]
    words: DataFrame

    def merge_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.merges, MERGE_SCHEMA)

    def symbols(self) -> DataFrame:
        return self.words.select(F.explode(symbols_of(F.col("packed"))).alias("symbol")).distinct()


def train_bpe(docs: DataFrame, num_merges: int = DEFAULT_MERGES) -> BpeModel:
    """Merge the most frequent pair, ties by left then right symbol, until ``num_merges`` or no pair is left.

    A round counts the pairs of all distinct words that still have one, takes the leading ones, and cuts the words to segments
    of these, added up by content. The next merges are read off the segments, as long as no pair outside can be as frequent;
    hundreds of merges pass in a round. Segments are few, because frequent pairs combine in few ways; where they are more than
    ``SEGMENTS``, the same is done with fewer leading pairs. The driver sees leading pairs, segments and the merge list,
    all bounded.
    """
    counted = store(word_counts(docs), "bpe-words").df
    words = store(counted.select(symbol_string(F.col("word")).alias("packed"), "freq"), "bpe-packed")
    merges: list[tuple[int, str, str, str, int]] = []
    while len(merges) < num_merges:
        leading = pair_counts(words.df).orderBy(F.desc("freq"), "left", "right").limit(LEADING_PAIRS + 1).collect()
        if not leading:
            break
        outside = leading.pop()["freq"] if len(leading) > LEADING_PAIRS else 0
        segments = _segments(words.df, leading)
        while (segments.rows > SEGMENTS or segments.memory_bytes > SEGMENT_BYTES) and len(leading) > 1:
            half = len(leading) // 2
            outside, leading = leading[half]["freq"], leading[:half]
            segments = _segments(segments.df, leading)
        found = Segments(
            [(r["packed"][1:-1].split("  "), r["freq"]) for r in segments.df.collect()], {(r["left"], r["right"]) for r in leading}, outside,
            {m[3] for m in merges},
        )
        fresh = []
        while len(merges) + len(fresh) < num_merges and (best := found.best()):
            # The first of the leading pairs is the next merge in any case.
            if fresh and not found.certain(*best):
                break
            n, left, right = best if fresh else (leading[0]["freq"], leading[0]["left"], leading[0]["right"])
            found.merge(left, right)
            fresh.append((left, right, n))
        merges += [(len(merges) + k + 1, left, right, left + right, n) for k, (left, right, n) in enumerate(fresh)]
        if len(merges) < num_merges:
            grown = _merged_words(words.df, [(left, right) for left, right, _ in fresh])
            following = store(grown.filter(F.contains(F.col("packed"), F.lit("  "))), "bpe-packed")
            words.discard()
            words = following
    rules = [(m[1], m[2]) for m in merges]
    return BpeModel(merges, encode_words(counted, rules).withColumn("packed", F.concat(F.lit(" "), F.array_join("symbols", "  "), F.lit(" "))))


def _segments(words: DataFrame, leading: list) -> StoredTable:
    """Words cut between neighbours that are no leading pair; equal segments added up."""
    pairs = {(r["left"], r["right"]) for r in leading}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for packed, freq in zip(batch.column("packed").to_pylist(), batch.column("freq").to_pylist()):
                symbols, start = packed[1:-1].split("  "), 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in pairs:
                        if i - start > 1:
                            found[" " + "  ".join(symbols[start:i]) + " "] += freq
                        start = i
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["packed", "freq"])

    parts = words.select("packed", "freq").mapInArrow(cut, "packed string, freq bigint")
    return store(parts.groupBy("packed").agg(F.sum("freq").alias("freq")), "bpe-segments")


def _merged_words(words: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``packed`` after more merges, other columns as they are."""
    ranks = rule_ranks(rules)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [" " + "  ".join(segmented(p[1:-1].split("  "), ranks)) + " " for p in batch.column("packed").to_pylist()]
            at = batch.schema.get_field_index("packed")
            yield batch.set_column(at, "packed", pa.array(done, pa.string()))

    return words.mapInArrow(merge, words.schema)


def encode_words(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``symbols`` for each ``word``; pass distinct words."""
    packed = words.withColumn("packed", symbol_string(F.col("word")))
    return _merged_words(packed, merges).withColumn("symbols", symbols_of(F.col("packed"))).drop("packed")


class _Remembered:
    """What ``encode`` makes of words; those met last are kept, so nearly all occurrences cost a look into a table of bounded size."""

    def __init__(self, encode: Callable[[str], list], room: int):
        self.encode, self.room, self.young, self.old = encode, room, {}, {}

    def __call__(self, word: str) -> list:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            found = self.encode(word) if found is None else found
            if len(word) <= HEAD_WORD_CHARS:
                if len(self.young) >= self.room:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return found


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about ``SLICE_BYTES`` in ``column``, a row at least."""
    step = max(1, int(len(batch) * SLICE_BYTES / max(batch.column(column).nbytes, 1)))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def _encoded_texts(
    docs: DataFrame, texts: dict[str, Column], key: str, encode: Callable[[str], list], kind: str, most_words: int | None = None
) -> DataFrame:
    """``key`` and for each text what ``encode`` makes of its words, end to end.

    The encoding of a word hangs on the word alone, so it is made where the text lies; only texts are shuffled, which brings those of a key
    together. Of several rows with a key the words stand by place, those of one place by their encoding. A row with a null text has no words.
    """
    names = list(texts)
    row = F.struct(*[c.alias(n) for n, c in texts.items()])
    gathered = docs.select(key, row.alias("_texts")).groupBy(key).agg(F.collect_list("_texts").alias("_texts"))
    value, room = {"string": pa.string(), "bigint": pa.int64()}[kind], HEAD_WORDS

    def of_rows(rows: list[dict], known: _Remembered) -> list[list[str]]:
        # Python splits at the same characters as ``whitespace_words``.
        split = [[r[n].split() for n in names] for r in rows if None not in r.values()]
        if len(split) == 1:
            return split[0]
        placed: list[list] = [[] for _ in names]
        for lists in split:
            start = 0
            for n, words in enumerate(lists):
                placed[n] += [(start + k, word) for k, word in enumerate(words)]
                start += len(words)
        order = lambda e: (e[0], [s.encode() if kind == "string" else s for s in known(e[1])])
        return [[word for _, word in sorted(entries, key=order)] for entries in placed]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(encode, room)
        for batch in batches:
            for part in _slices(batch, "_texts"):
                places: dict[str, int] = {}
                at: list[list[int]] = [[] for _ in names]
                ends: list[list[int]] = [[0] for _ in names]
                for rows in part.column("_texts").to_pylist():
                    for n, words in enumerate(of_rows(rows, known)):
                        at[n] += [places.setdefault(word, len(places)) for word in words[:most_words]]
                        ends[n].append(len(at[n]))
                table = pa.array([known(word) for word in places], pa.list_(value))
                lists = []
                for n in range(len(names)):
                    taken = table.take(pa.array(at[n], pa.int32()))
                    upto = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))]).astype("int32")
                    lists.append(pa.ListArray.from_arrays(pa.array(upto[ends[n]], pa.int32()), taken.flatten()))
                yield pa.RecordBatch.from_arrays([part.column(key), *lists], names=[key, *names])

    schema = T.StructType([gathered.schema[key], *[T.StructField(n, T._parse_datatype_string(f"array<{kind}>")) for n in names]])
    return gathered.mapInArrow(read, schema)


def _symbols(word: str) -> list[str]:
    """What ``symbol_string`` holds for one word."""
    return [*word.replace(WORD_END, WORD_END[0] + _APART + WORD_END[1:]), WORD_END]


def encode_docs(
    docs: DataFrame, merges: list[tuple[str, str]], key: str = "doc_id", limit: int | None = None
) -> DataFrame:
    """``key`` and the symbols of all its words in order.

    Words are merged in the tasks that hold the texts, which remember those met before. No table is looked up, so ``limit`` changes nothing.
    """
    ranks = rule_ranks(merges)
    return _encoded_texts(docs.repartition(F.col(key)), {"symbols": F.col("text")}, key, lambda word: segmented(_symbols(word), ranks), "string")


def decode_symbols(symbols: Column) -> Column:
    """Symbols back to text: glued together, a space where a word ended."""
    spaced = F.replace(F.array_join(symbols, ""), F.lit(WORD_END), F.lit(" "))
    return F.rtrim(F.replace(spaced, F.lit(_APART), F.lit("")))


def bpe_vocabulary(model: BpeModel) -> Vocabulary:
    """Specials, then the symbols of the training words before any merge in byte order, then merged symbols as learned.

    There are as many rows as characters in use and merges, so the driver may hold them.
    """
    spark = model.words.sparkSession
    single = model.words.select(F.explode(symbols_of(symbol_string(F.col("word")))).alias("s")).distinct()
    base = sorted((r["s"] for r in single.collect()), key=str.encode)
    tokens = [t for t in dict.fromkeys([*base, *(m[3] for m in model.merges)]) if t not in SPECIALS]
    rows = [(t, i, 0) for i, t in enumerate([*SPECIALS, *tokens])]
    table = store(spark.createDataFrame(rows, "token string, id bigint, freq bigint"), "bpe-vocabulary")
    return Vocabulary(table, len(rows))


def encode_id_columns(
    docs: DataFrame, texts: dict[str, Column], merges: list[tuple[str, str]], vocab: Vocabulary, max_length: int | None = None,
    key: str = "doc_id", limit: int | None = None,
) -> DataFrame:
    """``key`` and the ids of several texts; symbols the vocabulary lacks are ``<unk>``. A text is cut after it is encoded.

    The vocabulary has as many rows as characters in use and merges, so it goes to the tasks with the merges; ``limit`` changes nothing.
    """
    ranks, ids = rule_ranks(merges), {r["token"]: r["id"] for r in vocab.table.df.select("token", "id").collect()}
    # A word has one id at least, so no word past ``max_length`` counts.
    encoded = _encoded_texts(docs, texts, key, lambda word: [ids.get(s, UNK_ID) for s in segmented(_symbols(word), ranks)], "bigint", max_length)
    return encoded if max_length is None else encoded.select(key, *[F.slice(n, 1, max_length).alias(n) for n in texts])


def decode_id_symbols(rows: DataFrame, ids: Column, vocab: Vocabulary, out: str = "text", key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """``key`` and the text of its ids; special tokens are left out."""
    places = rows.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    found = lookup_join(places, vocab.table.select("id", "token"), ["id"], [key, "pos"], limit=limit)
    shown = F.col("token").isNotNull() & ~F.col("token").isin(*SPECIALS, BLANK_MARK)
    gathered = found.groupBy(key).agg(F.collect_list(F.when(shown, F.struct("pos", "token"))).alias("_e"))
    return gathered.select(key, decode_symbols(F.sort_array("_e")["token"]).alias(out))
