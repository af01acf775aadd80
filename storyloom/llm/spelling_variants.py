"""Words that differ by one letter, found by walking a relational trie.

The words of a table, and the same words reversed, form a trie whose edges are rows: (node, label, child). A node stands at a
level; levels are one code point apart up to ``SINGLE``, then each is as deep as all before it, so a word of a million letters
has 47. A node that only one word reaches is not followed: the edge into it holds the rest of that word.

A frontier of states (word, position, node, edits) is joined with the edges level by level. A state without edits goes on along its
own path and, at every edge that leaves it, makes states with one edit: a deleted code point, or one replaced by a larger one. A
state with one edit only follows its own letters, and goes where the child lacks the next one. What meets the rest of another
word with one edit in all is a pair. Inserting is the deletion of the other word, and a smaller code point the larger one of the other
word, so a pair is walked from one side and then counts for both. Two words that are near share the first half or the last half of either, so a word starts
at half its length, forwards and backwards; the wide upper part of the trie is never walked.

Nodes are known by a 96-bit hash of their prefix. A pair is confirmed on the words themselves, so hashes decide nothing.

Defined results: a null text has no words; a null identifier is part of no hash, so the runs of such rows stay as they are; rows
that share an identifier count each; no rows, or no word that is frequent and long enough, give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import text_or_empty
from storyloom.scratch import store

# Fixed values of the task: the letters of a run, the shortest word, the least number of occurrences, the ratio for a form.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
# Levels that are one code point apart; a power of two.
SINGLE = 32
_SHIFT = SINGLE - SINGLE.bit_length() + 1
_END = "\0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``_id`` and ``_run`` for every maximal run of at least ``least`` letters, A-Z in lower case."""
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"{LETTERS}{{{least},}}+"), 0)
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(runs).alias("_run"))
    # Within ASCII lower case is that of A-Z alone.
    lowered = F.when(F.octet_length("_run") == F.length("_run"), F.lower("_run")).otherwise(F.translate("_run", _UPPER, _LOWER))
    return found.select("_id", lowered.alias("_run"))


def thinned(runs: DataFrame, every: int = 31) -> DataFrame:
    """``word`` of each run: where ``every`` divides the run's hash, one of its code points is left out."""
    h = F.crc32(F.concat(F.col("_id").cast("string"), F.lit(":"), F.col("_run")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    return runs.withColumn("_h", h).select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("word"))


def frequent_words(words: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of what is long and frequent enough."""
    counted = words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= times)


def _level(depth: Column) -> Column:
    """The deepest level that is not below ``depth``."""
    return F.when(depth <= SINGLE, depth).otherwise(F.length(F.bin(depth)) - 1 + _SHIFT).cast("int")


def _depth(level: Column) -> Column:
    return F.when(level <= SINGLE, level).otherwise(F.call_function("shiftleft", F.lit(1), level - _SHIFT)).cast("int")


def _node(way: Column, prefix: Column) -> list[Column]:
    return [F.xxhash64(way, prefix).alias("_node"), F.hash(prefix, way).alias("_check")]


def _substr(text: str, start: Column, length: Column | None = None) -> Column:
    """From position ``start``, counted from 0."""
    return F.substring(F.col(text), start + 1, length if length is not None else F.length(text))


@dataclass(frozen=True)
class Trie:
    """Stored edges, stored start states, and the levels between which there is something to do."""

    edges: DataFrame
    starts: DataFrame
    first: int
    last: int


def build_trie(words: DataFrame) -> Trie:
    """The trie of ``words`` (``_i``, ``word``, ``n``), forwards and backwards.

    A word of length m enters it at level (m - 1) / 2 only, because what is near has at least m - 1 letters and starts there or deeper.
    """
    both = words.select("_i", "word", "n", F.inline(F.array(
        F.struct(F.lit(0).alias("_way"), F.col("word").alias("_w")), F.struct(F.lit(1).alias("_way"), F.reverse("word").alias("_w")))))
    size = F.length("_w")
    deepest = _level(size) + 1
    low = _level(F.floor((size - 1) / 2).cast("int"))
    levels = both.select("_i", "_way", "_w", F.explode(F.sequence(low, deepest)).alias("_k"))
    prefix = F.when(F.col("_k") <= _level(size), _substr("_w", F.lit(0), _depth(F.col("_k")))).otherwise(F.concat("_w", F.lit(_END)))
    reached = levels.select("_i", "_way", "_k", prefix.alias("_prefix")).groupBy("_way", "_k", "_prefix")
    nodes = store(reached.agg(F.count(F.lit(1)).alias("_words"), F.min("_i").alias("_i")), "trie-nodes").df

    k = F.col("_k")
    # The level from which on a word is alone down to its end: its levels with one word are a run that ends at the deepest.
    alone = nodes.filter("_words = 1").groupBy("_way", "_i").agg(F.sort_array(F.collect_list("_k")).alias("_ks"))
    ks = F.col("_ks")
    ending = F.filter(ks, lambda x, i: x - i == F.element_at(ks, -1) - F.size(ks) + 1)
    lone = store(alone.withColumn("_from", F.element_at(ending, 1)).join(both, ["_way", "_i"]), "trie-lone").df
    # Above that run a word can be alone too, where those that share more of it enter the trie deeper.
    upper = lone.select("_way", "_w", F.explode(F.filter("_ks", lambda x: x < F.col("_from"))).alias("_k"))
    upper = upper.select("_way", "_k", _substr("_w", F.lit(0), _depth(k)).alias("_prefix"))
    paths = nodes.filter("_words > 1").select("_way", "_k", "_prefix").unionByName(upper).filter("_k > 0")
    inner = paths.select(
        (k - 1).alias("_k"), *_node(F.col("_way"), _substr("_prefix", F.lit(0), _depth(k - 1))), _substr("_prefix", _depth(k - 1)).alias("_label"),
        *(c.alias(n) for c, n in zip(_node(F.col("_way"), F.col("_prefix")), ("_child", "_child_check"))),
        F.lit(None).cast("string").alias("_other"), F.lit(None).cast("bigint").alias("_other_n"))
    ends = lone.withColumn("_k", F.greatest(F.col("_from") - 1, F.lit(0)))
    leaves = ends.select(
        "_k", *_node(F.col("_way"), _substr("_w", F.lit(0), _depth(k))), _substr("_w", _depth(k)).alias("_label"), F.lit(None).cast("bigint").alias("_child"),
        F.lit(None).cast("int").alias("_child_check"), F.col("word").alias("_other"), F.col("n").alias("_other_n"))
    first = F.when(F.col("_label") == "", F.lit(_END)).otherwise(F.substring("_label", 1, 1))
    bare = store(inner.unionByName(leaves).withColumn("_first", first), "trie-bare").df
    # The letters that leave a child, so that states which cannot go on there are never made.
    out = bare.groupBy(F.col("_node").alias("_child"), F.col("_check").alias("_child_check")).agg(F.array_join(F.collect_set("_first"), "").alias("_next"))
    going = bare.filter(F.col("_other").isNull()).join(out, ["_child", "_child_check"], "left")
    ending = bare.filter(F.col("_other").isNotNull()).withColumn("_next", F.lit(None).cast("string"))
    edges = store(going.unionByName(ending).sortWithinPartitions("_k"), "trie-edges").df

    half = F.floor(size / 2).cast("int")
    at = _level(F.when(F.col("_way") == 0, half).otherwise(size - half))
    begun = both.select("_i", "_way", "_w", at.alias("_k"))
    starts = begun.select("_i", "_w", "_k", *_node(F.col("_way"), _substr("_w", F.lit(0), _depth(k))), _depth(k).alias("_p"), F.lit(0).alias("_e"))
    starts = store(starts.sortWithinPartitions("_k"), "trie-starts").df
    ends = starts.agg(F.min("_k")).first()[0], edges.agg(F.max("_k")).first()[0]
    return Trie(edges, starts, ends[0] or 0, -1 if ends[1] is None else ends[1])


def _char(position: Column) -> Column:
    """The word's code point at a position; the end mark behind the last."""
    return F.when(position >= F.length("_w"), F.lit(_END)).otherwise(_substr("_w", position, F.lit(1)))


def _states(*rows: tuple[Column, Column, int]) -> Column:
    """Array of the (position, edits) whose condition holds."""
    made = [F.when(F.coalesce(holds, F.lit(False)), F.struct(position.cast("int").alias("_q"), F.lit(edits).alias("_f"))) for holds, position, edits in rows]
    return F.filter(F.array(*made), lambda s: s.isNotNull())


def _single_step() -> Column:
    """Over one code point. Of a run of equal letters only the last is deleted; the letter put in for another one is larger."""
    p, same = F.col("_p"), F.col("_label") == _char(F.col("_p"))
    goes_on = lambda q: F.contains(F.col("_next"), _char(q))
    return _states(
        (same, p + 1, 0),
        ((F.col("_label") > _char(p)) & (p < F.length("_w")) & goes_on(p + 1), p + 1, 1),
        (~same & (p + 1 < F.length("_w")) & (F.col("_label") == _char(p + 1)) & goes_on(p + 2), p + 2, 1),
    )


def _long_step(width: int) -> Column:
    """Over a label of several code points."""
    p, label = F.col("_p"), F.col("_label")

    def near(length: int) -> Column:
        part = _substr("_w", p, F.lit(length))
        return (F.length(part) == length) & (F.levenshtein(part, label, 1) == 1)

    same = _substr("_w", p, F.lit(width)) == label
    return _states((same, p + width, 0), (near(width), p + width, 1), (near(width + 1), p + width + 1, 1))


def near_pairs(trie: Trie) -> DataFrame:
    """``_i``, ``_w`` (as walked), ``_other`` and ``_other_n`` for words one edit apart, maybe more than once.

    A pair comes from the longer word, or of two of one length from at least one of them."""
    keys, found = ["_node", "_check"], []
    columns = ["_i", "_w", *keys, "_p", "_e"]
    moved = None
    for level in range(trie.first, trie.last + 1):
        here = trie.starts.filter(F.col("_k") == level).select(*columns)
        here = here if moved is None else here.unionByName(moved)
        edges = trie.edges.filter(F.col("_k") == level).drop("_k")
        width = 1 if level < SINGLE else 1 << (level - _SHIFT)
        left = F.when(F.col("_p") < F.length("_w"), _substr("_w", F.col("_p"))).otherwise(F.lit(""))
        free = here.filter("_e = 0").join(edges, keys)
        spent = here.filter("_e = 1").withColumn("_first", _char(F.col("_p"))).join(edges, [*keys, "_first"])
        steps = F.when(F.col("_other").isNull(), _single_step() if width == 1 else _long_step(width))
        ended = F.col("_other").isNotNull()
        ends_near = (F.length("_label") <= F.length(left)) & (F.levenshtein(left, F.col("_label"), 1) == 1)
        free = free.withColumn("_hit", ended & ends_near).withColumn("_to", steps)
        follows = _substr("_w", F.col("_p"), F.lit(width)) == F.col("_label")
        onward = F.when(~ended & follows, F.array(F.struct((F.col("_p") + width).cast("int").alias("_q"), F.lit(1).alias("_f"))))
        spent = spent.withColumn("_hit", ended & (left == F.col("_label"))).withColumn("_to", onward)
        all_ = free.unionByName(spent.select(*free.columns)).filter("_hit OR size(_to) > 0")
        none = F.array(F.struct(F.lit(-1).alias("_q"), F.lit(-1).alias("_f")))
        rows = all_.withColumn("_s", F.explode(F.when(F.col("_hit"), none).otherwise(F.col("_to"))))
        step = store(rows.select("_i", "_w", F.col("_child").alias("_node"), F.col("_child_check").alias("_check"), F.col("_s._q").alias("_p"),
                                 F.col("_s._f").alias("_e"), "_other", "_other_n"), "trie-frontier").df
        found.append(step.filter(F.col("_other").isNotNull()).select("_i", "_w", "_other", "_other_n"))
        moved = step.filter(F.col("_other").isNull()).select(*columns)
    if not found:
        return trie.starts.limit(0).select("_i", "_w", F.lit("").alias("_other"), F.lit(0).cast("bigint").alias("_other_n"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and the ``root`` its forms lead to. Counts grow with every form, so pointers are doubled until none moves."""
    ways = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while ways.rows:
        further = ways.df.select(F.col("word").alias("root"), F.col("root").alias("_beyond"))
        step = store(ways.df.join(further, "root", "left").select("word", F.coalesce("_beyond", "root").alias("root"), F.col("_beyond").isNotNull().alias("_moved")), "spelling-roots")
        ways = type(step)(step.df.select("word", "root"), step.path, step.rows, step.memory_bytes)
        if not step.df.filter("_moved").limit(1).count():
            break
    return ways.df


def spelling_groups(counts: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """For each ``word`` with its ``n``: the number of near words, its ``form`` (the most frequent near word, if ``ratio`` times as
    frequent) with ``form_n``, and the ``root`` that forms lead to."""
    words = store(counts.select("word", "n").withColumn("_i", F.monotonically_increasing_id()), "spelling-words").df
    pairs = near_pairs(build_trie(words)).groupBy("_i", "_other").agg(F.first("_other_n").alias("_other_n"))
    confirmed = pairs.join(words, "_i").filter(F.levenshtein("word", "_other", 1) == 1)
    either = F.inline(F.array(
        F.struct("word", "_other", "_other_n"), F.struct(F.col("_other").alias("word"), F.col("word").alias("_other"), F.col("n").alias("_other_n"))))
    # Dealt by word, equal rows and all rows of a word meet in one shuffle.
    confirmed = confirmed.select(either).repartition("word").distinct()
    best = confirmed.groupBy("word").agg(F.count(F.lit(1)).alias("_near"), F.min(F.struct((-F.col("_other_n")).alias("n"), F.col("_other").alias("w"))).alias("_best"))
    ready = F.col("n") * ratio <= -F.col("_best.n")
    judged = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(ready, F.col("_best.w")).alias("form"),
        F.when(ready, -F.col("_best.n")).alias("form_n")), "spelling-forms").df
    roots = _roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
