"""Blocks that ask for counts give what joins of positions give, without a row for each position."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from storyloom import scratch
from storyloom.operators import lookup, ngram, packed
from storyloom.operators.vocabulary import build_vocabulary, encode_columns


def both_ways(monkeypatch, make):
    """What ``make`` gives with tables too large for every worker, and with tables that are not."""
    made = []
    for size in (0, lookup.BROADCAST_BYTES):
        with monkeypatch.context() as m:
            m.setattr(lookup, "BROADCAST_BYTES", size)
            made.append(make())
    return made


def stories(n=40, seed=3):
    rng = random.Random(seed)
    made = [(i, [2, *(rng.choice([4, 5, 6, rng.randrange(4, 60)]) for _ in range(rng.randrange(30))), 3]) for i in range(n)]
    # Keys may repeat or be null; lists may be empty, null or hold padding and ids that no count has.
    return [*made, (0, [2, 5, 0, 6, 3]), (None, [2, 7, 4_000_000_000, 7, 3]), (None, [2, 5, None, 6, 3]), (901, []), (902, None), (903, [2])]


def told(df):
    show = lambda x: f"{x:.9f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in df.collect())


@pytest.mark.parametrize("alpha,smoothing", [(1.0, 0.0), (1.0, 0.1), (0.0, 0.0), (0.5, 0.2)])
def test_losses_of_blocks_and_of_positions_agree(spark, monkeypatch, alpha, smoothing):
    monkeypatch.setattr(packed, "BLOCK_IDS", 50)
    monkeypatch.setattr(packed, "BUCKET_KEYS", 20)
    seqs = spark.createDataFrame(stories(), "doc_id bigint, ids array<bigint>").repartition(3)
    model = ngram.train_ngram(seqs.filter("doc_id < 25"), 60, alpha)
    blocks, joins = both_ways(monkeypatch, lambda: ngram.document_losses(seqs, model, smoothing))
    assert "FlatMapGroupsInArrow" in blocks._jdf.queryExecution().executedPlan().toString()
    got = told(blocks)
    assert got == told(joins) == told(ngram.document_losses(seqs, model, smoothing, limit=0)) and len(got) == 41
    if not alpha:
        assert any("inf" in r[1] or "nan" in r[1] for r in got)


def test_infill_losses_of_blocks_and_of_positions_agree(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_IDS", 50)
    rng = random.Random(5)
    ids = lambda most: [rng.randrange(4, 30) for _ in range(rng.randrange(most))]
    truths = spark.createDataFrame([(i, ids(3), ids(9)) for i in range(60)], "doc_id bigint, first array<bigint>, middle array<bigint>")
    model = ngram.train_ngram(spark.createDataFrame(stories(), "doc_id bigint, ids array<bigint>"), 60)
    got, want = both_ways(monkeypatch, lambda: told(ngram.infill_losses(truths, model)))
    assert got == want and got


def test_a_question_goes_once_for_each_block(spark):
    """A pair that a block holds a thousand times leaves it once; before, every position was shuffled."""
    seqs = spark.createDataFrame([(i, [2, *[5, 6] * 200, 3]) for i in range(50)], "doc_id bigint, ids array<bigint>").coalesce(1)
    model = ngram.train_ngram(seqs, 10)
    rows = packed.row_losses(seqs, model.pairs.df, model.contexts.df, 8, 1.0, 10, 0.0, 0)
    assert rows.count() == 50
    want = -math.log((50 * 200 + 1) / (50 * 200 + 10))
    assert abs(rows.first()["nll_sum"] / 401 - want) < 0.05


def test_shuffles_of_a_stored_table_go(spark):
    manager = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager().getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    kept = scratch.store(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 97).alias("k")).count(), "shuffled")
    assert kept.rows == 97
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_words_of_blocks_and_of_rows_have_the_same_ids(spark, monkeypatch):
    """Keys may repeat or be null, lists may be null or empty, and a block may hold one text or many."""
    monkeypatch.setattr(packed, "BLOCK_IDS", 30)
    rng = random.Random(7)
    words = lambda most: " ".join(rng.choice(["a", "b", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(most)))
    rows = [(i, words(20), words(6)) for i in range(50)] + [(3, words(9), words(9)), (None, "a b", "c"), (None, "b w1 w2", None), (None, "w3 a", "b"), (60, None, "a"), (61, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other string").repartition(3)
    lists = {"x": F.split("text", " "), "y": F.split("other", " ")}
    vocab = build_vocabulary(docs.filter("doc_id < 20"), lists["x"])
    ids = both_ways(monkeypatch, lambda: told(encode_columns(docs, lists, vocab).select("doc_id", "x", "y")))
    assert ids[0] == ids[1] and len(ids[0]) == 53
    pairs = both_ways(monkeypatch, lambda: told(ngram.bigram_counts(docs, lists["x"], vocab).select("context", "target", "freq")))
    assert pairs[0] == pairs[1] and len(pairs[0]) > 50


def test_no_text_and_no_row(spark, monkeypatch):
    """Tables without a row, or without a word, count and encode to nothing."""
    docs = spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, text string")
    vocab = build_vocabulary(docs, F.split("text", " "))
    for rows in (docs, docs.filter("doc_id > 5")):
        ids = both_ways(monkeypatch, lambda: told(encode_columns(rows, {"x": F.split("text", " ")}, vocab)))
        pairs = both_ways(monkeypatch, lambda: told(ngram.bigram_counts(rows, F.split("text", " "), vocab)))
        assert ids[0] == ids[1] and pairs == [[], []]


def test_what_a_stored_table_was_built_from_goes(spark):
    made = []

    def make():
        made.append(scratch.store(spark.range(5), "step"))
        return made[0].df.filter("id > 2")

    kept = scratch.store_made(spark, make, "kept")
    fs, path = scratch._filesystem(spark, made[0].path)
    assert kept.rows == kept.df.count() == 2 and not fs.exists(path)
