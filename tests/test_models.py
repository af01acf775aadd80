import math
import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import examples, metrics, ngram, sampling
from storyloom.operators.tokenizers import WordTokenizer
from storyloom.operators.vocabulary import build_vocabulary
from tests import plain

SEQS = [[2, 5, 6, 5, 7, 3], [2, 5, 6, 3], [2, 9, 9, 9, 3], [2, 3]]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "doc_id bigint, ids array<bigint>")


def test_counts_of_both_routes_agree(spark, docs):
    tokens = tx.simple_tokens(F.col("text"))
    vocab = build_vocabulary(docs.filter("doc_id < 4"), tokens)
    through_ids = ngram.ngram_counts(examples.framed_ids(docs, WordTokenizer(vocab)))
    as_set = lambda df: {tuple(r) for r in df.select("context", "target", "freq").collect()}
    for limit in (None, 0):
        assert as_set(ngram.bigram_counts(docs, tokens, vocab, limit)) == as_set(through_ids)


def test_trigram_context(spark, seqs):
    rows = {(r["context"], r["target"]): r["freq"] for r in ngram.ngram_counts(seqs, order=3).collect()}
    assert rows[("2", 5)] == 2 and rows[("2 5", 6)] == 2 and rows[("9 9", 9)] == 1


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("smoothing", [0.0, 0.1])
def test_document_losses(spark, seqs, limit, smoothing, monkeypatch):
    monkeypatch.setattr(ngram, "HEAD_PAIRS", 6)
    counts, v = plain.bigrams(SEQS[:2]), 12
    model = ngram.train_ngram(seqs.filter("doc_id < 2"), v)
    rows = {r["doc_id"]: r for r in ngram.document_losses(seqs, model, smoothing, limit=limit).collect()}
    for doc, ids in enumerate(SEQS):
        want = 0.0
        for c, t in zip(ids, ids[1:]):
            mean = sum(plain.loss(counts, v, 1.0, c, w) for w in range(v)) / v
            want += (1 - smoothing) * plain.loss(counts, v, 1.0, c, t) + smoothing * mean
        assert rows[doc]["nll_sum"] == pytest.approx(want) and rows[doc]["n_tokens"] == len(ids) - 1


def test_padding_is_not_scored(spark):
    padded = spark.createDataFrame([(0, [2, 5, 3, 0, 0])], "doc_id bigint, ids array<bigint>")
    model = ngram.train_ngram(spark.createDataFrame([(0, [2, 5, 3])], "doc_id bigint, ids array<bigint>"), 6)
    assert ngram.document_losses(padded, model).first()["n_tokens"] == 2


def test_no_smoothing_gives_infinite_and_undefined_losses(spark, seqs):
    model = ngram.train_ngram(seqs.filter("doc_id = 1"), 12, alpha=0.0)
    pairs = spark.createDataFrame([(0, 1, 2, 5), (0, 2, 5, 9), (0, 3, 9, 9)], "doc_id bigint, pos int, context bigint, target bigint")
    got = {r["pos"]: r["nll"] for r in ngram.score_pairs(pairs, model).collect()}
    assert got[1] == 0.0 and math.isinf(got[2]) and math.isnan(got[3])


def test_infill_losses(spark, seqs):
    counts = plain.bigrams(SEQS)
    model = ngram.train_ngram(seqs, 12)
    truths = spark.createDataFrame([(0, [5, 6], [5, 7]), (1, [5], [])], "doc_id bigint, first array<bigint>, middle array<bigint>")
    rows = ngram.infill_losses(truths, model).collect()
    want = (plain.loss(counts, 12, 1.0, 6, 5) + plain.loss(counts, 12, 1.0, 5, 7)) / 2
    assert len(rows) == 1 and rows[0]["n_steps"] == 2 and rows[0]["loss"] == pytest.approx(want)


def scores(spark, *rows):
    return spark.createDataFrame([("x", t, float(s)) for t, s in rows], "context string, token bigint, score double")


def test_top_k_ties(spark):
    df = scores(spark, (1, 3), (2, 2), (3, 2), (4, 1))
    assert sorted(r["token"] for r in sampling.top_k(df, ["context"], 2, ties=True).collect()) == [1, 2, 3]
    assert sorted(r["token"] for r in sampling.top_k(df, ["context"], 2, ties=False).collect()) == [1, 2]
    assert sampling.greedy(scores(spark, (4, 2), (3, 2), (9, 1)), ["context"]).first()["token"] == 3


def test_top_p(spark):
    df = scores(spark, (1, 0.53), (2, 0.20), (3, 0.20), (4, 0.07)).withColumnRenamed("score", "p")
    keep = lambda p: sorted(r["token"] for r in sampling.top_p(df, ["context"], p).collect())
    assert keep(0.5) == [1] and keep(0.53) == [1, 2] and keep(0.9) == [1, 2, 3] and keep(0.0) == [1]


def test_sanitize(spark):
    df = scores(spark, (1, math.nan), (2, math.inf), (3, -math.inf), (4, 70), (5, -70), (6, 1.5))
    got = {r["token"]: r["s"] for r in df.select("token", sampling.sanitize(F.col("score")).alias("s")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 50.0, 5: -50.0, 6: 1.5}


@pytest.mark.parametrize("ties, temperature, k, p", [(True, 1.0, 3, 0.9), (False, 0.5, 4, 0.8), (True, 1.5, 50, 1.0)])
def test_candidates(spark, ties, temperature, k, p):
    rng = random.Random(5)
    raw = {c: {t: math.log(rng.randint(1, 6)) for t in range(rng.randint(1, 12))} for c in "abcdef"}
    df = spark.createDataFrame([(c, t, s) for c, d in raw.items() for t, s in d.items()], "context string, token bigint, score double")
    out = sampling.candidates(df, ["context"], temperature, k, p, ties=ties)
    for c, d in raw.items():
        got = {r["token"]: r["p"] for r in out.filter(F.col("context") == c).collect()}
        want = dict(plain.nucleus(d, temperature, k, p, ties))
        assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


@pytest.mark.parametrize("chunk", [1024, 2])
@pytest.mark.parametrize("limit", [None, 0])
def test_draws(spark, chunk, limit, monkeypatch):
    """One candidate for each prompt, however candidates are cut into rows and tables are joined; unknown contexts
    draw from the counts of all tokens."""
    monkeypatch.setattr(sampling, "CHUNK_ENTRIES", chunk)
    counts = {(c, t): (c * 7 + t * 3) % 5 + 1 for c in range(4) for t in range(c + 5)}
    df = spark.createDataFrame([(c, t, f) for (c, t), f in counts.items()], "context bigint, target bigint, freq bigint")
    prompts = spark.createDataFrame([(i, i % 5) for i in range(60)], "prompt_id bigint, context bigint")
    table = sampling.draw_table(df, p_limit=0.95)
    drawn = sampling.draw(prompts, table, sampling.prompt_draw(3, "prompt_id", 0), ["prompt_id"], limit=limit).collect()
    assert len(drawn) == 60
    unigrams = {}
    for (_, t), f in counts.items():
        unigrams[t] = unigrams.get(t, 0) + f
    for r in drawn:
        own = {t: math.log(f) for (c, t), f in counts.items() if c == r["context"]}
        ranked = plain.nucleus(own or {t: math.log(f) for t, f in unigrams.items()}, 1.0, 50, 0.95, True)
        mass, u = 0.0, plain.draw(3, r["prompt_id"], 0)
        for token, q in ranked:
            mass += q
            if mass > u:
                break
        assert r["token"] == token


def test_top_k_of_zero_keeps_all(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "context string, token bigint, score double")
    assert sampling.top_k(df, ["context"], 0, True).count() == sampling.top_k(df, ["context"], -1, False).count() == 9
    assert sampling.top_k(df.withColumn("k", F.lit(0)), ["context"], F.col("k"), True).count() == 9
    assert sampling.candidates(df, ["context"], k=0, p_limit=1.0).count() == 9


def test_no_row_is_lost_where_a_stretch_ends_early(spark):
    """Stretches that stop short of one, as sums of probabilities may: the likeliest token is drawn."""
    counts = spark.createDataFrame([(1, t, 5 - t) for t in range(4)], "context bigint, target bigint, freq bigint")
    table = sampling.draw_table(counts)
    short = F.transform("entries", lambda e: F.struct((e["high"] * 0.5).alias("high"), e["token"].alias("token")))
    halved = sampling.DrawTable(sampling.StoredTable(table.chunks.df.withColumn("entries", short), "", 1, 1), table.fallback)
    state = spark.createDataFrame([(i, 1) for i in range(20)], "prompt_id bigint, context bigint")
    for limit in (None, 0):
        drawn = sampling.draw(state, halved, F.lit(0.9), ["prompt_id"], limit=limit).collect()
        assert len(drawn) == 20 and {r["token"] for r in drawn} == {0}


def test_decode_settings(spark):
    rows = sampling.decode_settings(spark.range(3), [{"top_k": 2}, {"top_p": 0.5}]).collect()
    assert len(rows) == 6 and {(r["setting"], r["top_k"], r["top_p"]) for r in rows} == {(0, 2, 0.9), (1, 50, 0.5)}


def test_metrics(spark):
    rows = [(0, 0, 0, 2.0), (0, 0, 1, 4.0), (0, 1, 0, 9.0), (1, 0, 0, math.nan), (1, 0, 1, 1000.0), (1, 1, 0, 1000.5), (1, 1, 1, math.inf)]
    df = spark.createDataFrame(rows, "epoch int, rank int, batch_id bigint, loss double")
    assert sorted(r["loss"] for r in metrics.valid_losses(df).collect()) == [2.0, 4.0, 9.0, 1000.0]
    report = {r["epoch"]: r for r in metrics.epoch_loss(df).collect()}
    assert report[0]["epoch_loss"] == 5.0 and report[1]["epoch_loss"] == 250.0 and report[1]["epoch_loss_valid"] == 1000.0
    assert metrics.rank_mean_loss(df.filter("epoch = 0")).first()["loss"] == 6.0
    assert {r["batch_id"] for r in metrics.every_nth(df, 2).collect()} == {1}


def test_best_epochs_are_strictly_better(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 3.0), (2, 2.0), (3, 2.5), (4, 1.0)], "epoch int, loss double")
    assert [r["epoch"] for r in metrics.best_epochs(df).orderBy("epoch").collect()] == [0, 2, 4]


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("k, p", [(7, 0.8), (0, 1.0), (40, 0.5), (1, 0.9)])
def test_large_contexts_in_slices_equal_whole_ones(spark, monkeypatch, ties, k, p):
    """Contexts of which some are cut to slices, with many equal scores, a null context and a limit beyond a slice."""
    rng = random.Random(k)
    rows = [(c, t, math.log(rng.randint(1, 4))) for c, n in ((1, 3), (2, 90), (3, 9), (4, 61), (None, 70)) for t in range(n)]
    df = spark.createDataFrame(rows, "context bigint, token bigint, score double").repartition(5)
    shown = lambda out: sorted((str(r.context), r.token, round(r.p, 9), round(r.high, 9), r.place) for r in out.collect())
    whole = shown(sampling.candidates(df, ["context"], 0.7, k, p, ties=ties, bounds=True))
    monkeypatch.setattr(sampling, "SLICE_ROWS", 10)
    parts = sampling.sliced_parts(df, ["context"])
    assert len(parts) == 2 and parts[1].select("_slice").distinct().count() > 3
    assert shown(sampling.candidates(df, ["context"], 0.7, k, p, ties=ties, bounds=True)) == whole
    assert sorted(map(str, sampling.top_k(df, ["context"], k, ties).collect())) == sorted(
        str(r) for c in {r[0] for r in rows} for r in best_rows([x for x in rows if x[0] == c], k, ties)
    )
    settings = df.withColumn("k", F.lit(k))
    assert sampling.top_k(settings, ["context"], F.col("k"), ties).count() == sampling.top_k(df, ["context"], k, ties).count()


def best_rows(own, k, ties):
    from pyspark.sql import Row

    ranked = sorted(own, key=lambda r: (-r[2], r[1]))
    kept = ranked if k <= 0 or k >= len(ranked) else [r for r in ranked if r[2] >= ranked[k - 1][2]] if ties else ranked[:k]
    return [Row(context=c, token=t, score=s) for c, t, s in kept]


def test_no_task_holds_a_large_context(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SLICE_ROWS", 10_000)
    df = spark.range(200_000).select(F.lit(7).alias("context"), F.col("id").alias("token"), F.log(F.col("id") % 50 + 1).alias("score"))
    part = sampling.sliced_parts(df, ["context"])[1]
    sizes = [r["count"] for r in part.groupBy("_slice").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 100_000 and sum(sizes) == 200_000
    out = sampling.softmax(df, ["context"])
    assert abs(out.agg(F.sum("p")).first()[0] - 1) < 1e-9


def test_counts_in_more_partitions_are_the_same(spark, seqs):
    stored = ngram.ngram_counts(seqs, order=3, partitions=7)
    assert sorted(map(str, stored.collect())) == sorted(map(str, ngram.ngram_counts(seqs, order=3).collect()))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_texts_of_a_partition_are_bounded(spark, docs, monkeypatch):
    assert examples.text_partitions(docs) == 4
    monkeypatch.setattr(examples, "PARTITION_BYTES", 20)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = examples.text_partitions(docs)
    assert parts == -(-size // 20) and examples.keyed(docs, parts).rdd.getNumPartitions() == parts
