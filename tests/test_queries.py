"""Registered queries against their SQL, golden counts and plan shapes.

STORYLOOM_ALL_QUERIES=1 compares every query; otherwise the quick ones and one of each kind.
"""

import os

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import examples, ngram, vocabulary
from storyloom.operators.tokenizers import WordTokenizer
from storyloom.plans.catalog import REGISTRY
from storyloom.sources import corpus
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUICK = [
    "sentences", "first_last", "middle_part", "infill_prompt", "assemble_story", "simple_tokens", "ws_words", "word_symbols",
    "longest_story", "scan_jsonl", "subset", "shards", "epoch_shuffle", "batches", "infill_examples", "encdec_examples",
    "chunks", "topp", "topk_ties", "batch_loss_smoothed", "param_sweep",
]
NAMES = list(REGISTRY) if os.environ.get("STORYLOOM_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_every_query_has_sql():
    assert all(q.sql for q in REGISTRY.values())


def test_golden_counts(spark):
    docs = corpus.stories(spark, FOLDER)
    tokens = tx.simple_tokens(F.col("text"))
    vocab = vocabulary.build_vocabulary(docs, tokens)
    assert vocab.size == 19_014
    counts = vocabulary.token_counts(docs, tokens)
    assert counts.agg(F.sum("freq")).first()[0] == 81_395 and counts.filter("freq = 1").count() == 11_884
    tok = WordTokenizer(vocab)
    assert examples.infill_examples(docs, tok).count() == examples.encoder_decoder_examples(docs, tok).count() == 182
    framed = examples.framed_ids(docs, tok)
    assert examples.chunked(framed, 50, 15).count() == 695
    assert examples.chunked(framed, 50, 15, "uniform").count() == 2_309
    pairs = ngram.ngram_counts(framed)
    assert (pairs.count(), pairs.agg(F.sum("freq")).first()[0]) == (56_099, 81_595)


@pytest.mark.parametrize("name", ["infill_examples", "encode_ids", "batch_loss", "sample_next", "param_sweep", "shards", "padded_batches"])
def test_plans_hold_no_cross_join(spark, name):
    df = REGISTRY[name].run(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = REGISTRY["token_freq"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan or "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_examples_shuffle_only_texts(spark):
    """Beyond the one exchange by key, example building moves no rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = REGISTRY["infill_examples"].run(spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("doc_id" in line and "REPARTITION" in line for line in exchanges)
