"""Lookups past the broadcast limit: the same rows, from one pass over the rows that ask."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import bpe, examples, ngram, vocabulary
from storyloom.operators.lookup import lookup_join
from storyloom.operators.tokenizers import WordTokenizer
from storyloom.scratch import store


@pytest.mark.parametrize("head", [None, "v < 5"])
def test_rows_are_the_same_either_way(spark, head):
    table = store(spark.range(50).select((F.col("id") * 2).alias("k"), F.col("id").alias("v"), F.lit("x").alias("w")), "t")
    rows = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id") % 120).alias("k"), F.col("id").alias("n"))
    known = sorted(map(tuple, lookup_join(rows, table, ["k"], ["n"]).select("k", "n", "v", "w").collect()), key=str)
    far = sorted(map(tuple, lookup_join(rows, table, ["k"], ["n"], F.expr(head) if head else None, limit=0).select("k", "n", "v", "w").collect()), key=str)
    assert far == known and len(far) == 300


def executed(df):
    """The plan that ran, without what adaptive execution planned at first."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_chained_lookups_read_their_rows_once(spark, docs, tmp_path):
    """No branch repeats the rows, so nothing rests on Spark finding equal exchanges."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        docs.select("doc_id", "text").write.parquet(f"{tmp_path}/asked")
        asked = spark.read.parquet(f"{tmp_path}/asked")
        tokens = tx.simple_tokens(F.col("text"))
        vocab = vocabulary.build_vocabulary(asked, tokens)
        ids = store(examples.framed_ids(asked, WordTokenizer(vocab)), "ids")
        model = ngram.train_ngram(ids.df, vocab.size)
        for df, path in (
            (ngram.document_losses(ids.df, model, limit=0), ids.path.rsplit("/", 1)[1]),
            (ngram.bigram_counts(asked, tokens, vocab, limit=0), "asked"),
            (vocabulary.encode_tokens(asked, tokens, vocab, limit=0), "asked"),
            (bpe.encode_docs(asked, [("t", "h")], limit=0), "asked"),
        ):
            plan = executed(df)
            assert sum(path in line for line in plan.splitlines() if "FileScan" in line) == 1
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
