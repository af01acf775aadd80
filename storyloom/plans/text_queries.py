"""Segmentation and string operators."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import batched
from storyloom.plans.registry import query
from storyloom.plans.sql import sent, sql, toks, words
from storyloom.sources import corpus


def _text():
    return F.col("text")


@query("sentences", sql("cut", body="SELECT doc_id, len(s)::BIGINT AS n_sentences, array_to_string(s, '|') AS sentences FROM cut"))
def sentences(spark, sf):
    docs = corpus.stories(spark, sf).withColumn("s", tx.sentences(_text()))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query("first_last", sql("cut", body="""SELECT doc_id, CASE WHEN len(s) >= 2 THEN s[1] END AS first_sentence,
    CASE WHEN len(s) >= 2 THEN s[-1] END AS last_sentence FROM cut"""))
def first_last(spark, sf):
    docs = corpus.stories(spark, sf).withColumn("s", tx.sentences(_text()))
    return docs.select("doc_id", tx.first_of(F.col("s")).alias("first_sentence"), tx.last_of(F.col("s")).alias("last_sentence"))


@query("middle_part", sql("cut", body="""SELECT doc_id, CASE WHEN len(s) >= 3 THEN array_to_string(s[2:-2], ' ') END
    AS middle_part FROM cut"""))
def middle_part(spark, sf):
    docs = corpus.stories(spark, sf).withColumn("s", tx.sentences(_text()))
    return docs.select("doc_id", tx.middle_of(F.col("s")).alias("middle_part"))


@query("long_enough", sql("cut", body="SELECT doc_id, len(s)::BIGINT AS n_sentences FROM cut WHERE len(s) >= 3"))
def long_enough(spark, sf):
    docs = corpus.stories(spark, sf).select("doc_id", F.size(tx.sentences(_text())).cast("bigint").alias("n_sentences"))
    return docs.filter("n_sentences >= 3")


@query("infill_prompt", sql("seg", body="SELECT doc_id, first_sentence || ' <blank> ' || last_sentence AS prompt FROM seg"))
def infill_prompt(spark, sf):
    from storyloom.operators.examples import segmented

    return segmented(corpus.stories(spark, sf)).select(
        "doc_id", tx.infill_prompt(F.col("first_sentence"), F.col("last_sentence")).alias("prompt")
    )


@query("assemble_story", sql("cut", body="""SELECT doc_id, replace(replace(CASE WHEN len(s) >= 3
    THEN s[1] || ' ' || array_to_string(s[2:-2], ' ') || ' ' || s[-1] ELSE s[1] || ' ' || s[-1] END,
    '<blank>', ''), '  ', ' ') AS story FROM cut WHERE len(s) >= 2"""))
def assemble_story(spark, sf):
    s = F.col("s")
    docs = corpus.stories(spark, sf).withColumn("s", tx.sentences(_text())).filter(F.size("s") >= 2)
    return docs.select("doc_id", tx.assemble_story(tx.first_of(s), tx.middle_of(s), tx.last_of(s)).alias("story"))


@query("simple_tokens", f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, array_to_string({toks('text')}, ' ') AS tokens FROM documents")
def simple_tokens(spark, sf):
    docs = corpus.stories(spark, sf).withColumn("t", tx.simple_tokens(_text()))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("ws_words", f"SELECT doc_id, len({words('text')})::BIGINT AS n_words, array_to_string({words('text')}, ' ') AS words FROM documents")
def ws_words(spark, sf):
    docs = corpus.stories(spark, sf).withColumn("w", tx.whitespace_words(_text()))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", " ").alias("words"))


@query("space_len", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n_parts FROM documents")
def space_len(spark, sf):
    return corpus.stories(spark, sf).select("doc_id", tx.space_length(_text()).alias("n_parts"))


@query("word_symbols", f"""SELECT word, array_to_string(regexp_extract_all(word, '(?s).') || ['</w>'], ' ') AS symbols
    FROM (SELECT DISTINCT unnest({words('text')}) AS word FROM documents)""")
def word_symbols(spark, sf):
    found = corpus.stories(spark, sf).select(F.explode(tx.whitespace_words(_text())).alias("word")).distinct()
    return found.select("word", F.array_join(tx.word_symbols(F.col("word")), " ").alias("symbols"))


@query("framed_tokens", f"SELECT doc_id, array_to_string(['<bos>'] || {toks('text')} || ['<eos>'], ' ') AS tokens FROM documents")
def framed_tokens(spark, sf):
    framed = tx.framed(tx.simple_tokens(_text()))
    return corpus.stories(spark, sf).select("doc_id", F.array_join(framed, " ").alias("tokens"))


@query("longest_story", sql("docs", body="""SELECT doc_id, split, text, len(string_split(text, ' '))::BIGINT AS n_parts FROM docs
    ORDER BY n_parts DESC, split, doc_id LIMIT 1"""))
def longest_story(spark, sf):
    """Train stands before validation, and the earliest of equals wins. Keys and lengths are ordered first; only the
    winner's text is read."""
    docs = corpus.stories(spark, sf)
    sized = docs.select("doc_id", "split", tx.space_length(_text()).alias("n_parts"))
    top = sized.orderBy(F.desc("n_parts"), "split", "doc_id").limit(1)
    return docs.select("doc_id", "text").join(F.broadcast(top), "doc_id").select("doc_id", "split", "text", "n_parts")


@query("batched_map", f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens FROM documents")
def batched_map(spark, sf):
    """A vectorized user function over Arrow batches that replaces the text by its token count."""

    def count(batch):
        return {"n_tokens": pc.cast(pc.count_substring_regex(pc.utf8_lower(batch.column("text")), "[a-z0-9]+"), "int64")}

    docs = corpus.stories(spark, sf).select("doc_id", "text")
    return batched.batched_map(docs, count, "n_tokens bigint", drop=["text"])
