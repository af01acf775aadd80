"""Vocabularies, id lists, examples, chunks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import arrays, text as tx
from storyloom.operators import batching, examples, vocabulary
from storyloom.operators.tokenizers import WordTokenizer
from storyloom.plans.corpus_queries import train_vocabulary
from storyloom.plans.registry import query
from storyloom.plans.sql import flat, sql, toks, words
from storyloom.sources import corpus

L, OVERLAP, BATCH = 50, 15, 32


def joined(column):
    return F.array_join(column.cast("array<string>"), " ")


def tokenizer_for(docs):
    return WordTokenizer(train_vocabulary(docs))


def framed_sequences(docs, max_length=None):
    return examples.framed_ids(docs, tokenizer_for(docs), max_length)


@query("token_freq", sql("tok", body="SELECT token, count(*) AS freq FROM tok GROUP BY token"))
def token_freq(spark, sf):
    return vocabulary.token_counts(corpus.stories(spark, sf), tx.simple_tokens(F.col("text")))


@query("build_vocab", sql("vocab", body="SELECT token, id, freq::BIGINT AS freq FROM vocab"))
def build_vocab(spark, sf):
    return train_vocabulary(corpus.stories(spark, sf)).df


@query("vocab_topn", sql("learned", body="""SELECT token, (3 + row_number() OVER (ORDER BY freq DESC, place))::BIGINT AS id,
    freq FROM learned ORDER BY id LIMIT 1000"""))
def vocab_topn(spark, sf):
    train = corpus.stories(spark, sf).filter("split = 'train'")
    vocab = vocabulary.build_vocabulary(train, tx.simple_tokens(F.col("text")), max_size=1000)
    return vocab.df.filter(F.col("id") >= len(vocabulary.SPECIALS))


@query("vocab_size", sql("vocab", body="SELECT count(*) AS vocab_size FROM vocab"))
def vocab_size(spark, sf):
    return train_vocabulary(corpus.stories(spark, sf)).df.agg(F.count(F.lit(1)).alias("vocab_size"))


@query("extend_vocab", sql("vocab", "nv", body="""SELECT token, id, freq::BIGINT AS freq FROM vocab
    UNION ALL SELECT '<blank>', (SELECT v FROM nv), 0 UNION ALL SELECT '<sep>', (SELECT v FROM nv) + 1, 0"""))
def extend_vocab(spark, sf):
    vocab = train_vocabulary(corpus.stories(spark, sf))
    return vocabulary.extend_vocabulary(vocab, ["<blank>", "<bos>", "<eos>", "<pad>", "<sep>"]).df


@query("encode_ids", sql("enc", body=f"SELECT doc_id, len(ids)::BIGINT AS n_ids, {flat('ids')} AS ids FROM enc"))
def encode_ids(spark, sf):
    docs = corpus.stories(spark, sf)
    ids = vocabulary.encode_tokens(examples.keyed(docs), tx.simple_tokens(F.col("text")), train_vocabulary(docs))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), joined(F.col("ids")).alias("ids"))


@query("decode_ids", sql("tok", "vocab", "docs", body="""SELECT d.doc_id, coalesce(t.text, '') AS text FROM docs d LEFT JOIN (
    SELECT doc_id, string_agg(tok.token, ' ' ORDER BY pos) AS text FROM tok JOIN vocab USING (token) GROUP BY doc_id) t USING (doc_id)"""))
def decode_ids(spark, sf):
    docs = corpus.stories(spark, sf)
    tok = tokenizer_for(docs)
    return tok.decode(examples.framed_ids(docs, tok), F.col("ids"))


@query("oov_tokens", sql("tok", "vocab", body="""SELECT token, count(*) AS freq FROM tok WHERE split = 'validation'
    AND token NOT IN (SELECT token FROM vocab) GROUP BY token"""))
def oov_tokens(spark, sf):
    docs = corpus.stories(spark, sf)
    return vocabulary.unknown_tokens(
        docs.filter("split = 'validation'"), tx.simple_tokens(F.col("text")), train_vocabulary(docs)
    )


@query("oov_rate", sql("tok", "vocab", body="""SELECT count(*) AS tokens, (count(*) FILTER (token NOT IN (SELECT token FROM vocab)))
    AS unknown FROM tok WHERE split = 'validation'"""))
def oov_rate(spark, sf):
    docs = corpus.stories(spark, sf)
    held, tokens = docs.filter("split = 'validation'"), tx.simple_tokens(F.col("text"))
    counts = vocabulary.token_counts(held, tokens)
    known = train_vocabulary(docs).df.select("token", F.lit(True).alias("known"))
    return counts.join(known, "token", "left").agg(
        F.sum("freq").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("freq")).otherwise(0)).alias("unknown")
    )


@query("compare_tokenizers", f"""WITH n AS (SELECT len({toks('text')}) AS simple, len({words('text')}) AS whitespace FROM documents),
    u AS (SELECT 'simple' AS tokenizer, simple AS n FROM n UNION ALL SELECT 'whitespace', whitespace FROM n)
    SELECT tokenizer, sum(n)::BIGINT AS total, round(avg(n), 9) AS mean, max(n)::BIGINT AS longest FROM u GROUP BY tokenizer""")
def compare_tokenizers(spark, sf):
    docs = corpus.stories(spark, sf)
    sizes = F.array(
        F.struct(F.lit("simple").alias("tokenizer"), F.size(tx.simple_tokens(F.col("text"))).alias("n")),
        F.struct(F.lit("whitespace").alias("tokenizer"), F.size(tx.whitespace_words(F.col("text"))).alias("n")),
    )
    return docs.select(F.inline(sizes)).groupBy("tokenizer").agg(
        F.sum("n").cast("bigint").alias("total"),
        F.round(F.avg("n"), 9).alias("mean"),
        F.max("n").cast("bigint").alias("longest"),
    )


@query("truncate", sql("enc", body=f"SELECT doc_id, {flat('ids[1:128]')} AS ids FROM enc"))
def truncate(spark, sf):
    docs = corpus.stories(spark, sf)
    ids = tokenizer_for(docs).encode(examples.keyed(docs), {"ids": F.col("text")}, max_length=128)
    return ids.select("doc_id", joined(F.col("ids")).alias("ids"))


@query("simple_sequences", sql("seqs", body=f"SELECT doc_id, {flat('ids')} AS ids FROM seqs"))
def simple_sequences(spark, sf):
    seqs = framed_sequences(corpus.stories(spark, sf), L)
    return seqs.select("doc_id", joined(F.col("ids")).alias("ids"))


@query("next_token_pairs", sql("framed", body=f"""SELECT doc_id, {flat('ids[1:len(ids) - 1]')} AS input_ids,
    {flat('ids[2:]')} AS target_ids FROM framed"""))
def next_token_pairs(spark, sf):
    pairs = examples.next_token_pairs(framed_sequences(corpus.stories(spark, sf)))
    return pairs.select("doc_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("target_ids")).alias("target_ids"))


@query("padded_fixed", sql("enc", body="""SELECT doc_id, array_to_string((ids[1:512] || [3 for x in range(512 - len(ids[1:512]))])::VARCHAR[], ' ')
    AS input_ids, array_to_string((ids[1:512] || [3 for x in range(512 - len(ids[1:512]))])::VARCHAR[], ' ') AS labels FROM enc"""))
def padded_fixed(spark, sf):
    """Padded with ``<eos>`` to a fixed length; the labels are an unshifted copy."""
    docs = corpus.stories(spark, sf)
    ids = tokenizer_for(docs).encode(examples.keyed(docs), {"ids": F.col("text")}, max_length=512)
    padded = ids.select("doc_id", joined(arrays.pad_to(F.col("ids"), 512, vocabulary.EOS_ID)).alias("input_ids"))
    return padded.withColumn("labels", F.col("input_ids"))


@query("pad_value_mask", sql("enc", body="""SELECT doc_id, array_to_string([CASE WHEN x = 3 THEN 'true' ELSE 'false' END for x in
    (ids[1:512] || [3 for y in range(512 - len(ids[1:512]))])], ' ') AS mask FROM enc"""))
def pad_value_mask(spark, sf):
    docs = corpus.stories(spark, sf)
    ids = tokenizer_for(docs).encode(examples.keyed(docs), {"ids": F.col("text")}, max_length=512)
    padded = arrays.pad_to(F.col("ids"), 512, vocabulary.EOS_ID)
    return ids.select("doc_id", joined(arrays.value_mask(padded, vocabulary.EOS_ID)).alias("mask"))


@query("infill_examples", sql("seg", "prompts", "pt", body=f"""SELECT doc_id, {flat('p.ids')} AS input_ids, {flat('pt.ids[1:512]')} AS target_ids,
    first_sentence, last_sentence, text AS full_story FROM prompts p JOIN pt USING (doc_id) JOIN seg USING (doc_id)
    WHERE len(p.ids) >= 5 AND len(pt.ids) >= 5"""))
def infill_examples(spark, sf):
    docs = corpus.stories(spark, sf)
    built = examples.infill_examples(docs, tokenizer_for(docs))
    return built.withColumn("input_ids", joined(F.col("input_ids"))).withColumn("target_ids", joined(F.col("target_ids")))


@query("encdec_examples", sql("seg", "prompts", "pm", body=f"""SELECT doc_id, {flat('p.ids')} AS encoder_input_ids,
    {flat('([2::BIGINT] || pm.ids[1:512])[1:len(pm.ids[1:512])]')} AS decoder_input_ids, {flat('pm.ids[1:512]')} AS decoder_target_ids,
    first_sentence, last_sentence, middle_part, text AS full_story FROM prompts p JOIN pm USING (doc_id) JOIN seg USING (doc_id)
    WHERE len(p.ids) >= 5 AND len(pm.ids) >= 5"""))
def encdec_examples(spark, sf):
    docs = corpus.stories(spark, sf)
    built = examples.encoder_decoder_examples(docs, tokenizer_for(docs))
    for name in ("encoder_input_ids", "decoder_input_ids", "decoder_target_ids"):
        built = built.withColumn(name, joined(F.col(name)))
    return built


@query("decoder_shift", sql("enc", body=f"SELECT doc_id, {flat('[2::BIGINT] || ids[1:len(ids) - 1]')} AS decoder_input_ids FROM enc WHERE len(ids) > 0"))
def decoder_shift(spark, sf):
    docs = corpus.stories(spark, sf)
    ids = tokenizer_for(docs).encode(examples.keyed(docs), {"ids": F.col("text")}).filter(F.size("ids") > 0)
    return ids.select("doc_id", joined(arrays.decoder_shift(F.col("ids"), vocabulary.BOS_ID)).alias("decoder_input_ids"))


# The chunk rule followed step by step: each row is one window, the next start is start + end - overlap (or a fixed step).
def _chunk_sql(next_start: str) -> str:
    body = f"""WITH RECURSIVE walk(doc_id, n, chunk_no, st) AS (
      SELECT doc_id, len(ids)::BIGINT, 0::BIGINT, 0::BIGINT FROM framed
      UNION ALL SELECT doc_id, n, chunk_no + 1, {next_start} FROM walk
      WHERE n > {L} AND {next_start} < n AND least({next_start} + {L}, n) - ({next_start}) >= {L // 2})
    SELECT w.doc_id, chunk_no, st AS start, array_to_string((f.ids[st + 1:st + {L}])::VARCHAR[], ' ') AS ids
    FROM walk w JOIN framed f USING (doc_id)"""
    return sql("framed", body=body).replace("WITH docs", "WITH RECURSIVE docs", 1).replace(" WITH RECURSIVE walk", ", walk", 1)


@query("chunks", _chunk_sql(f"st + least(st + {L}, n) - {OVERLAP}"))
def chunks(spark, sf):
    pieces = examples.chunked(framed_sequences(corpus.stories(spark, sf)), L, OVERLAP)
    return pieces.withColumn("ids", joined(F.col("ids")))


@query("chunks_uniform", _chunk_sql(f"st + {L - OVERLAP}"))
def chunks_uniform(spark, sf):
    pieces = examples.chunked(framed_sequences(corpus.stories(spark, sf)), L, OVERLAP, "uniform")
    return pieces.withColumn("ids", joined(F.col("ids")))


def sequence_lengths(docs):
    """Lengths of framed sequences follow from the words alone; no vocabulary is needed to plan batches."""
    return docs.select("doc_id", (F.size(tx.simple_tokens(F.col("text"))) + 2).cast("bigint").alias("n"))


@query("batches", sql("framed", "numbered", body="""SELECT doc_id, batch_id, len(ids)::BIGINT AS n,
    (max(len(ids)) OVER (PARTITION BY batch_id))::BIGINT AS max_n FROM numbered JOIN framed USING (doc_id)"""))
def batches(spark, sf):
    lengths = sequence_lengths(corpus.stories(spark, sf))
    return batching.assign_batches(lengths, BATCH, ["n"], [F.col("doc_id")])


@query("padded_batches", sql("framed", "numbered", body="""SELECT doc_id, batch_id,
    array_to_string((a || [0 for x in range(m - len(a))])::VARCHAR[], ' ') AS input_ids,
    array_to_string((b || [0 for x in range(m - len(b))])::VARCHAR[], ' ') AS target_ids
    FROM (SELECT doc_id, batch_id, ids[1:len(ids) - 1] AS a, ids[2:] AS b, max(len(ids) - 1) OVER (PARTITION BY batch_id) AS m
    FROM numbered JOIN framed USING (doc_id))"""))
def padded_batches(spark, sf):
    docs = corpus.stories(spark, sf)
    pairs = examples.next_token_pairs(framed_sequences(docs))
    lengths = sequence_lengths(docs).withColumn("n", F.col("n") - 1)
    placed = batching.assign_batches(lengths, BATCH, ["n"], [F.col("doc_id")])
    padded = batching.pad_batches(pairs, placed, {"input_ids": "max_n", "target_ids": "max_n"})
    return padded.select("doc_id", "batch_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("target_ids")).alias("target_ids"))


_INFILL_BATCH = """SELECT doc_id, b.batch_id, a, t, max(len(a)) OVER (PARTITION BY b.batch_id) AS ma, max(len(t)) OVER (PARTITION BY b.batch_id) AS mt
    FROM (SELECT p.doc_id, p.ids AS a, pt.ids[1:512] AS t, ((row_number() OVER (ORDER BY p.doc_id) - 1) // 32)::BIGINT AS batch_id
    FROM prompts p JOIN pt USING (doc_id) WHERE len(p.ids) >= 5 AND len(pt.ids) >= 5) b"""


@query("padded_infill_batches", sql("prompts", "pt", extra={"b": _INFILL_BATCH}, body="""SELECT doc_id, batch_id,
    array_to_string((a || [0 for x in range(ma - len(a))])::VARCHAR[], ' ') AS input_ids,
    array_to_string((t || [0 for x in range(mt - len(t))])::VARCHAR[], ' ') AS target_ids FROM b"""))
def padded_infill_batches(spark, sf):
    padded = _padded_infill(spark, sf)
    return padded.select("doc_id", "batch_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("target_ids")).alias("target_ids"))


@query("padding_mask", sql("prompts", "pt", extra={"b": _INFILL_BATCH}, body="""SELECT doc_id, batch_id,
    array_to_string([1 for x in range(len(a))]::VARCHAR[] || [0 for x in range(ma - len(a))]::VARCHAR[], ' ') AS input_mask FROM b"""))
def padding_mask(spark, sf):
    return _padded_infill(spark, sf).select("doc_id", "batch_id", joined(F.col("input_ids_mask")).alias("input_mask"))


def _padded_infill(spark, sf):
    """Inputs and targets are padded to maxima of their own. Examples are stored once; batches are planned on keys."""
    from storyloom.scratch import store

    docs = corpus.stories(spark, sf)
    built = examples.infill_examples(docs, tokenizer_for(docs)).select("doc_id", "input_ids", "target_ids")
    built = store(built, "examples").df
    lengths = built.select("doc_id", F.size("input_ids").alias("n_in"), F.size("target_ids").alias("n_out"))
    placed = batching.assign_batches(lengths, BATCH, ["n_in", "n_out"], [F.col("doc_id")])
    return batching.pad_batches(built, placed, {"input_ids": "max_n_in", "target_ids": "max_n_out"})


@query("padding_efficiency", sql("framed", "numbered", body="""SELECT batch_id, sum(len(ids) - 1)::BIGINT AS real_cells,
    (count(*) * max(len(ids) - 1))::BIGINT AS padded_cells FROM numbered JOIN framed USING (doc_id) GROUP BY batch_id"""))
def padding_efficiency(spark, sf):
    lengths = sequence_lengths(corpus.stories(spark, sf)).withColumn("n", F.col("n") - 1)
    return batching.padding_efficiency(batching.assign_batches(lengths, BATCH, ["n"], [F.col("doc_id")]), "n")


@query("blank_position", sql("prompts", "nv", body="""SELECT doc_id, coalesce(list_position(ids, (SELECT v FROM nv)) - 1, len(ids) // 2)::BIGINT
    AS at, coalesce(list_position(ids, 99999999999) - 1, len(ids) // 2)::BIGINT AS missing_at FROM prompts"""))
def blank_position(spark, sf):
    docs = corpus.stories(spark, sf)
    tok = tokenizer_for(docs)
    built = prompt_ids(docs, tok)
    return built.select(
        "doc_id",
        arrays.blank_position(F.col("ids"), tok.vocab.blank_id).alias("at"),
        arrays.blank_position(F.col("ids"), 99999999999).alias("missing_at"),
    )


def prompt_ids(docs, tok, max_length=512):
    sides = tok.encode(examples.segmented(examples.keyed(docs)), {"first": F.col("first_sentence"), "last": F.col("last_sentence")}, max_length)
    blank = examples.blank_id_column(tok.vocab.blank_id)
    return sides.select("doc_id", arrays.truncate(F.concat("first", blank, "last"), max_length).alias("ids"))


@query("blank_advance", sql("prompts", "nv", body="""SELECT doc_id, array_to_string(((ids[1:bp] || [7::BIGINT, (SELECT v FROM nv)] ||
    ids[bp + 2:])[1:512])::VARCHAR[], ' ') AS ids FROM (SELECT doc_id, ids,
    coalesce(list_position(ids, (SELECT v FROM nv)) - 1, len(ids) // 2) AS bp FROM prompts)"""))
def blank_advance(spark, sf):
    docs = corpus.stories(spark, sf)
    tok = tokenizer_for(docs)
    ids, blank = F.col("ids"), tok.vocab.blank_id
    moved = arrays.blank_advance(ids, arrays.blank_position(ids, blank), F.lit(7), blank, 512)
    return prompt_ids(docs, tok).select("doc_id", joined(moved).alias("ids"))


@query("middle_ids", sql("mids", body=f"SELECT doc_id, {flat('middle')} AS middle FROM mids"))
def middle_ids(spark, sf):
    docs = corpus.stories(spark, sf)
    return examples.middle_truth(docs, tokenizer_for(docs)).select("doc_id", joined(F.col("middle")).alias("middle"))


@query("context_match", sql("mids", body="""SELECT doc_id, CASE WHEN len(c) = 0 THEN f
    ELSE coalesce(CASE WHEN hit + len(c) + 1 < len(truth) THEN hit + len(c) + 1 END, least(f, len(truth) - 1)) END::BIGINT AS at
    FROM (SELECT *, list_min([i for i in range(greatest(len(truth) - len(c), 0)) if truth[i + 1:i + len(c)] = c]) AS hit
    FROM (SELECT doc_id, truth, first[greatest(len(first) - 4, 1):] AS c, len(first) + 2 AS f FROM mids))"""))
def context_match(spark, sf):
    """Where the truth goes on after the last five ids of the first sentence, one step ahead."""
    docs = corpus.stories(spark, sf)
    truths = examples.middle_truth(docs, tokenizer_for(docs))
    n = F.size("first")
    width = F.least(F.lit(5), n)
    context = F.slice("first", n - width + 1, width)
    return truths.select("doc_id", arrays.context_match(context, F.col("truth"), F.lit(1), n + 2).alias("at"))


@query("cut_at_eos", sql("framed", body=f"SELECT doc_id, {flat('ids[2:len(ids) - 1]')} AS ids FROM framed"))
def cut_at_eos(spark, sf):
    """Two framed copies end to end, cut at the first ``<eos>``."""
    framed = framed_sequences(corpus.stories(spark, sf))
    twice = F.concat("ids", "ids")
    return framed.select("doc_id", joined(arrays.cut_at(twice, vocabulary.EOS_ID, vocabulary.BOS_ID)).alias("ids"))
