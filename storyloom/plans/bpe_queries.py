"""Byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import bpe, examples
from storyloom.operators.tokenizers import BpeTokenizer
from storyloom.plans.registry import query
from storyloom.plans.sql import flat, sql, toks, words
from storyloom.scratch import store
from storyloom.sources import corpus

# Merges of the queries that SQL checks, which takes one pass over all words for each of them.
MERGES = 12

_WORDS = f"""SELECT word, count(*) AS freq, array_to_string([' ' || c || ' ' for c in regexp_extract_all(word, '(?s).')], '') || ' </w> ' AS w
    FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word"""


def _pairs(source: str) -> str:
    return f"""SELECT a AS lft, b AS rgt, sum(freq)::BIGINT AS freq FROM (SELECT freq, unnest(p[1:len(p) - 1]) AS a, unnest(p[2:]) AS b
        FROM (SELECT freq, string_split(w[2:length(w) - 1], '  ') AS p FROM {source})) GROUP BY a, b"""


def _training(merges: int) -> dict[str, str]:
    """One table of words and one best pair for each merge."""
    parts = {"w0": _WORDS}
    for i in range(1, merges + 1):
        parts[f"b{i}"] = f"SELECT * FROM ({_pairs(f'w{i - 1}')}) ORDER BY freq DESC, lft, rgt LIMIT 1"
        parts[f"w{i}"] = f"""SELECT word, w{i - 1}.freq, replace(w, ' ' || lft || '  ' || rgt || ' ', ' ' || lft || rgt || ' ') AS w
            FROM w{i - 1}, b{i}"""
    return parts


def _trained(merges: int, body: str) -> str:
    return sql(extra=_training(merges), body=body)


_ALL = " UNION ALL ".join(
    f"SELECT {i} AS rank, lft AS \"left\", rgt AS \"right\", lft || rgt AS merged, freq FROM b{i}" for i in range(1, MERGES + 1)
)


@query("word_freq", f"SELECT word, count(*) AS freq FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word")
def word_freq(spark, sf):
    return bpe.word_counts(corpus.stories(spark, sf))


@query("pair_stats", sql(extra={"w0": _WORDS}, body=f"SELECT lft AS \"left\", rgt AS \"right\", freq FROM ({_pairs('w0')})"))
def pair_stats(spark, sf):
    counts = bpe.word_counts(corpus.stories(spark, sf))
    return bpe.pair_counts(counts.withColumn("packed", bpe.symbol_string(F.col("word"))))


@query("merge_pair", sql(extra={"w0": _WORDS}, body="""SELECT word, freq, replace(w, ' t  h ', ' th ') AS packed FROM w0
    WHERE contains(w, ' t  h ')"""))
def merge_pair(spark, sf):
    counts = bpe.word_counts(corpus.stories(spark, sf)).withColumn("packed", bpe.symbol_string(F.col("word")))
    return bpe.merge_words(counts.filter(F.contains("packed", F.lit(bpe.pattern("t", "h")))), "t", "h")


@query("bpe_merges", _trained(MERGES, _ALL))
def bpe_merges(spark, sf):
    return bpe.train_bpe(corpus.stories(spark, sf), MERGES).merge_table(spark)


@query("bpe_vocab", _trained(MERGES, f"SELECT DISTINCT unnest(string_split(w[2:length(w) - 1], '  ')) AS symbol FROM w{MERGES}"))
def bpe_vocab(spark, sf):
    return bpe.train_bpe(corpus.stories(spark, sf), MERGES).symbols()


@query("bpe_merges_full")
def bpe_merges_full(spark, sf):
    """The whole list of merges. SQL would take one pass over all words for each; tests compare with a plain trainer."""
    return bpe.train_bpe(corpus.stories(spark, sf)).merge_table(spark)


@query("bpe_encode_full")
def bpe_encode_full(spark, sf):
    """Symbols of every text by all merges learned on the training split."""
    _, encoded = _encoded(spark, sf, bpe.DEFAULT_MERGES)
    return encoded.select("doc_id", F.size("symbols").cast("bigint").alias("n_symbols"), F.array_join("symbols", " ").alias("symbols"))


_ENCODED = f"""SELECT doc_id, string_agg(w[2:length(w) - 1], '  ' ORDER BY pos) AS joined FROM (SELECT doc_id, unnest(x) AS word,
    generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {words('text')} AS x FROM documents)) JOIN w{MERGES} USING (word) GROUP BY doc_id"""


def _encoded(spark, sf, merges=MERGES):
    docs = corpus.stories(spark, sf)
    merges = bpe.train_bpe(docs.filter("split = 'train'"), merges).merges
    return docs, bpe.encode_docs(docs, [(m[1], m[2]) for m in merges])


_TRAIN_ON_TRAIN = _training(MERGES)
_TRAIN_ON_TRAIN["w0"] = _WORDS.replace("count(*) AS freq", "sum(tr)::BIGINT AS freq").replace(
    "AS word FROM documents", "AS word, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS tr FROM documents"
)


@query("bpe_encode", sql("docs", extra={**_TRAIN_ON_TRAIN, "e": _ENCODED}, body="""SELECT doc_id, CASE WHEN joined IS NULL THEN 0 ELSE
    len(string_split(joined, '  ')) END::BIGINT AS n_symbols, coalesce(replace(joined, '  ', ' '), '') AS symbols FROM docs LEFT JOIN e USING (doc_id)"""))
def bpe_encode(spark, sf):
    _, encoded = _encoded(spark, sf)
    return encoded.select("doc_id", F.size("symbols").cast("bigint").alias("n_symbols"), F.array_join("symbols", " ").alias("symbols"))


@query("bpe_decode", f"SELECT doc_id, array_to_string({words('text')}, ' ') AS text FROM documents")
def bpe_decode(spark, sf):
    """Encoding and decoding gives the words back, one space apart."""
    _, encoded = _encoded(spark, sf)
    return encoded.select("doc_id", bpe.decode_symbols(F.col("symbols")).alias("text"))


@query("compare_bpe", sql(extra={**_TRAIN_ON_TRAIN, "e": _ENCODED}, body="""SELECT 'bpe' AS tokenizer,
    sum(len(string_split(joined, '  ')))::BIGINT AS total, max(len(string_split(joined, '  ')))::BIGINT AS longest FROM e"""))
def compare_bpe(spark, sf):
    _, encoded = _encoded(spark, sf)
    return encoded.agg(F.sum(F.size("symbols")).cast("bigint").alias("total"), F.max(F.size("symbols")).cast("bigint").alias("longest")).select(
        F.lit("bpe").alias("tokenizer"), "total", "longest"
    )


# Ids: every word of the texts and of the sentences cut from them is merged by the rules learned on train.
_PIECES = {
    "bp": f"SELECT doc_id, {words('text')} AS t, {words('first_sentence')} AS f, {words('last_sentence')} AS l, {words('middle_part')} AS m FROM seg",
    "bd": f"SELECT doc_id, {words('text')} AS t FROM docs",
}
_ID_TRAINING = _training(MERGES)
_ID_TRAINING["w0"] = """SELECT word, sum(tr)::BIGINT AS freq, array_to_string([' ' || c || ' ' for c in regexp_extract_all(word, '(?s).')], '') || ' </w> ' AS w
    FROM (SELECT unnest(t) AS word, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS tr FROM bd
    UNION ALL SELECT unnest(f || l || m), 0 FROM bp) GROUP BY word"""
_ID_VOCAB = {
    "bv": f"""SELECT token, (row_number() OVER (ORDER BY kind, place, token) + 3)::BIGINT AS id FROM (SELECT token, min(kind) AS kind, min(place) AS place FROM (
        SELECT 0 AS kind, 0 AS place, unnest(string_split(w[2:length(w) - 1], '  ')) AS token FROM w0 WHERE freq > 0
        UNION ALL SELECT 1, rank, merged FROM ({_ALL})) GROUP BY token)""",
    "bn": "SELECT count(*) + 4 AS v FROM bv",
    "syms": f"SELECT word, string_split(w[2:length(w) - 1], '  ') AS s FROM w{MERGES}",
    "wid": """SELECT word, list(coalesce(bv.id, 1) ORDER BY k) AS ids FROM (SELECT word, unnest(s) AS token, generate_subscripts(s, 1) AS k FROM syms)
        LEFT JOIN bv USING (token) GROUP BY word""",
}


def _bpe_ids(source: str, column: str) -> str:
    return f"""SELECT b.doc_id, coalesce(e.ids, []::BIGINT[])[1:512] AS ids FROM {source} b LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids
        FROM (SELECT doc_id, unnest({column}) AS word, generate_subscripts({column}, 1) AS pos FROM {source}) JOIN wid USING (word) GROUP BY doc_id) e
        ON e.doc_id = b.doc_id"""


_ID_PARTS = {**_PIECES, **_ID_TRAINING, **_ID_VOCAB}
_ID_SIDES = {f"i_{c}": _bpe_ids("bp", c) for c in "flmt"}
_ID_PROMPT = "(i_f.ids || [(SELECT v FROM bn)::BIGINT] || i_l.ids)[1:512]"


def _bpe_tokenizer(docs):
    return BpeTokenizer.train(docs.filter("split = 'train'"), MERGES)


def _flat_ids(column):
    return F.array_join(column.cast("array<string>"), " ")


@query("encode_ids_bpe", sql("docs", "seg", extra={**_ID_PARTS, "ib": _bpe_ids("bd", "t")}, body=f"SELECT doc_id, {flat('ids')} AS ids FROM ib"))
def encode_ids_bpe(spark, sf):
    docs = corpus.stories(spark, sf)
    ids = _bpe_tokenizer(docs).encode(examples.keyed(docs), {"ids": F.col("text")}, 512)
    return ids.select("doc_id", _flat_ids(F.col("ids")).alias("ids"))


@query("infill_examples_bpe", sql("docs", "seg", extra={**_ID_PARTS, **_ID_SIDES}, body=f"""SELECT doc_id, {flat(_ID_PROMPT)} AS input_ids, {flat('i_t.ids')} AS target_ids,
    first_sentence, last_sentence, text AS full_story FROM seg JOIN i_f USING (doc_id) JOIN i_l USING (doc_id) JOIN i_t USING (doc_id)
    WHERE len({_ID_PROMPT}) >= 5 AND len(i_t.ids) >= 5"""))
def infill_examples_bpe(spark, sf):
    docs = corpus.stories(spark, sf)
    built = examples.infill_examples(docs, _bpe_tokenizer(docs))
    return built.withColumn("input_ids", _flat_ids(F.col("input_ids"))).withColumn("target_ids", _flat_ids(F.col("target_ids")))


@query("encdec_examples_bpe", sql("docs", "seg", extra={**_ID_PARTS, **_ID_SIDES}, body=f"""SELECT doc_id, {flat(_ID_PROMPT)} AS encoder_input_ids,
    {flat('([2::BIGINT] || i_m.ids)[1:len(i_m.ids)]')} AS decoder_input_ids, {flat('i_m.ids')} AS decoder_target_ids,
    first_sentence, last_sentence, middle_part, text AS full_story FROM seg JOIN i_f USING (doc_id) JOIN i_l USING (doc_id) JOIN i_m USING (doc_id)
    WHERE len({_ID_PROMPT}) >= 5 AND len(i_m.ids) >= 5"""))
def encdec_examples_bpe(spark, sf):
    docs = corpus.stories(spark, sf)
    built = examples.encoder_decoder_examples(docs, _bpe_tokenizer(docs))
    for name in ("encoder_input_ids", "decoder_input_ids", "decoder_target_ids"):
        built = built.withColumn(name, _flat_ids(F.col(name)))
    return built


@query("compare_texts", sql("docs", extra={**_TRAIN_ON_TRAIN, "e": _ENCODED}, body=f"""SELECT doc_id, 'simple' AS tokenizer, len({toks('text')})::BIGINT AS n,
    array_to_string({toks('text')}, ' ') AS tokens FROM docs UNION ALL SELECT doc_id, 'whitespace', len({words('text')})::BIGINT, array_to_string({words('text')}, ' ') FROM docs
    UNION ALL SELECT doc_id, 'bpe', CASE WHEN joined IS NULL THEN 0 ELSE len(string_split(joined, '  ')) END::BIGINT, coalesce(replace(joined, '  ', ' '), '')
    FROM docs LEFT JOIN e USING (doc_id)"""))
def compare_texts(spark, sf):
    """One row for every text and tokenizer."""
    docs, encoded = _encoded(spark, sf)
    simple, spaced = tx.simple_tokens(F.col("text")), tx.whitespace_words(F.col("text"))
    row = lambda name, tokens: F.struct(F.lit(name).alias("tokenizer"), F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, " ").alias("tokens"))
    texts = docs.select("doc_id", F.inline(F.array(row("simple", simple), row("whitespace", spaced))))
    return texts.unionByName(encoded.select("doc_id", F.inline(F.array(row("bpe", F.col("symbols"))))))
