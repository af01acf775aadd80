import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import examples, vocabulary as V
from storyloom.operators.tokenizers import WordTokenizer
from tests import plain

def tokens():
    return tx.simple_tokens(F.col("text"))


def pairs(df):
    return {r["doc_id"]: list(r["ids"]) for r in df.collect()}


def texts(docs):
    return [r["text"] for r in docs.orderBy("doc_id").collect()]


def test_order_and_ties(docs):
    vocab = V.build_vocabulary(docs, tokens())
    assert {r["token"]: r["id"] for r in vocab.df.collect()} == plain.vocabulary(texts(docs))
    assert vocab.size == vocab.df.count() == vocab.blank_id


def test_cutoff_and_minimum(docs):
    vocab = V.build_vocabulary(docs, tokens(), max_size=3)
    assert vocab.df.count() == vocab.size == 7
    learned = vocab.df.filter("id > 3").orderBy("id").collect()
    assert [r["token"] for r in learned] == list(plain.vocabulary(texts(docs)))[4:7]
    frequent = V.build_vocabulary(docs, tokens(), min_freq=3)
    assert frequent.df.filter("id > 3 AND freq < 3").count() == 0 and frequent.size > 4


@pytest.mark.parametrize("limit", [None, 0])
def test_encode_and_decode(spark, docs, limit, monkeypatch):
    """The same ids whether the vocabulary is broadcast or split into head and salted rest."""
    monkeypatch.setattr(V, "HEAD_IDS", 6)
    train = docs.filter("doc_id < 5")
    vocab = V.build_vocabulary(train, tokens())
    table = plain.vocabulary(texts(train))
    assert pairs(V.encode_tokens(docs, tokens(), vocab, limit=limit)) == {
        r["doc_id"]: plain.encode(r["text"], table) for r in docs.collect()
    }
    tok = WordTokenizer(vocab, limit=limit)
    framed = examples.framed_ids(train, tok)
    back = {r["doc_id"]: r["text"] for r in tok.decode(framed, F.col("ids")).collect()}
    assert back == {r["doc_id"]: " ".join(plain.tokens(r["text"])) for r in train.collect()}


@pytest.mark.parametrize("limit", [None, 0])
def test_columns_encoded_together(docs, limit):
    vocab = V.build_vocabulary(docs, tokens())
    out = V.encode_columns(docs, {"a": tokens(), "b": F.slice(tokens(), 1, 2), "c": F.array().cast("array<string>")}, vocab, limit=limit)
    table = plain.vocabulary(texts(docs))
    for r in out.join(docs, "doc_id").collect():
        ids = plain.encode(r["text"], table)
        assert (r["a"], r["b"], r["c"]) == (ids, ids[:2], [])


def test_extension_skips_known(docs):
    vocab = V.build_vocabulary(docs, tokens())
    grown = V.extend_vocabulary(vocab, ["<blank>", "<eos>", "<blank>", "<x>"])
    added = {r["token"]: r["id"] for r in grown.df.filter(F.col("id") >= vocab.size).collect()}
    assert added == {"<blank>": vocab.size, "<x>": vocab.size + 1}
    assert V.extend_vocabulary(grown, ["<blank>"]) is grown and grown.size == grown.df.count() == vocab.size + 2


def test_special_tokens_in_a_text_have_one_id(spark):
    docs = spark.createDataFrame([(1, "a <pad> b <unk> a")], "doc_id bigint, text string")
    words = F.split("text", " ")
    vocab = V.build_vocabulary(docs, words)
    assert vocab.size == vocab.df.count() == vocab.df.select("token").distinct().count() == 6
    assert V.encode_tokens(docs, words, vocab).first()["ids"] == [4, 0, 5, 1, 4]


def test_vocabulary_size_is_a_parameter_only(docs):
    whole = V.build_vocabulary(docs, tokens())
    cut = V.build_vocabulary(docs, tokens(), max_size=2)
    assert cut.size == cut.df.count() == 6 and whole.size == whole.df.count() > 6


def test_padding_falls_back_to_the_end(docs):
    vocab = V.build_vocabulary(docs, tokens())
    bare = V.Vocabulary(V.StoredTable(vocab.df.filter("token <> '<pad>'"), "", vocab.size - 1, 0), vocab.size - 1)
    assert (V.pad_id(vocab), V.pad_id(bare)) == (0, 3)


def test_unknown_tokens(docs):
    vocab = V.build_vocabulary(docs.filter("doc_id = 1"), tokens())
    found = {r["token"]: r["freq"] for r in V.unknown_tokens(docs.filter("doc_id = 5"), tokens(), vocab).collect()}
    assert found == {"zebra": 1, "end": 1}


def test_infill_examples(docs):
    vocab = V.build_vocabulary(docs, tokens())
    table = plain.vocabulary(texts(docs))
    rows = {r["doc_id"]: r for r in examples.infill_examples(docs, WordTokenizer(vocab), max_length=6, min_length=5).collect()}
    expected = {}
    for r in docs.collect():
        s = plain.sentences(r["text"])
        if len(s) < 3:
            continue
        prompt = (plain.encode(s[0], table) + [vocab.blank_id] + plain.encode(s[-1], table))[:6]
        target = plain.encode(r["text"], table)[:6]
        if len(prompt) >= 5 and len(target) >= 5:
            expected[r["doc_id"]] = (prompt, target, s[0], s[-1])
    assert {k: (r["input_ids"], r["target_ids"], r["first_sentence"], r["last_sentence"]) for k, r in rows.items()} == expected


def test_encoder_decoder_examples(docs):
    vocab = V.build_vocabulary(docs, tokens())
    table = plain.vocabulary(texts(docs))
    rows = examples.encoder_decoder_examples(docs, WordTokenizer(vocab), min_length=3).collect()
    assert rows
    for r in rows:
        middle = plain.encode(" ".join(plain.sentences(r["full_story"])[1:-1]), table)
        assert r["decoder_target_ids"] == middle and r["decoder_input_ids"] == [2, *middle[:-1]]


@pytest.mark.parametrize("heads", [0, 6, 100])
def test_large_vocabulary_moves_rare_tokens_only(spark, docs, heads, monkeypatch):
    """Past the broadcast limit the frequent tokens are gathered where they lie, and lists are the same, also of repeated and null keys."""
    more = spark.createDataFrame([(1, "zebra cat the"), (None, "the end zzz"), (9, None), (10, "")], "doc_id bigint, text string")
    rows = docs.unionByName(more)
    vocab = V.build_vocabulary(docs, tokens())
    columns = {"a": tokens(), "b": F.slice(tokens(), 1, 2), "c": F.array().cast("array<string>")}
    ids = V.encode_columns(rows, columns, vocab)
    told = V.decode_ids(ids, F.concat("a", F.array(F.lit(999).cast("bigint"), F.lit(None).cast("bigint"))), vocab)
    listed = lambda df: sorted(map(tuple, df.collect()), key=str)
    want, words = listed(ids), listed(told)
    monkeypatch.setattr(V, "HEAD_IDS", heads)
    far = V.encode_columns(rows, columns, vocab, limit=0)
    assert listed(far) == want
    assert listed(V.decode_ids(ids, F.concat("a", F.array(F.lit(999).cast("bigint"), F.lit(None).cast("bigint"))), vocab, limit=0)) == words
    # One row for a key, and one for each token the head lacks, meet the rest.
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan.split("Join LeftOuter")[1]
