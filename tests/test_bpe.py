import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.operators import bpe
from tests import plain


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_overlapping_merge(spark):
    words = spark.createDataFrame([("aaa", 1), ("aaaa", 1)], "word string, freq bigint")
    packed = words.withColumn("packed", bpe.symbol_string(F.col("word")))
    out = {r["word"]: r["s"] for r in bpe.merge_words(packed, "a", "a").select("word", bpe.symbols_of(F.col("packed")).alias("s")).collect()}
    assert out == {"aaa": ["aa", "a", "</w>"], "aaaa": ["aa", "aa", "</w>"]}


def test_whole_symbols_only(spark):
    words = spark.createDataFrame([("abc", 1)], "word string, freq bigint").withColumn("packed", bpe.symbol_string(F.col("word")))
    joined = bpe.merge_words(bpe.merge_words(words, "a", "b"), "b", "c")
    assert joined.select(bpe.symbols_of(F.col("packed")).alias("s")).first()["s"] == ["ab", "c", "</w>"]


CORPORA = {
    "prose": ["the cat sat on the mat", "the other thing then", "a banana ana nana", "the mat that sat"],
    "one letter": ["aaaa aaa aa a aaaaaaa"],
    "marker in text": ["x</w> </w>x < /w > </w", "</w> a</w>"],
    "symbols met twice": ["the th he t he th e", "them then hem en"],
    "non-ascii": ["né né été 😀a 😀a"],
}


@pytest.mark.parametrize("name", list(CORPORA))
def test_training_follows_the_plain_rule(spark, name, monkeypatch):
    monkeypatch.setattr(bpe, "LEADING_PAIRS", 9)
    texts = CORPORA[name]
    learned, table = plain.train_bpe(texts, 15)
    model = bpe.train_bpe(frame(spark, texts), 15)
    assert [(m[1], m[2], m[4]) for m in model.merges] == learned
    got = {r["word"]: r["s"] for r in model.words.select("word", bpe.symbols_of(F.col("packed")).alias("s")).collect()}
    assert got == table
    assert {r["symbol"] for r in model.symbols().collect()} == {s for syms in table.values() for s in syms}


def test_training_on_random_words(spark):
    rng = random.Random(11)
    for letters in ("ab", "abcd"):
        texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(12)) for _ in range(4)]
        learned, _ = plain.train_bpe(texts, 12)
        assert [(m[1], m[2], m[4]) for m in bpe.train_bpe(frame(spark, texts), 12).merges] == learned


def read_off(texts, leading, limit):
    """Merges read off segments of the ``leading`` most frequent pairs in one round, without Spark."""
    words = Counter(w for t in texts for w in t.split())
    pairs = Counter()
    for w, n in words.items():
        for pair in zip(plain.letters(w), plain.letters(w)[1:]):
            pairs[pair] += n
    ranked = sorted(pairs, key=lambda p: (-pairs[p], p))
    chosen, outside = set(ranked[:leading]), pairs[ranked[leading]] if len(ranked) > leading else 0
    segments = Counter()
    for w, n in words.items():
        part = []
        for s in plain.letters(w):
            if part and (part[-1], s) not in chosen:
                segments[tuple(part)] += n
                part = []
            part.append(s)
        segments[tuple(part)] += n
    found = bpe.Segments([(list(s), n) for s, n in segments.items()], chosen, outside, set())
    out = []
    while len(out) < limit and (best := found.best()) and found.certain(*best):
        found.merge(*best[1:])
        out.append((best[1], best[2], best[0]))
    return out


def test_what_segments_tell_is_what_all_words_tell():
    """Merges that the bound lets pass are those of the whole table, also where a symbol is made in several ways."""
    rng, passed = random.Random(3), 0
    for turn in range(400):
        letters = "abc" if turn % 2 else "abcdef"
        texts = [" ".join("".join(rng.choices(letters, weights=range(1, len(letters) + 1), k=rng.randint(1, 9))) for _ in range(rng.randint(5, 60)))]
        learned, _ = plain.train_bpe(texts, 20)
        got = read_off(texts, rng.randint(1, 12), 20)
        assert got == learned[: len(got)]
        passed += len(got)
    assert passed > 800


def test_words_are_segmented_as_merges_in_order_do():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choices("aab", k=rng.randint(2, 8))) for _ in range(8)]
        rules = [(a, b) for a, b, _ in plain.train_bpe(texts, 12)[0]]
        rules += rng.sample(rules, min(2, len(rules)))
        word = plain.letters("".join(rng.choices("aabc", k=rng.randint(1, 30))))
        want = word
        for rule in rules:
            want = plain.merge(want, rule)
        assert bpe.segmented(word, bpe.rule_ranks(rules)) == want


@pytest.mark.parametrize("segments", [1200, 65_536])
def test_a_thousand_merges(spark, segments, monkeypatch):
    """The full length on stories of many words, in rounds of few segments and of many."""
    monkeypatch.setattr(bpe, "SEGMENTS", segments)
    rng = random.Random(21)
    parts = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(1, 4))) for _ in range(150)]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(40)) for _ in range(20)]
    learned, table = plain.train_bpe(texts, 1000)
    model = bpe.train_bpe(frame(spark, texts))
    assert len(learned) == 1000 and [(m[1], m[2], m[4]) for m in model.merges] == learned
    assert {r["word"]: r["s"] for r in model.words.select("word", bpe.symbols_of(F.col("packed")).alias("s")).collect()} == table


@pytest.mark.parametrize("limit", [None, 0])
def test_encode_and_decode(spark, limit, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD_WORDS", 3)
    texts = CORPORA["prose"]
    learned, _ = plain.train_bpe(texts, 8)
    merges = [(a, b) for a, b, _ in learned]
    fresh = ["the unseen  mats", "", "then\nthe"]
    out = {r["doc_id"]: r for r in bpe.encode_docs(frame(spark, fresh), merges, limit=limit).withColumn("text", bpe.decode_symbols(F.col("symbols"))).collect()}
    for i, text in enumerate(fresh):
        want = []
        for word in text.split():
            symbols = plain.letters(word)
            for m in merges:
                symbols = plain.merge(symbols, m)
            want += symbols
        assert out[i]["symbols"] == want and out[i]["text"] == " ".join(text.split())


def test_stops_when_no_pair_is_left(spark):
    model = bpe.train_bpe(frame(spark, ["ab"]), 50)
    assert [m[3] for m in model.merges] == ["ab", "ab</w>"] or len(model.merges) == 2


def test_a_word_that_spells_the_end_mark(spark):
    texts = ["a</w>b </w> x</w>", "a</w>b a</w>b </w>"]
    docs = frame(spark, texts)
    model = bpe.train_bpe(docs, 30)
    encoded = bpe.encode_docs(docs, [(m[1], m[2]) for m in model.merges])
    assert {r["t"] for r in encoded.select(bpe.decode_symbols(F.col("symbols")).alias("t")).collect()} == set(texts)


@pytest.mark.parametrize("limit", [None, 0])
def test_tokenizer_with_ids(spark, limit):
    from storyloom.operators.tokenizers import BpeTokenizer

    texts = ["the cat sat on the mat", "the other thing then", ""]
    docs = frame(spark, texts)
    trained = BpeTokenizer.train(docs, 8)
    tok = BpeTokenizer(trained.vocab, trained.merges, limit)
    table = {r["token"]: r["id"] for r in tok.vocab.df.collect()}
    assert len(table) == tok.vocab.size and sorted(table.values()) == list(range(tok.vocab.size))
    rows = {r["doc_id"]: r for r in tok.encode(docs, {"a": F.col("text"), "b": F.lit("the zebra")}).collect()}
    for i, text in enumerate(texts):
        symbols = []
        for word in text.split():
            parts = plain.letters(word)
            for m in tok.merges:
                parts = plain.merge(parts, m)
            symbols += parts
        assert rows[i]["a"] == [table[s] for s in symbols]
        assert 1 in rows[i]["b"]
    cut = tok.encode(docs, {"a": F.col("text")}, 4)
    assert all(len(r["a"]) <= 4 and r["a"] == rows[r["doc_id"]]["a"][:4] for r in cut.collect())
    back = tok.decode(tok.encode(docs, {"a": F.col("text")}), F.col("a"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("limit", [None, 0])
def test_encoding_shuffles_texts_only(spark, limit, tmp_path):
    """However large the table of words would be, nothing is joined, and no word is moved."""
    spark.createDataFrame([(i, f"the cat{i % 7} sat") for i in range(40)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    vocab = bpe.bpe_vocabulary(bpe.train_bpe(docs, 4))
    for df in (bpe.encode_docs(docs, [("t", "h")], limit=limit), bpe.encode_id_columns(docs, {"a": F.col("text")}, [("t", "h")], vocab, 3, limit=limit)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1 and df.count() == 40


def test_rows_of_one_key_are_encoded_together(spark):
    """Words stand by place, those of one place by their symbols; a null text has none."""
    rows = [(1, "b a"), (1, "a the"), (2, None), (None, "x"), (3, "a"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["symbols"] for r in bpe.encode_docs(docs, [("t", "h")]).collect()}
    end = "</w>"
    assert got == {1: ["a", end, "b", end, "a", end, "th", "e", end], 2: [], None: ["x", end], 3: ["a", end]}
    vocab = bpe.bpe_vocabulary(bpe.train_bpe(docs.filter("text IS NOT NULL"), 0))
    ids = {r["doc_id"]: r for r in bpe.encode_id_columns(docs, {"a": F.lit("a"), "b": F.col("text")}, [], vocab).collect()}
    assert ids[2]["a"] == ids[2]["b"] == [] and len(ids[1]["a"]) == 4 and len(ids[1]["b"]) == 10 and len(ids[3]["a"]) == 2
