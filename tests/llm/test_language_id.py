import zlib

import numpy as np

from storyloom.llm import language_id
from storyloom.llm.catalog import REGISTRY
from tests.llm.conftest import messy

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    got = REGISTRY["op8_language_id"].run(spark, LARGER).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) == 1000
    assert (got.held_out == got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= set(docs.lang.dropna()) | {"und"}
    judged = got[got.held_out & got.lang.notna() & got.text.str.contains(r"[^\W\d_]", regex=True)]
    assert len(judged) > 150 and (judged.lang_pred == judged.lang).mean() >= 0.97


def test_edges(spark, corpus):
    model = language_id.fit(corpus)
    rows = [(1, None), (2, ""), (3, "123 !!! \n"), (None, "the of and thing"), (4, "le des treaux éèle"), (4, "x" * 400_000), (5, "ÉÈ"), (6, "你好"), (7, "ª")]
    got = language_id.predict(messy(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (None, 4, 5, 6, 7))
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert language_id.identified(messy(spark, rows), model, 0.0).count() == 6


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model is None
    assert [(r.lang_pred, r.score) for r in language_id.predict(df, model).collect()] == [("und", 0.0)] * 2
    empty = messy(spark, [], "doc_id long, text string, lang string")
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lang in range(70):
        words = ["".join(chr(0x4E00 + 40 * lang + k) for k in rng.integers(0, 40, 3)) for _ in range(30)]
        rows += [(100 * lang + k, " ".join(rng.choice(words, 40)), f"l{lang:02}") for k in range(20 + lang % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 70
    named = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert all(named[k] == lang for k, _, lang in rows)


def test_presence_counts_whole_texts_once():
    short, long = language_id.presence("abc"), language_id.presence("abc " * 5000)
    assert len(short) == len(language_id.presence("ABC!")) and set(short) <= set(long) and len(long) < 2 * len(short)
    # One letter makes itself, the blank, two pairs and one triple.
    assert len(language_id.presence("a")) == 5 and language_id.presence("1 2") is None


def test_matrix_products_equal_the_kernel():
    texts = ["the cat", "the dog", "le chat", "le chien"]
    found = [language_id.presence(t) for t in texts]
    model = language_id.fit_model(found, ["en", "en", "fr", "fr"])
    plain = language_id.Model(model.languages, model.columns, model.landmarks, np.eye(4, dtype=np.float32))
    both = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    assert np.allclose(plain.scores(found), [[both(a, b) for b in found] for a in found], atol=1e-6)
    assert [model.languages[i] for i in model.scores(found).argmax(axis=1)] == ["en", "en", "fr", "fr"]
