import hashlib
import random
import zlib

import numpy as np
import pytest

from storyloom.llm import piece_transducer
from storyloom.llm.catalog import REGISTRY, tokenizer_path
from tests.llm.conftest import FOLDER, messy

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


ODD = [
    "", " ", "  a  b\n c\t", "▁x ▁ y", "你好😀👍🏽 é", "\n\n a\n", " \n ", "a" * 500, "<s></s><unk><0x41>", "          lots     of   spaces   ",
    "\x00\x01ÿ", "don't   stop", "tab\tand\r\nreturn", "trailing \n", "½ ²³ ΣΑΣ", "http://a.b/c?d=e&f#g", "def f(x):\n    return x**2\n",
]


def test_query_agrees_with_the_library(spark, texts, library):
    rows = REGISTRY["op5_sentencepiece"].run(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id]), dtype="<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_and_random_texts(library):
    rng = random.Random(7)
    parts = ["a", "b", "▁", " ", "th", "the", "in", "g", "\n", "é", "1", "0", ".", " the", "ing", "😀", "()", "  ", "er", "Ġ", ";\n"]
    machine = piece_transducer.Transducer(tokenizer_path(MODEL))
    for text in ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]:
        ids = machine.encode(text)
        want = library.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text
        assert machine.decode(ids) == library.decode(want)


def test_small_caches(monkeypatch, texts, library):
    monkeypatch.setattr(piece_transducer, "REMEMBERED", 20)
    machine = piece_transducer.Transducer(tokenizer_path(MODEL))
    for key in sorted(texts)[:5]:
        assert np.frombuffer(machine.encode(texts[key]), dtype="<u4").tolist() == library.encode(texts[key])


def test_edges(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "word " * 40_000), (52, "x" * 100_000), (53, "same"), (53, "same"), (None, "no key")]
    df = messy(spark, rows)
    path = tokenizer_path(MODEL)
    encoded = piece_transducer.encode(df, path)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert all(got[k] == library.encode(t or "") for k, t in rows)
    back = {r.doc_id: r.text for r in piece_transducer.decode(encoded, path).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in rows if k != 3)
    assert piece_transducer.round_trips(messy(spark, []), path).count() == 0
