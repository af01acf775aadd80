import zlib

import numpy as np
import pytest

from storyloom.llm import packing
from storyloom.llm.catalog import REGISTRY, tokenizer_path
from tests.llm.conftest import FOLDER, messy


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def pieces_of(tokenizer, key, text, capacity):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    for n, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start : start + capacity]
        yield key, n, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())


def check(rows, want, capacity):
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((str(w[0]), *w[1:]) for w in want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(bins), -(-total // capacity)


def test_query_packs_every_document_tightly(spark, texts, tokenizer):
    want = [p for k, t in texts.items() for p in pieces_of(tokenizer, k, t, 4096)]
    used, least = check(REGISTRY["op2_packing"].run(spark, FOLDER).collect(), want, 4096)
    assert used <= least + 1


def test_edges(spark, tokenizer):
    odd = [
        "It's 42nd—don't <|endoftext|>x <|startoftext|>", "ΣΑΣ İstanbul ﬁ ½ ²³ ª", "a b c\x1cd\x85e", "café café ÀÉ", "你好 😀👍🏽",
        "</w> a</w>b <w>", " \t\n", "don't'll 'S 'RE", "___--- ...", "﻿bom \x00nul", "soft­hyphen",
    ]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50, None), (51, ""), (52, "word " * 9000), (53, "x" * 50_000), (54, "same"), (54, "same"), (None, "null id")]
    want = [p for k, t in rows for p in pieces_of(tokenizer, k, t, 512)]
    got = packing.pack_documents(messy(spark, rows), tokenizer_path(), 512, with_ids=True).collect()
    check(got, want, 512)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_empty_table(spark):
    assert packing.pack_documents(messy(spark, []), tokenizer_path()).count() == 0


def test_rounds_over_many_nodes(spark, monkeypatch):
    """Partitions too small to pack well alone still meet in later rounds; nothing is lost when no bins can be joined."""
    monkeypatch.setattr(packing, "NODE_ITEMS", 20)
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 900, 400).tolist()
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    want = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    used, least = check(packing.pack(df, 1000).collect(), want, 1000)
    alone = len(packing.best_fit(np.array(lengths), 1000)[2])
    assert used <= 1.12 * alone and alone <= 1.03 * least
    stuck = spark.createDataFrame([(i, 0, 0, 700, 0) for i in range(300)], df.schema)
    assert check(packing.pack(stuck, 1000).collect(), [(i, 0, 0, 700, 0) for i in range(300)], 1000)[0] == 300
    halves = spark.createDataFrame([(i, 0, 0, 700 if i % 2 else 300, 0) for i in range(300)], df.schema)
    assert check(packing.pack(halves, 1000).collect(), [(i, 0, 0, 700 if i % 2 else 300, 0) for i in range(300)], 1000)[0] <= 165


def test_word_cache_can_be_cleared(monkeypatch, texts, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    enc = packing.WordEncoder(tokenizer_path())
    for k in sorted(texts)[:20]:
        assert enc.encode([texts[k]])[0] == np.array(tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
