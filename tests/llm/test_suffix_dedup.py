import hashlib
import random

import numpy as np
import pyarrow as pa

from storyloom.llm import catalog
from storyloom.llm import suffix_dedup as sd
from tests.llm.conftest import messy

W = 100


def plain(rows):
    """Byte for byte from the definition; rows in order of identifier, nulls last."""
    order = sorted({i for i, _ in rows}, key=lambda i: (i is None, i or 0))
    first, out = {}, []
    for n, i in enumerate(order):
        for text in (t for j, t in rows if j == i):
            raw = (text or "").encode()
            for p in range(len(raw) - W + 1):
                w = raw[p : p + W]
                first[w] = min(first.get(w, (n, p)), (n, p))
    for i, text in rows:
        raw, n = (text or "").encode(), order.index(i)
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - W + 1):
            if first[raw[p : p + W]] < (n, p):
                gone[p : p + W] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(int)) == 1))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append(repr((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def found(df):
    return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in df.collect())


def test_query_equals_brute_force(spark, corpus, texts):
    got = found(catalog.op13_suffix_dedup(spark, "/root/testdata/sf0.001"))
    assert got == plain(sorted(texts.items()))
    assert any("', 0, 0" not in r for r in got)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_copies_passages_periods_nulls_and_borders(spark):
    rng = random.Random(5)
    hot, other, half = words(rng, 60), words(rng, 400), "x" * 99
    rows = [(i, words(rng, rng.randint(0, 30)) + hot + words(rng, rng.randint(0, 30))) for i in range(60)]
    rows += [(100 + i, other) for i in range(20)] + [(130, other[:150]), (131, other[7:1000] + "!" + other[1000:]), (132, other[-101:])]
    rows += [(200, "ab" * 300), (201, "ba" * 50), (202, "x" * 5000), (203, half), (204, half + "x"), (205, half + "y"), (206, "é" * 49 + "ab"), (207, "é" * 50 + "ab")]
    rows += [(300, words(rng, 50) + other[300:500]), (301, ""), (302, None), (None, other[:400]), (None, words(rng, 20)), (None, hot)]
    rows += [(400, other[100:350]), (400, other[:300]), (401, "same " * 60), (401, "same " * 60)]
    assert found(sd.drop_repeated_bytes(messy(spark, rows).repartition(5))) == plain(rows)


def test_documents_longer_than_a_piece_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    rng = random.Random(9)
    long = words(rng, 900)
    texts = [long, words(rng, 300) + long[2000:4300] + words(rng, 10), long[500:]]
    parts = [p for t in texts for p in sd.pieces_of(pa.array([t]))]
    windows = sum(int(p.counts.sum()) for p in parts)
    assert windows == sum(len(t.encode()) - W + 1 for t in texts)
    for part in parts:
        at, anchor = part.anchors()
        assert ((anchor >= at) & (anchor <= at + W - sd.PART)).all()


def test_names_are_exact_where_hashes_meet(spark):
    """A Thue-Morse text and its complement meet under polynomial hashes; here they stay apart."""
    a = "a"
    while len(a) < 2048:
        a += a.translate({97: 98, 98: 97})
    rows = [(1, a), (2, a.translate({97: 98, 98: 97})), (3, "ab" * 20)]
    assert found(sd.drop_repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)


def test_text_identifiers_and_no_rows(spark):
    rng = random.Random(1)
    text = words(rng, 60)
    df = spark.createDataFrame([("b", text), ("a", "_" + text), ("c", None)], "name string, body string")
    got = {r.name: (r.n_removed, r.removed) for r in sd.drop_repeated_bytes(df, "name", "body").collect()}
    assert got["a"][0] == 0 and got["c"][0] == 0
    assert got["b"][0] == len(text.encode()) and [tuple(r) for r in got["b"][1]] == [(0, len(text.encode()))]
    assert sd.drop_repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert len(sd.drop_repeated_bytes(spark.createDataFrame([(1, "short")], "doc_id bigint, text string")).collect()) == 1
