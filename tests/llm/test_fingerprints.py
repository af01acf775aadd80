import hashlib

import pytest
from pyspark.sql import functions as F

from storyloom.llm import fingerprints
from storyloom.llm.catalog import REGISTRY
from tests.llm.conftest import FOLDER, messy


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def true_likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """Texts with their last third replaced, in order of descending identifier."""
    ordered = sorted(rows, key=lambda r: -r[0])
    for (key, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        yield key, text, text[: len(text) - third] + after[:third], after


@pytest.mark.parametrize("parts", ["1", "7"])
def test_query_agrees_with_a_plain_version(spark, texts, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in REGISTRY["op9_fingerprints"].run(spark, FOLDER).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(texts)
    off = []
    prints = {}
    for key, text, changed, after in edited(list(texts.items())):
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        off += [abs(r.near_edited - true_likeness(text, changed)), abs(r.near_next - true_likeness(text, after))]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2


def test_next_document_crosses_stretches(spark):
    rows = [(i * 7, f"text {i} of a number of documents here") for i in range(100)]
    want = {k: hashlib.sha256(c.encode()).hexdigest() for k, _, c, _ in edited(rows)}
    got = fingerprints.fingerprints(messy(spark, rows).repartition(9)).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "a\tb"), (6, "a b"), (7, long), (8, long), (9, "é😀ab"), (None, "no key"), (None, "no key"), (None, "z"), (9, "é😀ab"), (10, "b a")]
    got = fingerprints.fingerprints(messy(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "" and by[2].near_next == 1.0 and by[4].near_next == 0.0
    assert by[5].fingerprint == by[6].fingerprint != by[10].fingerprint and by[7].fingerprint == by[8].fingerprint
    assert by[8].near_next == 1.0 and len(by[7].fingerprint) == 256 and by[9].n_chars == 4
    assert by[10].edited_sha256 == hashlib.sha256("b é".encode()).hexdigest()
    assert sum(r.doc_id is None for r in got) == 3


def test_one_document_is_its_own_next(spark):
    r = fingerprints.fingerprints(messy(spark, [(5, "abcdef")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0
    assert fingerprints.fingerprints(messy(spark, [])).count() == 0


def test_chance_matches_are_taken_off(spark):
    rows = [(i, " ".join(f"{i}-{k}" for k in range(300))) for i in range(200)]
    got = fingerprints.fingerprints(messy(spark, rows)).agg(F.avg("near_next")).first()[0]
    assert got < 0.01


def test_empty_bins_are_filled_alike(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b c d e f",), (" ".join(map(str, range(40))),)], "t string")
    values = [r.s for r in fingerprints.with_signature(df, "t", "s").collect()]
    assert [len(v) for v in values] == [128] * 3 and len(set(values[0])) == 1 and len(set(values[1])) <= 2


def test_plan_has_no_python(spark, corpus):
    plan = fingerprints.fingerprints(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
