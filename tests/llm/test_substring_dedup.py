import hashlib
import random

import numpy as np

from storyloom.llm import substring_dedup
from storyloom.llm.catalog import REGISTRY
from tests.llm.conftest import messy, same_as_sql


def plain(rows):
    """Every window of every text in a dictionary."""
    least = {}
    split = [(t or "").encode().split() for _, t in rows]
    for (key, _), words in zip(rows, split):
        for p in range(len(words) - 49):
            window = tuple(words[p : p + 50])
            if key is not None:
                least[window] = min(key, least.get(window, key))
    out = []
    for (key, _), words in zip(rows, split):
        gone = set()
        for p in range(len(words) - 49):
            if key is not None and least[tuple(words[p : p + 50])] < key:
                gone |= set(range(p, p + 50))
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((str(key), len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(df):
    rows = df.collect()
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in rows)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows)


def corpus_rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(150))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(15) : 55 + rng.randrange(15)]
        rows.append((1000 - i, " ".join(words)))
    long = " ".join(word() for _ in range(30_000))
    rows += [(5, long), (2000, "intro " + long + " outro"), (7, "rep " * 120), (8, "rep " * 49), (9, "rep " * 50), (10, "rep " * 200)]
    exact = " ".join(word() for _ in range(80))
    rows += [(20, exact), (21, exact.replace(" ", "\n\t")), (22, exact.upper()), (23, exact), (23, exact), (None, exact), (24, exact + " more")]
    rows += [(30, exact[::-1]), (30, exact[::-1] + " other text of the same id"), (31, None), (32, ""), (33, " \t "), (34, "naïve  été")]
    return rows


def test_query_agrees_with_sql(spark):
    assert same_as_sql(spark, REGISTRY["op7_substring_dedup"]) == 200


def test_agrees_with_a_plain_version(spark):
    rows = corpus_rows()
    assert found(substring_dedup.drop_repeated_passages(messy(spark, rows))) == plain(rows)


def test_one_of_two_texts_of_an_identifier_loses_a_passage(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(0, passage)]
    for i in range(1, 21):
        own = " ".join(f"a{i}x{k}" for k in range(80))
        rows += [(i, " ".join(f"b{i}x{k}" for k in range(55))), (i, f"{own} {passage}")][:: 1 if i % 2 else -1]
    assert found(substring_dedup.drop_repeated_passages(messy(spark, rows))) == plain(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With 64 cells nearly every value passes the filter; the result is the same."""
    monkeypatch.setattr(substring_dedup, "FAN_IN", 2)
    rows = corpus_rows()[:45]
    assert found(substring_dedup.drop_repeated_passages(messy(spark, rows), cell_bits=6, block_bits=4)) == plain(rows)


def test_empty_table(spark):
    assert substring_dedup.drop_repeated_passages(messy(spark, [])).count() == 0


def test_window_minima_are_sliding_minima():
    rng = np.random.default_rng(1)
    hashed = rng.integers(0, 2**63, 300).astype(np.uint64)
    parts = substring_dedup.rolling(hashed, 25, substring_dedup.BASES[1])
    want = [parts[p : p + 26].min() for p in range(300 - 49)]
    assert (substring_dedup.window_minima(hashed) == np.array(want)).all()


def test_windows_of_like_words_stay(spark):
    """One word of the window is a Thue-Morse word in one text and its complement in the other."""
    from tests.llm.conftest import thue_morse

    words = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*words, thue_morse(1024)])), (2, " ".join([*words, thue_morse(1024, "ba")])), (3, " ".join([*words, thue_morse(1024)]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
