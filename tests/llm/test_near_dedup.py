import random

import numpy as np
import pyarrow as pa

from storyloom.llm import near_dedup
from storyloom.llm.catalog import REGISTRY
from storyloom.llm.components import components
from tests.llm.conftest import messy, same_as_sql


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Components by comparing all pairs."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted((str(k), len(sets[i]), str(least.get(top(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_query_agrees_with_sql(spark):
    assert same_as_sql(spark, REGISTRY["op10_near_dedup"]) == 200


def variants(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    made = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        made.append(" ".join(copy))
    return made


def test_groups_of_copies_agree_with_brute_force(spark, monkeypatch):
    """Similarities around the threshold, with blocks so small that buckets span several."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    texts = variants(1, 60, 80, 6) + variants(2, 30, 200, 12) + variants(3, 10, 40, 1) + [f"own words number {i} here today" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert found(near_dedup.near_components(messy(spark, rows))) == brute(rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three four"), (7, long), (8, long + " end"),
        (9, "a b c d e"), (None, "a b c d e"), (10, "a b c d e"), (10, "a b c d e"), (None, "lonely null words here now"), (11, "two one"),
        (12, "É b c d e"), (13, "é b c d e"), (14, "a b c d e f"),
    ]
    assert found(near_dedup.near_components(messy(spark, rows))) == brute(rows)
    kept = {(r.doc_id, r.n_shingles): r.kept for r in near_dedup.near_components(messy(spark, rows)).collect()}
    assert kept[1, 0] and kept[4, 1] and not kept[5, 1] and kept[9, 1]


def test_empty_table(spark):
    assert near_dedup.near_components(messy(spark, [])).count() == 0


def test_registers_estimate_and_merge():
    words = lambda low, high: pa.array([" ".join(f"t{i}" for i in range(low, high))])
    a, b = (next(near_dedup.shingle_sets(words(*r))) for r in ((0, 1000), (150, 1150)))
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (np.maximum(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    assert abs((ra == rb).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
    n = np.array([float(len(a))])
    far = near_dedup.registers(next(near_dedup.shingle_sets(words(5000, 6000))))
    assert near_dedup.plausible(ra[None], rb[None], n, n, 0.75)[0] and not near_dedup.plausible(ra[None], far[None], n, n, 0.75)[0]
    assert not near_dedup.plausible(ra[None], ra[None], n, n / 2, 0.75)[0]


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(201)} == {got[0]} and {got[1000 + i] for i in range(300)} == {got[1000]} and got[0] != got[1000]


def test_intersections_are_those_of_the_sets(monkeypatch):
    monkeypatch.setattr(near_dedup, "_SHINGLES", 16)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 90)).astype(np.uint64)) for _ in range(40)]
    rows, columns = np.arange(0, 40, 2), np.arange(40)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in columns] for i in rows]
    assert near_dedup.intersections(sets, rows, columns).tolist() == want
    assert near_dedup.intersections([], np.arange(0), np.arange(0)).shape == (0, 0)


def test_words_of_like_structure_are_no_copies(spark):
    """A Thue-Morse word and its complement meet under polynomial hashes modulo a power of two."""
    from tests.llm.conftest import thue_morse

    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, "ba")), (3, "x " + thue_morse(2048)), (4, "x " + thue_morse(2048, "ba"))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_without_identifier_meet_their_own_text_only(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(base[:150] + [f"v{i}"])) for i in range(40)] + [(None, f"alone {i} " * 9) for i in range(300)] + [(5, " ".join(base[:150]))]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    assert sum(r.component_id == 5 for r in got) == 41


def test_bands_are_never_broadcast(spark, monkeypatch):
    """Spark takes the exploded bands for smaller than they are; sent to the driver they would fill it."""
    plans, kept = {}, near_dedup.store

    def seen(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag)

    monkeypatch.setattr(near_dedup, "store", seen)
    docs = spark.createDataFrame(list(enumerate(variants(5, 20, 40, 3))), "doc_id bigint, text string")
    assert near_dedup.near_components(docs).count() == 20
    assert "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]
