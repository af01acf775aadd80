import re
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storyloom.llm import catalog
from storyloom.llm import spelling_variants as sv
from storyloom.scratch import owner
from tests.llm.conftest import messy, same_as_sql


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts):
    near = {w: [u for u in counts if one_edit(w, u)] for w in counts}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-counts[u], u), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(repr((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None)) for w, n in counts.items())


def found(df):
    return sorted(repr((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def grouped(spark, counts):
    return found(sv.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint")))


def test_query_equals_sql(spark):
    assert same_as_sql(spark, catalog.REGISTRY["op12_spelling_variants"]) > 1000


def test_every_edit_at_every_place_chains_and_ties(spark):
    counts = {"kingdom": 1000, "kingdoms": 100, "kingdoom": 10, "kingom": 3, "xkingdom": 5, "kingdox": 100, "kingdoxx": 10, "kingdoxxx": 1, "ingdom": 1}
    counts |= {"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaaaa": 500, "baaaaaa": 3, "aaabaaa": 30, "éaaaaaa": 2, "Écoleécole": 2, "ecoleécole": 30, "éecoleécole": 1}
    counts |= {f"prefix{c}suffix": 2 + i for i, c in enumerate("abcdefghij")}
    assert grouped(spark, counts) == plain(counts)


def test_long_words_pass_levels_that_span_many_letters(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 20
    counts = {long: 100, long[:-1]: 5, long[1:]: 2, long[:300] + "Q" + long[300:]: 3, long[:40] + long[41:]: 7, long[:64] + "Z" + long[65:]: 9, long[:31] + "Y" + long[32:]: 1}
    counts |= {"a" * n: n for n in range(30, 70)} | {"q" * 5000: 2, "q" * 5001: 30}
    with owner(spark):
        assert grouped(spark, counts) == plain(counts)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text("abÿ", min_size=1, max_size=9), st.integers(1, 300), min_size=1, max_size=120))
def test_few_letters_collide_everywhere(spark, counts):
    with owner(spark):
        assert grouped(spark, counts) == plain(counts)


def test_runs_are_thinned_by_their_hash_and_nulls_are_not(spark):
    rows = [(i, "Straßenbahn, Naïveté×÷abc déjà-Vu2000000 short") for i in range(200)] + [(None, "Straßenbahn"), (5, None), (6, ""), (7, "q" * 200_000)]
    got = Counter(r.word for r in sv.thinned(sv.lowered_runs(messy(spark, rows))).collect())
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]{7,}", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert got == want
    counted = {r.word: r.n for r in sv.frequent_words(spark.createDataFrame(list(got.elements()), "string").toDF("word")).collect()}
    assert counted == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sv.spelling_groups(sv.frequent_words(sv.thinned(sv.lowered_runs(none)))).collect() == []
    assert grouped(spark, {"lonesome": 3}) == plain({"lonesome": 3})


def test_a_pair_is_walked_from_one_side(spark):
    """Of two words that differ by one letter and share the rest, only the smaller or the longer one is walked to the other."""
    words = [f"pre{c}fixsuffix" + end for c in "abcdefgh" for end in ("left", "lift", "lost")] + ["prefixsuffixleft"]
    table = spark.createDataFrame([(i, w, 2) for i, w in enumerate(words)], "_i bigint, word string, n bigint")
    walked = {(words[r._i], r._other) for r in sv.near_pairs(sv.build_trie(table)).collect()}
    walked = {(a, b) for a, b in walked if one_edit(a, b)}
    assert {frozenset(p) for p in walked} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(walked) < sum(one_edit(a, b) for a in words for b in words)
    assert all(len(a) >= len(b) for a, b in walked)
