import hashlib

from storyloom.llm import exact_dedup
from storyloom.llm.catalog import REGISTRY
from tests.llm.conftest import messy, same_as_sql


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_query_agrees_with_sql(spark):
    assert same_as_sql(spark, REGISTRY["op1_exact_dedup"]) == 200


def test_edges(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (None, "ab"), (5, "É"), (6, "é"), (7, "x" * 300_000), (7, "X" * 300_000), (None, "solo")]
    got = exact_dedup.exact_groups(messy(spark, rows)).collect()
    by = {(r.doc_id, r.text_sha256): r for r in got}
    sha = lambda t: hashlib.sha256(lowered(t).encode()).hexdigest()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 6
    assert by[1, sha("ab")].kept and by[2, sha("ab")].keep_id == 1 and by[None, sha("ab")].group_size == 3
    assert by[3, sha("")].kept and by[4, sha("")].keep_id == 3
    assert by[5, sha("É")].kept and by[6, sha("é")].kept
    assert [r.kept for r in got if r.doc_id == 7].count(True) == 1
    assert by[None, sha("solo")].kept and by[None, sha("solo")].keep_id is None
    largest = exact_dedup.exact_groups(messy(spark, rows), keep="largest").collect()
    assert {r.keep_id for r in largest if r.text_sha256 == sha("ab")} == {2}


def test_empty_table(spark):
    assert exact_dedup.exact_groups(messy(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(messy(spark, [])).count() == 0


def test_a_group_larger_than_a_partition(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, "Copy" if i % 3 else f"own text {i}") for i in range(3000)]
        df = messy(spark, rows)
        groups = exact_dedup.exact_groups(df, keep="largest")
        hot = groups.filter("group_size > 1").collect()
        assert len(hot) == 2000 and {(r.keep_id, r.group_size) for r in hot} == {(2999, 2000)} and sum(r.kept for r in hot) == 1
        assert groups.filter("kept").count() == 1001
        kept = exact_dedup.drop_exact_copies(df, keep="largest")
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted([2999, *range(0, 3000, 3)])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
