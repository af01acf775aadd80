import hashlib

from pyspark.sql import functions as F

from storyloom.llm import catalog
from storyloom.llm import merkle_manifest as mm
from tests.llm.conftest import same_as_sql

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root, and for each node its siblings level by level, written from the definition."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, at in enumerate(where):
            proofs[i] += runs[at // 16][: at % 16] + runs[at // 16][at % 16 + 1 :]
        nodes, where = [h("".join(r)) for r in runs], [at // 16 for at in where]
    return nodes[0], proofs


def plain(rows):
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r[0], r[2], r[3], r[4], r[1])))
        leaves = [plain_leaf(r[0], r[2], r[3], r[4], r[1]) for r in own]
        trees.append((own, leaves, *plain_tree(leaves)))
    if not trees:
        return []
    root, upper = plain_tree([t[2] for t in trees])
    return sorted(repr((r[0], leaf, sub, root, h("".join(p + up)))) for (own, leaves, sub, proofs), up in zip(trees, upper) for r, leaf, p in zip(own, leaves, proofs))


def found(df):
    return sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"])) for r in df.collect())


def test_query_equals_sql(spark, corpus):
    assert same_as_sql(spark, catalog.REGISTRY["op11_merkle_manifest"]) == corpus.count()


def test_appends_extend_the_witnesses_they_complete():
    grown = mm.Appender(2)
    nodes = [h(str(i)) for i in range(19)]
    made = [grown.append(n) for n in nodes]
    assert [len(w) for w in made] == [1] * 16 + [0] * 3
    root = grown.finish()
    assert root == plain_tree(nodes)[0]
    for node, witness in zip(nodes, made):
        assert mm.fold(node, [{"place": p, "siblings": s} for p, s in witness]) == root
    assert mm.fold(h("another"), [{"place": p, "siblings": s} for p, s in made[3]]) != root


def test_sources_of_any_length_nulls_and_repeats(spark):
    rows = [(i, f"Text {i}", "long", "en", i) for i in range(4200)] + [(i, "x", "one" + str(i), None, None) for i in range(40)]
    rows += [(1, "a", None, "en", 1), (1, "b", None, "en", 1), (1, "b", None, "en", 1), (None, None, None, None, None), (None, "", "", "", 0), (7, "é" * 9, "z", "fr", 9)]
    rows += [(i, "t" * 100_000, "mid", "en", 1) for i in range(17)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for name in ("_id", "leaf", "_tree", "_n", "root", "Witness"):
        df = df.withColumn(name, F.lit("other"))
    assert found(mm.audit(mm.manifest(df))) == plain(rows)


def test_tampering_shows_where_it_happened_only(spark):
    rows = [(i, "Abc" if i % 2 else "abc", "s", "en", 3) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mm.audit(mm.manifest(df, altered={"text": catalog._lower_ascii}, altered_where=F.col("doc_id") < 10)).collect()
    assert {r.doc_id for r in out if not r.verified} == {1, 3, 5, 7, 9}
    assert all(r.folded_root == r.root for r in out if r.verified)


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mm.audit(mm.manifest(none)).collect() == []
    one = mm.audit(mm.manifest(spark.createDataFrame([(3, "t", "s", "en", 1)], SCHEMA))).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root
    assert one.proof_sha256 == h("")


def test_other_identifiers(spark):
    df = spark.createDataFrame([("b", "t", "s", "en", 1), ("a", "u", "s", "en", 1)], SCHEMA.replace("doc_id bigint", "doc_id string"))
    out = {r.doc_id: r for r in mm.audit(mm.manifest(df)).collect()}
    assert out["a"].root == h(out["a"].leaf + out["b"].leaf)
