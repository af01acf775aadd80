from storyloom.llm import line_templates
from storyloom.llm.catalog import REGISTRY
from tests.llm.conftest import messy, same_as_sql

LARGER = "/root/testdata/sf0.01"


def kept(spark, rows, **options):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_templates.drop_recurring_lines(messy(spark, rows), **options).collect()}


def test_query_agrees_with_sql(spark):
    assert same_as_sql(spark, REGISTRY["op3_line_dedup"], LARGER) == 1000


def test_variable_fields_are_generalised(spark):
    names = "ann bob cid dan eve fay gus hal ida jon kim lou".split()
    rows = [
        (i, f"{n} wrote prose {n * 2} {n[::-1]}\nUser {i} logged in from {n} at home today\nCopyright {2000 + i} all rights reserved\n\nend {n}")
        for i, n in enumerate(names)
    ]
    got = kept(spark, rows, min_documents=5)
    assert all(got[i] == (5, 2, f"{n} wrote prose {n * 2} {n[::-1]}\n\nend {n}") for i, n in enumerate(names))
    # Too few documents for a template.
    assert all(g[1] == 0 for g in kept(spark, rows[:4], min_documents=5).values())


def test_lines_that_only_begin_alike_stay(spark):
    rows = [(i, "in the beginning there " + " ".join(f"w{chr(97 + i)}{k}x".replace(str(k), chr(97 + k)) for k in range(8))) for i in range(30)]
    assert all(g[1] == 0 for g in kept(spark, rows, min_documents=5).values())


def test_short_lines_that_only_begin_alike_stay(spark):
    word = lambda i, k: "w" + "".join(chr(97 + (i // 26**j + k) % 26) for j in range(3))
    for n in (1, 2, 3):
        rows = [(i, "it was a " + " ".join(word(i, 5 * k) + "xyz"[k] for k in range(n))) for i in range(60)]
        assert all(g[1] == 0 for g in kept(spark, rows).values())
    # One field among as many words stays a template.
    assert all(g[1] == 1 for g in kept(spark, [(i, f"sent to you by {word(i, 0)} on 2024-01-{i}") for i in range(60)]).values())


def crowded(hot):
    """Twelve templates with two fields each in one leaf, whose fields also take frequent values, next to a hot line."""
    name = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3)) + "q"
    rows = [(i, f"a user session {'abcdefghijkl'[i % 12]}fixed from {name(i)} to {['home', 'work', name(7 * i)][i % 7 % 3]} was closed\nown {name(i)} text") for i in range(720)]
    rows += [(1000 + i, f"a user session which every page has here as well\nother {name(i)}") for i in range(hot)]
    # Fields that are frequent themselves, whose pairs are rare, and lines that only begin alike.
    rows += [(5000 + i, f"sent by you for {name(i % 10)} about {name(30 + i // 10)} and more today") for i in range(100)]
    return rows + [(6000 + i, f"it was a {name(i)} {name(3 * i)}x {name(5 * i)}y") for i in range(60)]


def test_many_templates_and_a_hot_line_in_one_leaf(spark):
    got = kept(spark, crowded(900))
    assert all(got[i][1] == 1 for i in [*range(720), *range(1000, 1900), *range(5000, 5100)])
    assert all(got[i][1] == 0 for i in range(6000, 6060))


def test_sql_holds_on_every_branch(spark, tmp_path):
    """Masked digits, copies, short lines, blank lines and crowded leaves."""
    rows = crowded(40) + [(7000 + i, f"in the year {i} all of {chr(97 + i % 26)}z was {i}\n\n \nend") for i in range(40)]
    rows += [(8000 + i, "a line of a much copied text\nwith more") for i in range(30)] + [(9000, None), (9001, ""), (9002, "\n")]
    rows += [(9100 + i, f"{i} x y\none\ntwo words") for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part-*")).rename(tmp_path / "documents.parquet")
    assert same_as_sql(spark, REGISTRY["op3_line_dedup"], str(tmp_path)) == len(rows)


def test_copies_count_once(spark):
    rows = [(i, "a line of a much copied text\nand another one of it") for i in range(50)] + [(99, "a line of a much copied text")]
    assert all(g[1] == 0 for g in kept(spark, rows, min_documents=3).values())


def test_edges(spark):
    long = "\n".join(f"line {chr(97 + k % 26)} word{'x' * (k % 50)} tail" for k in range(20_000))
    line = "All rights reserved here"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, line), (5, line + "\n"), (None, "x\n" + line), (6, line + "\r\ny"), (7, "z\n" + line + "\n" + line), (8, "é " + line)]
    rows += [(9, "y\n " + line + " \n")] * 2
    found = line_templates.drop_recurring_lines(messy(spark, rows), min_documents=4).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.n_lines): (r.n_dropped, r.kept) for r in found}
    assert by[1, 1] == by[2, 1] == (0, "") and by[3, 3] == (0, "\n\n")
    assert by[5, 1] == (1, "") and by[5, 2] == (1, "") and by[None, 2] == (1, "x") and by[6, 2] == (1, "y") and by[7, 3] == (2, "z")
    assert by[8, 1][0] == 0 and by[9, 3] == (1, "y\n") and by[4, 20_000][0] == 0
    assert line_templates.drop_recurring_lines(messy(spark, [])).count() == 0
