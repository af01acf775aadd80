import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from tests import plain


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A b. C d", ["A b.", "C d."]),
        ("A.\nB.\n\nC.", ["A.", "B.", "C."]),
        (". . .", []),
        ("Hi! Bye.", ["Hi! Bye."]),
        ("Cost 3.5 now.", ["Cost 3.", "5 now."]),
        (" A　.\x1cB\x85", ["A.", "B."]),
        ("", []),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, text, tx.sentences) == expected == plain.sentences(text)


def test_first_and_last_need_two_sentences(spark):
    assert one(spark, "A. B. C.", lambda c: tx.first_of(tx.sentences(c))) == "A."
    assert one(spark, "A. B. C.", lambda c: tx.last_of(tx.sentences(c))) == "C."
    for text in ("Only one.", ". . ."):
        assert one(spark, text, lambda c: tx.first_of(tx.sentences(c))) is None
        assert one(spark, text, lambda c: tx.last_of(tx.sentences(c))) is None


def test_middle(spark):
    assert one(spark, "A. B. C. D.", lambda c: tx.middle_of(tx.sentences(c))) == "B. C."
    assert one(spark, "A. B.", lambda c: tx.middle_of(tx.sentences(c))) is None


def test_prompt_and_story(spark):
    assert one(spark, "A.", lambda c: tx.infill_prompt(c, F.lit("B."))) == "A. <blank> B."
    assert one(spark, "A.", lambda c: tx.assemble_story(c, F.lit(""), F.lit("B."))) == "A. B."
    assert one(spark, "A.", lambda c: tx.assemble_story(c, F.lit("x <blank>y"), F.lit("B."))) == "A. x y B."
    assert one(spark, "A.", lambda c: tx.assemble_story(c, F.lit(None).cast("string"), F.lit("B."))) == "A. B."
    # Four blanks become two: the replacement is done once and does not overlap.
    assert one(spark, "A", lambda c: tx.assemble_story(c, F.lit("  "), F.lit("B"))) == "A  B"


def test_tokens(spark):
    assert one(spark, "über Café-2", tx.simple_tokens) == ["ber", "caf", "2"]
    assert one(spark, " a\tb\n\nc d ", tx.whitespace_words) == ["a", "b", "c", "d"]
    assert one(spark, "a  b ", tx.space_length) == 4
    assert one(spark, "né😀", tx.word_symbols) == ["n", "é", "😀", "</w>"]
    assert one(spark, "Hi you", lambda c: tx.framed(tx.simple_tokens(c))) == ["<bos>", "hi", "you", "<eos>"]
