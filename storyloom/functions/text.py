"""String expressions for cutting and tokenising stories. All take and return Columns, so they work on
batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a plain text strip or whitespace split treats as blank.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a regular-expression class.
BLANK_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The marker strings.
BLANK_MARK = "<blank>"
PAD, UNK, BOS, EOS = "<pad>", "<unk>", "<bos>", "<eos>"
WORD_END = "</w>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def sentences(text: Column) -> Column:
    """Pieces between full stops, stripped, blanks dropped, each closed with a full stop again."""
    pieces = F.transform(F.split(text, r"\.", -1), strip)
    return F.transform(F.filter(pieces, lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))


def first_of(parts: Column, at_least: int = 2) -> Column:
    return F.when(F.size(parts) >= at_least, F.element_at(parts, 1))


def last_of(parts: Column, at_least: int = 2) -> Column:
    return F.when(F.size(parts) >= at_least, F.element_at(parts, -1))


def middle_of(parts: Column) -> Column:
    """Everything between the first and last sentence as one text; NULL below three sentences."""
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.when(F.size(parts) >= 3, F.array_join(inner, " "))


def infill_prompt(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(f" {BLANK_MARK} "), last)


def assemble_story(first: Column, middle: Column, last: Column) -> Column:
    """The story with a middle put back; a missing middle leaves first and last."""
    joined = F.when(middle.isNull(), F.concat_ws(" ", first, last)).otherwise(F.concat_ws(" ", first, middle, last))
    return F.replace(F.replace(joined, F.lit(BLANK_MARK), F.lit("")), F.lit("  "), F.lit(" "))


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), "")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_CLASS + "+", -1), lambda w: w != "")


def space_length(text: Column) -> Column:
    """Number of pieces between single spaces; empty pieces count."""
    return F.size(F.split(text, " ", -1)).cast("bigint")


def word_symbols(word: Column) -> Column:
    chars = F.filter(F.split(word, "", -1), lambda c: c != "")
    return F.concat(chars, F.array(F.lit(WORD_END)))


def framed(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), tokens, F.array(F.lit(EOS)))
