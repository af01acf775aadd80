"""Tokenizers as frame transforms: anything with ``encode`` of this shape can build examples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import simple_tokens
from storyloom.operators import bpe
from storyloom.operators.vocabulary import Vocabulary, decode_ids, encode_columns


class Tokenizer(Protocol):
    vocab: Vocabulary

    def encode(self, docs: DataFrame, texts: dict[str, Column], max_length: int | None = None) -> DataFrame:
        """``doc_id`` and one id list for each named text, cut to ``max_length`` ids."""

    def decode(self, rows: DataFrame, ids: Column, out: str = "text") -> DataFrame:
        """``doc_id`` and the text of its ids."""


@dataclass(frozen=True)
class WordTokenizer:
    """Word-level tokenizer; ``split`` turns a text column into its words."""

    vocab: Vocabulary
    split: Callable[[Column], Column] = simple_tokens
    limit: int | None = None

    def encode(self, docs: DataFrame, texts: dict[str, Column], max_length: int | None = None) -> DataFrame:
        # One word is one id, so cutting the words first gives the same ids and spares looking up the rest.
        words = {name: self.split(text) for name, text in texts.items()}
        if max_length is not None:
            words = {name: F.slice(w, 1, max_length) for name, w in words.items()}
        return encode_columns(docs, words, self.vocab, limit=self.limit)

    def decode(self, rows: DataFrame, ids: Column, out: str = "text") -> DataFrame:
        return decode_ids(rows, ids, self.vocab, out, limit=self.limit)


@dataclass(frozen=True)
class BpeTokenizer:
    """Byte-pair tokenizer with ids, from a trained model; builds the same examples as the word tokenizer."""

    vocab: Vocabulary
    merges: list[tuple[str, str]]
    limit: int | None = None

    @classmethod
    def train(cls, docs: DataFrame, num_merges: int = bpe.DEFAULT_MERGES) -> "BpeTokenizer":
        model = bpe.train_bpe(docs, num_merges)
        return cls(bpe.bpe_vocabulary(model), [(m[1], m[2]) for m in model.merges])

    def encode(self, docs: DataFrame, texts: dict[str, Column], max_length: int | None = None) -> DataFrame:
        return bpe.encode_id_columns(docs, texts, self.merges, self.vocab, max_length, limit=self.limit)

    def decode(self, rows: DataFrame, ids: Column, out: str = "text") -> DataFrame:
        return bpe.decode_id_symbols(rows, ids, self.vocab, out, limit=self.limit)
