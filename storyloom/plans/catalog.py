"""All registered queries."""

from storyloom.plans import bpe_queries, corpus_queries, example_queries, generation_queries, model_queries, text_queries  # noqa: F401
from storyloom.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
