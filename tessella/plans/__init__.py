"""The queries of the library; importing this registers them."""

from tessella.plans import corpus, lexicon, scores, steps, tables  # noqa: F401
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
