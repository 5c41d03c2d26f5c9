"""Rank fusion, limits and the default pair score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fathomline.functions.binding import let
from fathomline.functions.trigram import held_trigrams, padded_words, trigrams

# Result limit, its range, candidate pool, fusion constants.
DEFAULT_LIMIT = 30
MIN_LIMIT = 1
MAX_LIMIT = 50
MIN_POOL = 40
POOL_PER_RESULT = 2
RRF_K = 60
MISSING_RANK = 1_000_000


def clamp_limit(limit: Column) -> Column:
    return F.least(F.greatest(F.coalesce(limit, F.lit(DEFAULT_LIMIT)), F.lit(MIN_LIMIT)), F.lit(MAX_LIMIT))


def pool_size(limit: Column) -> Column:
    return F.greatest(F.lit(MIN_POOL), F.lit(POOL_PER_RESULT) * limit)


def rrf_score(*ranks: Column, k: int = RRF_K, missing: int = MISSING_RANK) -> Column:
    """Sum of reciprocal ranks; a list that lacks the item counts with a far rank."""
    total = F.lit(0.0)
    for rank in ranks:
        total = total + F.lit(1.0) / (F.lit(k) + F.coalesce(rank, F.lit(missing)))
    return total


def lexical_coverage(query: Column, content: Column) -> Column:
    """Share of the query's trigrams found in the content.

    The default pair score. It is a lexical stand-in, not a learned model;
    a model goes in through ``operators.rerank.model_scorer``.
    """
    padded = padded_words(F.coalesce(content, F.lit("")))
    return let(trigrams(query), lambda wanted: let(padded, lambda held: trigram_coverage(wanted, held)))


def trigram_coverage(wanted: Column, padded: Column) -> Column:
    """``lexical_coverage`` of the trigrams of a query and the padded words of a content."""
    found = F.size(held_trigrams(wanted, padded))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(found / F.size(wanted))
