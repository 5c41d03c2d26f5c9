"""Second scoring of the candidates, best first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.functions.binding import let
from fathomline.functions.scoring import lexical_coverage, trigram_coverage
from fathomline.functions.trigram import padded_words, trigrams

Scorer = Callable[[Column, Column], Column]

SCORE_PRECISION = 6
# What a scorer computes of a query and of a content alone, if that was done before they met.
ASKED, HELD = "__asked", "__held"


class CoverageScorer:
    """``lexical_coverage``. Its parts of a query and of a content can be computed before they meet."""

    def __call__(self, query: Column, content: Column) -> Column:
        return lexical_coverage(query, content)

    def asked(self, query: Column) -> Column:
        return trigrams(query)

    def held(self, content: Column) -> Column:
        return padded_words(F.coalesce(content, F.lit("")))

    def score(self, asked: Column, held: Column) -> Column:
        return trigram_coverage(asked, held)


default_scorer = CoverageScorer()


def has_parts(scorer: Scorer) -> bool:
    return all(hasattr(scorer, name) for name in ("asked", "held", "score"))


def with_asked(queries: DataFrame, scorer: Scorer = default_scorer, query_col: str = "search_text") -> DataFrame:
    """Queries with what the scorer computes of them alone: once per query, not once per candidate."""
    return queries.withColumn(ASKED, scorer.asked(F.col(query_col))) if has_parts(scorer) else queries


def with_held(items: DataFrame, scorer: Scorer = default_scorer, content_col: str = "content") -> DataFrame:
    """Items with what the scorer computes of their content alone: once per item, not once per candidate."""
    return items.withColumn(HELD, scorer.held(F.col(content_col))) if has_parts(scorer) else items


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Scorer:
    """A scorer from a pair model; ``load`` runs once per Python worker task."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for queries, contents in parts:
            yield pd.Series(predict(list(zip(queries, contents.fillna("")))), dtype="float64")

    # Kept from being copied or moved by the optimizer: a model is costly.
    once = score.asNondeterministic()
    return lambda query, content: once(query, content)


def rerank(
    candidates: DataFrame,
    top_k: int | str | Column,
    scorer: Scorer = default_scorer,
    query_col: str = "search_text",
    content_col: str = "content",
) -> DataFrame:
    """Adds ``rerank_score`` and ``rank`` and keeps the best ``top_k`` per query.

    Equal scores keep their fused order. NULL content is scored as empty text.
    What ``with_asked`` and ``with_held`` computed beforehand is used and dropped.
    """
    k = top_k if isinstance(top_k, Column) else F.col(top_k) if isinstance(top_k, str) else F.lit(top_k)
    if has_parts(scorer) and (ASKED in candidates.columns or HELD in candidates.columns):
        asked = F.col(ASKED) if ASKED in candidates.columns else scorer.asked(F.col(query_col))
        held = F.col(HELD) if HELD in candidates.columns else scorer.held(F.col(content_col))
        score = let(asked, lambda a: let(held, lambda h: scorer.score(a, h)))
    else:
        score = scorer(F.col(query_col), F.coalesce(F.col(content_col), F.lit("")))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rrf_rank")
    return (
        candidates.withColumn("rerank_score", F.round(score, SCORE_PRECISION))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .drop(ASKED, HELD)
    )
