"""Whole searches over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.constraints import ConstraintSpec, prepare_queries
from fathomline.functions.scoring import DEFAULT_LIMIT, clamp_limit, pool_size
from fathomline.functions.trigram import DEFAULT_THRESHOLD
from fathomline.operators.encode import Encoder, embed
from fathomline.operators.fusion import fused_candidates, materialize
from fathomline.operators.reports import build_context, build_prompts, format_results
from fathomline.operators.rerank import HELD, Scorer, default_scorer, rerank, with_asked, with_held
from fathomline.session import cut_lineage

RESULT_FIELDS = ("name", "content", "level", "atk", "def_", "attribute", "properties")


def as_items(index: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The index table under the names the search operators use.

    ``vector_col`` chooses between the stored vector columns.
    """
    return index.select(
        F.col("item_key").alias("item_id"), "name", "content", "level", "atk", "def_",
        F.col("english_attribute").alias("attribute"), "properties", F.col(vector_col).alias("embedding"),
    )


def with_limits(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``top_k`` and ``pool``: a fixed limit, or each query's own within its range."""
    top_k: Column = F.lit(limit) if limit is not None else clamp_limit(F.col("limit"))
    return queries.withColumn("top_k", top_k.cast("int")).withColumn("pool", pool_size(F.col("top_k")).cast("int"))


def hybrid_candidates(
    queries: DataFrame,
    items: DataFrame,
    pool: str | int = "pool",
    query_vec: str = "query_vec",
    threshold: float = DEFAULT_THRESHOLD,
    mode: str = "left",
    fields: tuple[str, ...] = RESULT_FIELDS,
    force_grid: bool = False,
) -> DataFrame:
    """Fused candidates of prepared queries, with the item fields."""
    fused, max_rows = fused_candidates(
        queries, items, pool, query_vec, threshold=threshold, mode=mode, force_grid=force_grid
    )
    return materialize(fused, items, fields, max_rows)


def hybrid_search(
    queries: DataFrame,
    items: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    encoder: Encoder | None = None,
    scorer: Scorer = default_scorer,
    spec: ConstraintSpec = ConstraintSpec(),
    mode: str = "left",
) -> DataFrame:
    """Bounds from the text, fused candidates, second scoring.

    ``limit=None`` takes each query's own limit, clamped to its range. Queries
    need a ``query_vec`` unless an encoder is given; the encoder sees the text
    that remains after the bounds are taken out, and so does the scorer.
    """
    prepared = with_limits(prepare_queries(queries, spec), limit)
    if encoder is not None:
        prepared = embed(prepared, "search_text", encoder, "query_vec")
    # Measured, ranked and joined again: each query is read, parsed and encoded once.
    prepared = cut_lineage(prepared)
    held = with_held(items, scorer)
    candidates = hybrid_candidates(prepared, held, mode=mode, fields=RESULT_FIELDS + ((HELD,) if HELD in held.columns else ()))
    asked = with_asked(prepared.select("query_id", "search_text", "top_k"), scorer)
    ranked = rerank(candidates.join(asked, "query_id"), F.col("top_k"), scorer)
    return ranked.drop("search_text", "top_k")


def search_report(
    queries: DataFrame, items: DataFrame, style: str = "tool", encoder: Encoder | None = None,
    scorer: Scorer = default_scorer,
) -> DataFrame:
    """One report per query; the tool style honours each query's own limit."""
    limit = None if style == "tool" else DEFAULT_LIMIT
    ranked = hybrid_search(queries, items, limit, encoder, scorer)
    return format_results(ranked, queries, style)


def context_prompts(
    queries: DataFrame, items: DataFrame, encoder: Encoder | None = None, scorer: Scorer = default_scorer
) -> DataFrame:
    """One prompt per query, holding its results as context."""
    return build_prompts(queries, build_context(hybrid_search(queries, items, DEFAULT_LIMIT, encoder, scorer)))
