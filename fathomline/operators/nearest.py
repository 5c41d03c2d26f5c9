"""Nearest items by cosine distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.vectors import cosine_distance
from fathomline.operators.blocks import CosineRanker, blocked_topk, scope_columns
from fathomline.operators.filters import ITEM_SCOPE, QUERY_SCOPE, Filters, filter_items

PRECISION = 6


def as_column(k: int | str | Column) -> Column:
    if isinstance(k, Column):
        return k
    return F.col(k) if isinstance(k, str) else F.lit(k)


def nearest_items(
    items: DataFrame, vector: list[float], k: int, filters: Filters = Filters(), vector_col: str = "embedding"
) -> DataFrame:
    """One query vector: filtered scan, sort and limit (one top-k operator)."""
    target = F.array(*[F.lit(float(x)) for x in vector])
    scored = (
        filter_items(items, filters)
        .where(F.col(vector_col).isNotNull())
        .select("item_id", F.round(cosine_distance(F.col(vector_col), target), PRECISION).alias("distance"))
    )
    return scored.where(F.col("distance").isNotNull()).orderBy("distance", "item_id").limit(k)


def vector_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int | str | Column,
    query_col: str = "query_vec",
    vector_col: str = "embedding",
    force_grid: bool = False,
) -> DataFrame:
    """``query_id, item_id, distance, vec_rank`` of the ``k`` nearest items in scope.

    ``queries`` may carry the prepared filter columns; the filters hold before
    ranking. Vectors that are missing or zero have no distance and no rank.
    Distances are rounded before ranking and ties go to the smaller id.
    """
    left = queries.where(F.col(query_col).isNotNull()).select(
        "query_id",
        as_column(k).cast("int").alias("k"),
        F.col(query_col).alias("query_vec"),
        *scope_columns(queries, QUERY_SCOPE),
    )
    right = items.where(F.col(vector_col).isNotNull()).select(
        "item_id", F.col(vector_col).alias("item_vec"), *scope_columns(items, ITEM_SCOPE)
    )
    ranked = blocked_topk(left, right, [CosineRanker(PRECISION)], force_grid)
    return ranked.rows.select("query_id", "item_id", "distance", F.col("rk").alias("vec_rank"))


def knn_join(
    queries: DataFrame, items: DataFrame, k: int, query_col: str = "query_vec", vector_col: str = "embedding"
) -> DataFrame:
    """Every query against every item, no filters."""
    bare = queries.select("query_id", query_col)
    return vector_topk(bare, items.select("item_id", vector_col), k, query_col, vector_col)
