"""Rank fusion and late lookup of the item fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.functions.scoring import MISSING_RANK, RRF_K, rrf_score
from fathomline.functions.trigram import DEFAULT_THRESHOLD
from fathomline.operators.blocks import CosineRanker, TrigramRanker, blocked_topk, joined_trigrams, scope_columns
from fathomline.operators.filters import ITEM_SCOPE, QUERY_SCOPE
from fathomline.operators.nearest import PRECISION, as_column

SCORE_PRECISION = 9
# Candidate rows (two ids, two ranks, a score) that may be sent to every task.
MAX_BROADCAST_CANDIDATES = 500_000


def _rank_fused(fused: DataFrame, k: int | str, k_max: int, rrf_k: int, missing: int) -> DataFrame:
    scored = fused.withColumn(
        "rrf_score",
        F.round(rrf_score(F.col("vec_rank"), F.col("lex_rank"), k=rrf_k, missing=missing), SCORE_PRECISION),
    )
    order = W.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "item_id")
    return scored.withColumn("rrf_rank", F.row_number().over(order)).where(
        (F.col("rrf_rank") <= F.lit(k_max)) & (F.col("rrf_rank") <= as_column(k))
    )


def rrf_fuse(
    vec: DataFrame,
    lex: DataFrame,
    pool: int,
    rrf_k: int = RRF_K,
    mode: str = "left",
    missing: int = MISSING_RANK,
) -> DataFrame:
    """Fuses two rank lists into the best ``pool`` per query.

    ``left`` keeps the vector candidates only and lets the name ranks lift them;
    ``outer`` keeps the candidates of both lists.
    """
    if mode not in ("left", "outer"):
        raise ValueError(f"mode must be 'left' or 'outer', not {mode!r}")
    both = vec.select("query_id", "item_id", "vec_rank").join(
        lex.select("query_id", "item_id", "lex_rank"), ["query_id", "item_id"], mode
    )
    return _rank_fused(both, pool, pool, rrf_k, missing)


def fused_candidates(
    queries: DataFrame,
    items: DataFrame,
    pool: int | str | Column = "pool",
    query_vec: str = "query_vec",
    query_text: str = "search_text",
    vector_col: str = "embedding",
    text_col: str = "name",
    threshold: float = DEFAULT_THRESHOLD,
    rrf_k: int = RRF_K,
    mode: str = "left",
    missing: int = MISSING_RANK,
    force_grid: bool = False,
) -> tuple[DataFrame, int | None]:
    """Both rank lists from one pass over the items, fused; and a bound of the rows if known.

    The two lists meet in an aggregation over ``(query_id, item_id)``, so the
    items are read once and no join is needed.
    """
    left = queries.select(
        "query_id",
        as_column(pool).cast("int").alias("k"),
        F.col(query_vec).alias("query_vec"),
        joined_trigrams(F.col(query_text)).alias("query_grams"),
        *scope_columns(queries, QUERY_SCOPE),
    )
    right = items.select(
        "item_id",
        F.col(vector_col).alias("item_vec"),
        F.col(text_col).alias("item_text"),
        joined_trigrams(F.col(text_col)).alias("item_grams"),
        *scope_columns(items, ITEM_SCOPE),
    )
    rankers = [CosineRanker(PRECISION), TrigramRanker(threshold, PRECISION)]
    ranked = blocked_topk(left, right, rankers, force_grid)
    both = ranked.rows.groupBy("query_id", "item_id").agg(
        F.max(F.when(F.col("kind") == "vec", F.col("rk"))).alias("vec_rank"),
        F.max(F.when(F.col("kind") == "lex", F.col("rk"))).alias("lex_rank"),
        F.max("k").alias("k"),
    )
    if mode == "left":
        both = both.where(F.col("vec_rank").isNotNull())
    return _rank_fused(both, "k", ranked.k_max, rrf_k, missing).drop("k"), ranked.max_rows


def materialize(candidates: DataFrame, items: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """Item fields joined to ranked ids; wide columns are read only here.

    ``rows`` is a proven upper bound of the candidate rows (the queries' pools together).
    Within the limit the candidates travel and the items stay where they are.
    """
    fields = items.select("item_id", *columns)
    if rows is not None and rows <= MAX_BROADCAST_CANDIDATES:
        return fields.join(F.broadcast(candidates), "item_id")
    # Texts are larger than their compressed files promise, so they are not left to be sent around.
    return candidates.join(fields.hint("merge"), "item_id")
