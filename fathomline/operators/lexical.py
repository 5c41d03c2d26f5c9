"""Nearest items by trigram similarity of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.functions.trigram import DEFAULT_THRESHOLD, trigrams
from fathomline.operators.blocks import TrigramRanker, blocked_topk, joined_trigrams, scope_columns
from fathomline.operators.filters import ITEM_SCOPE, QUERY_SCOPE, pair_predicate
from fathomline.operators.nearest import PRECISION, as_column

# Longest posting list that is joined; longer ones go to the block scan.
MAX_POSTINGS = 100_000


def lexical_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int | str | Column,
    query_col: str = "search_text",
    text_col: str = "name",
    threshold: float = DEFAULT_THRESHOLD,
    force_grid: bool = False,
) -> DataFrame:
    """``query_id, item_id, distance, lex_rank`` of the ``k`` most similar names in scope."""
    left = queries.select(
        "query_id",
        as_column(k).cast("int").alias("k"),
        joined_trigrams(F.col(query_col)).alias("query_grams"),
        *scope_columns(queries, QUERY_SCOPE),
    )
    right = items.where(F.col(text_col).isNotNull()).select(
        "item_id",
        F.col(text_col).alias("item_text"),
        joined_trigrams(F.col(text_col)).alias("item_grams"),
        *scope_columns(items, ITEM_SCOPE),
    )
    ranked = blocked_topk(left, right, [TrigramRanker(threshold, PRECISION)], force_grid)
    return ranked.rows.select("query_id", "item_id", "distance", F.col("rk").alias("lex_rank"))


def trigram_index(items: DataFrame, text_col: str = "name") -> DataFrame:
    """Postings ``trigram, item_id, n_grams``: one row per item and trigram."""
    sets = items.select("item_id", trigrams(F.col(text_col)).alias("grams"))
    return sets.select(F.explode_outer("grams").alias("trigram"), "item_id", F.size("grams").alias("n_grams")).where(
        F.col("trigram").isNotNull()
    )


def trigram_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))


def trigram_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    index: DataFrame | None = None,
    query_col: str = "search_text",
    text_col: str = "name",
    threshold: float = DEFAULT_THRESHOLD,
    max_postings: int = MAX_POSTINGS,
) -> DataFrame:
    """The same answer as ``lexical_topk``, by way of the posting lists.

    A name at least ``threshold`` similar to a query with ``n`` trigrams shares
    at least ``ceil(threshold * n)`` of them, hence one of the query's
    ``n - ceil(threshold * n) + 1`` rarest. Only those are joined. A query whose
    rarest trigrams still include a list longer than ``max_postings`` would form
    pairs without end; it goes to the block scan instead. Both ways are exact.
    """
    index = trigram_index(items, text_col) if index is None else index
    scope = scope_columns(queries, QUERY_SCOPE)
    grams = queries.select("query_id", trigrams(F.col(query_col)).alias("query_grams"), *scope)
    frequent = trigram_frequencies(index)
    rarest_first = W.partitionBy("query_id").orderBy("df", "trigram")
    # One row per query and trigram; a query that no list knows has nothing to find.
    listed = (
        grams.select("query_id", F.size("query_grams").alias("n_query"), F.explode_outer("query_grams").alias("trigram"))
        .where(F.col("trigram").isNotNull())
        .join(frequent, "trigram", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("place", F.row_number().over(rarest_first))
        .where(F.col("place") <= F.col("n_query") - F.ceil(F.lit(threshold) * F.col("n_query") - 1e-9) + 1)
    )
    longest = F.max("df").over(W.partitionBy("query_id"))
    listed = listed.withColumn("longest", longest)
    by_scan = listed.where(F.col("longest") > max_postings).select("query_id").distinct()

    # Merged throughout: postings and trigrams are many times larger than the files they come from.
    candidates = (
        listed.where(F.col("longest") <= max_postings)
        .join(index.select("trigram", "item_id").hint("merge"), "trigram")
        .select("query_id", "item_id")
        .distinct()
    )
    right = items.select("item_id", trigrams(F.col(text_col)).alias("item_grams"), *scope_columns(items, ITEM_SCOPE))
    shared = F.size(F.array_intersect("query_grams", "item_grams"))
    similarity = F.round(shared / (F.size("query_grams") + F.size("item_grams") - shared), PRECISION)
    pairs = (
        candidates.join(grams.alias("q").hint("merge"), "query_id")
        .join(right.alias("i").hint("merge"), "item_id")
        .where(pair_predicate("q", "i", scope))
        .select("query_id", "item_id", "query_grams", "item_grams")
    )
    order = W.partitionBy("query_id").orderBy("distance", "item_id")
    found = (
        pairs.withColumn("similarity", similarity)
        .where(F.col("similarity") >= threshold)
        .select("query_id", "item_id", F.round(1 - F.col("similarity"), PRECISION).alias("distance"))
        .withColumn("lex_rank", F.row_number().over(order))
        .where(F.col("lex_rank") <= k)
    )
    scanned = lexical_topk(
        queries.join(by_scan, "query_id", "left_semi"), items, k, query_col, text_col, threshold
    )
    return found.unionByName(scanned)
