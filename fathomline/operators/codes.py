"""Approximate nearest items: short codes of the residuals in clustered lists, then an exact check of the best.

What an item's unit vector lies off its list's centre is cut into parts, and
each part is named by the nearest word of a codebook, one byte. A query reads
the codes of its nearest lists, at ``parts`` bytes an item, keeps the best by
estimated distance, and only those are compared by their vectors. A query that
finds fewer than ``k`` items inside its filters opens further lists, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fathomline.functions.vectors import cosine_distance
from fathomline.operators.blocks import keep_best, listed_topk, scope_columns, unit_rows
from fathomline.operators.filters import ITEM_SCOPE, QUERY_SCOPE
from fathomline.operators.ivf import IvfIndex, gaps_to, unit, usable_vector
from fathomline.operators.nearest import PRECISION
from fathomline.session import cut_lineage

# At most this many residuals teach the codebooks; every item is coded.
CODE_SAMPLE = 20_000
WORDS = 256
ROUNDS = 8
# How many times as many lists each further step opens.
STEP = 4


@dataclass(frozen=True)
class CodedIndex:
    """``codes``: ``item_id, list_id, code`` and the filter columns; ``books``: parts x words x width."""

    index: IvfIndex
    codes: DataFrame
    books: np.ndarray


def learn_words(points: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of the points of one part; fewer points than words leave some words equal."""
    centers = points[rng.choice(len(points), words, replace=len(points) < words)]
    for _ in range(ROUNDS):
        nearest = gaps_to(points, centers).argmin(axis=1)
        held = np.bincount(nearest, minlength=words)
        total = np.zeros_like(centers)
        np.add.at(total, nearest, points)
        centers = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centers)
    return centers


def code_build(index: IvfIndex, path: str, parts: int = 16, sample: int = CODE_SAMPLE, seed: int = 7) -> CodedIndex:
    """Codes every item of ``index`` and writes them to a folder per list under ``path``.

    The codebooks come from at most ``sample`` items: they decide how near an
    estimate is, not which items can be found.
    """
    centers, vector = index.centers, F.col(index.vector_col)
    dims = centers.shape[1]
    if dims % parts:
        raise ValueError(f"{dims} dimensions cannot be cut into {parts} equal parts")
    share = min(1.0, 1.2 * sample / max(int(index.counts.sum()), 1))
    drawn = index.items.select(vector.alias("v"), "list_id").sample(share, seed).limit(sample).toPandas()
    lists = drawn["list_id"].to_numpy(dtype=np.int64)
    residuals = unit(drawn["v"]) - centers[lists] if len(drawn) else np.zeros((1, dims))
    rng = np.random.default_rng(seed)
    books = np.stack([learn_words(part, WORDS, rng) for part in np.split(residuals, parts, axis=1)])

    @F.pandas_udf("binary")
    def code(vectors: pd.Series, lists: pd.Series) -> pd.Series:
        rows = unit(vectors) - centers[lists.to_numpy(dtype=np.int64)]
        cut = np.split(rows, parts, axis=1)
        named = np.stack([gaps_to(part, book).argmin(axis=1) for part, book in zip(cut, books)], axis=1).astype(np.uint8)
        return pd.Series([row.tobytes() for row in named])

    columns = scope_columns(index.items, ITEM_SCOPE)
    coded = index.items.select("item_id", "list_id", code(vector, F.col("list_id")).alias("code"), *columns)
    coded.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
    return CodedIndex(index, index.items.sparkSession.read.parquet(path), books)


@dataclass(frozen=True)
class CodeRanker:
    """Estimated cosine distance between a ``query_vec``, less the centre of a list, and the ``code`` of an item there."""

    books: np.ndarray
    centers: np.ndarray
    kind: str = "code"

    def prepare_queries(self, queries: pa.Table) -> np.ndarray:
        matrix, usable = unit_rows(queries["query_vec"])
        matrix[~usable] = 0
        return matrix

    def prepare_items(self, prepared: np.ndarray, items: pa.Table, list_id: int):
        data = b"".join(items["code"].to_pylist())
        codes = np.frombuffer(data, dtype=np.uint8).reshape(items.num_rows, len(self.books))
        words = np.concatenate([book[code] for book, code in zip(self.books, codes.T)], axis=1)
        halves = np.einsum("ij,ij->i", words, words) / 2
        rough = np.column_stack([words, -halves]).astype(np.float32)
        return self.centers[list_id], words, halves, rough

    def near(self, prepared: np.ndarray, rows: np.ndarray, side, bar: np.ndarray, outside, later: bool):
        """Places of query and item, and the estimate, of all pairs that can be among a query's best.

        Single precision, with room for its error, tells which pairs are worth
        an estimate in double precision.
        """
        center, words, halves, rough = side
        residual = prepared[rows] - center
        half = np.einsum("ij,ij->i", residual, residual) / 2
        out = []
        full = np.flatnonzero(np.isfinite(bar))
        if len(full):
            size = 2 * (half.max() + halves.max()) + 1
            slack = 10.0**-PRECISION + (words.shape[1] + 8) * 2.0**-23 * size
            floor = (half[full] - bar[full] - slack).astype(np.float32)
            asked = np.column_stack([residual[full], np.ones(len(full))]).astype(np.float32)
            q, i = np.nonzero(asked @ rough.T >= floor[:, None])
            q = full[q]
            inside = outside.pairs(q, i)
            q, i = q[inside], i[inside]
            off = residual[q] - words[i]
            out.append((q, i, np.round(np.einsum("ij,ij->i", off, off) / 2, PRECISION)))
        open_ = np.flatnonzero(~np.isfinite(bar))
        if len(open_):
            # Unit vectors: squared distance is twice the cosine distance.
            estimate = half[open_, None] + halves[None, :] - residual[open_] @ words.T
            mask = outside.block(open_, np.arange(len(words)))
            q, i = np.nonzero(np.ones(estimate.shape, dtype=bool) if mask is None else ~mask)
            out.append((open_[q], i, np.round(np.maximum(estimate[q, i], 0), PRECISION)))
        return out


def _probes(queries: DataFrame, index: IvfIndex, first: int, last: int) -> DataFrame:
    """Adds ``lists``, a query's ``first`` to ``last`` nearest lists that hold items."""
    held = np.flatnonzero(index.counts)
    centers = index.centers

    @F.pandas_udf("array<bigint>")
    def nearest(vectors: pd.Series) -> pd.Series:
        gaps = gaps_to(unit(vectors), centers[held])
        if last < len(held):
            near = np.argpartition(gaps, last - 1, axis=1)[:, :last]
        else:
            near = np.tile(np.arange(len(held)), (len(gaps), 1))
        order = np.argsort(np.take_along_axis(gaps, near, axis=1), axis=1, kind="stable")
        return pd.Series(list(held[np.take_along_axis(near, order, axis=1)][:, first:last]))

    return queries.withColumn("lists", nearest("query_vec"))


def coded_topk(
    queries: DataFrame, coded: CodedIndex, k: int, nprobe: int = 4, checked: int = 8, query_col: str = "query_vec"
) -> tuple[DataFrame, DataFrame]:
    """``query_id, item_id, distance, vec_rank``, and ``query_id, lists_read``; filters as in ``vector_topk``.

    The best ``checked * k`` items by estimate are compared exactly, so the
    distances are exact; an item may be missing. A query that has fewer than
    ``k`` items after its lists opens ``STEP`` times as many, until it has
    ``k`` or all lists are read: a narrow filter loses nothing but time.
    """
    index, kept = coded.index, checked * k
    held = int((index.counts > 0).sum())
    scope = scope_columns(queries, QUERY_SCOPE)
    # Read by every step and by the check.
    asked = cut_lineage(queries.where(usable_vector(query_col)).select(
        "query_id", F.lit(kept).cast("int").alias("k"), F.col(query_col).alias("query_vec"), *scope
    ))
    fields = {c: c for c in ("item_id", "code", *scope_columns(coded.codes, ITEM_SCOPE))}
    ranker = CodeRanker(coded.books, index.centers)
    columns = ["kind", "query_id", "item_id", "distance", "k"]
    waiting, first, last = asked, 0, min(nprobe, held)
    found, read = None, []
    while first < held:
        probes = _probes(waiting, index, first, last)
        best = keep_best(listed_topk(probes, coded.codes, fields, [ranker], waiting.count()), kept).select(*columns)
        best = cut_lineage(best if found is None else keep_best(found.unionByName(best), kept).select(*columns))
        read.append(waiting.select("query_id", F.lit(last).cast("bigint").alias("lists_read")))
        found, first, last = best, last, min(last * STEP, held)
        if first < held:
            enough = found.groupBy("query_id").count().where(F.col("count") >= k)
            waiting = cut_lineage(waiting.join(enough, "query_id", "left_anti"))
            if waiting.isEmpty():
                break
    if found is None:
        empty = asked.where("false")
        none = F.lit(None)
        lists = empty.select("query_id", none.cast("bigint").alias("item_id"), none.cast("double").alias("distance"), none.cast("int").alias("vec_rank"))
        return lists, asked.select("query_id", F.lit(0).cast("bigint").alias("lists_read"))
    pairs = found.select("query_id", "item_id").join(asked.select("query_id", "query_vec"), "query_id")
    pairs = pairs.join(index.items.select("item_id", F.col(index.vector_col).alias("item_vec")), "item_id")
    exact = pairs.select("query_id", "item_id", F.round(cosine_distance(F.col("query_vec"), F.col("item_vec")), PRECISION).alias("distance"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "item_id"))
    lists = exact.withColumn("vec_rank", place).where(F.col("vec_rank") <= k)
    looked = read[0]
    for more in read[1:]:
        looked = looked.unionByName(more)
    return lists, looked.groupBy("query_id").agg(F.max("lists_read").alias("lists_read"))
