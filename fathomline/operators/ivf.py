"""Nearest items by way of clustered lists of vectors.

Unit vectors are clustered into lists. A query looks into the lists whose
centres are nearest first. From the distance it has reached by then, the
triangle inequality tells which other lists could still hold a nearer item; a
second round looks into those, so the answer is the exact one unless the caller
asks for the first round only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.functions.vectors import l2_normalize
from fathomline.operators.blocks import CosineRanker, keep_best, listed_topk, scope_columns
from fathomline.operators.filters import ITEM_SCOPE, QUERY_SCOPE
from fathomline.operators.nearest import PRECISION
from fathomline.session import cut_lineage

# Rounded distances may hide this much; added before a list is ruled out.
SLACK = 10.0**-PRECISION


def unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def gaps_to(matrix: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (matrix**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * matrix @ centers.T
    return np.sqrt(np.maximum(squares, 0))


@dataclass(frozen=True)
class IvfIndex:
    """``items`` with a ``list_id``; centre, radius and size of each list.

    The arrays are as long as the caller's ``n_lists``, whatever the data.
    """

    items: DataFrame
    centers: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    vector_col: str


def assign_lists(items: DataFrame, centers: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """Adds ``list_id`` and ``gap``, the distance to the centre of that list."""

    @F.pandas_udf("list_id int, gap double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        gaps = gaps_to(unit(vectors), centers)
        lists = gaps.argmin(axis=1)
        return pd.DataFrame({"list_id": lists.astype("int32"), "gap": gaps[np.arange(len(lists)), lists]})

    placed = items.withColumn("__list", nearest(F.col(vector_col)))
    return placed.select(*items.columns, "__list.list_id", "__list.gap")


def usable_vector(column: str) -> Column:
    """Present and not all zero."""
    return F.col(column).isNotNull() & F.exists(column, lambda x: x != 0)


def ivf_build(
    items: DataFrame,
    n_lists: int,
    path: str,
    vector_col: str = "embedding",
    seed: int = 7,
    max_iter: int = 5,
    learn_from: DataFrame | None = None,
) -> IvfIndex:
    """Clusters the items that have a vector and writes each to its list under ``path``.

    The lists are the folders of the written table, so a search reads only the
    lists it looks into. Centres may be learnt from a smaller table: they decide
    how many lists a search reads, not what it finds.
    """
    held = items.where(usable_vector(vector_col))
    learnt = held if learn_from is None else learn_from.where(usable_vector(vector_col))
    points = learnt.select(array_to_vector(l2_normalize(F.col(vector_col))).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, initSteps=2).fit(points)
    centers = np.array(model.clusterCenters())
    # Brings a list together to write few files, and splits it where it is large.
    placed = assign_lists(held, centers, vector_col).hint("rebalance", "list_id")
    placed.write.mode("overwrite").partitionBy("list_id").parquet(path)
    placed = items.sparkSession.read.parquet(path)
    radii, counts = np.zeros(len(centers)), np.zeros(len(centers), dtype=np.int64)
    per_list = placed.groupBy("list_id").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    for row in per_list.collect():
        radii[row.list_id], counts[row.list_id] = row.radius, row.n
    return IvfIndex(placed, centers, radii, counts, vector_col)


def _lists_by_gap(index: IvfIndex, query_col: str) -> Column:
    """Per query, all lists nearest first, with the least distance an item there can have."""
    centers, radii = index.centers, index.radii

    @F.pandas_udf("array<struct<list_id: int, floor: double>>")
    def probe(vectors: pd.Series) -> pd.Series:
        gaps = gaps_to(unit(vectors), centers)
        floors = np.maximum(gaps - radii[None, :], 0)
        order = gaps.argsort(axis=1, kind="stable")
        return pd.Series(
            [[{"list_id": int(c), "floor": float(f[c])} for c in row] for row, f in zip(order, floors)]
        )

    return probe(F.col(query_col))


def ivf_topk(
    queries: DataFrame,
    index: IvfIndex,
    k: int,
    nprobe: int = 4,
    exact: bool = True,
    query_col: str = "query_vec",
) -> DataFrame:
    """``query_id, item_id, distance, vec_rank``; filters as in ``vector_topk``."""
    scope = scope_columns(queries, QUERY_SCOPE)
    # Read by each round.
    asked = cut_lineage(queries.where(usable_vector(query_col)).select(
        "query_id",
        F.lit(k).cast("int").alias("k"),
        F.col(query_col).alias("query_vec"),
        *scope,
        _lists_by_gap(index, query_col).alias("near"),
    ))
    n_queries = asked.count()
    fields = {"item_id": "item_id", index.vector_col: "item_vec"} | {c: c for c in scope_columns(index.items, ITEM_SCOPE)}
    columns = ["kind", "query_id", "item_id", "distance", "k"]

    def search(chosen: DataFrame) -> DataFrame:
        lists = F.transform("chosen", lambda x: x["list_id"].cast("bigint")).alias("lists")
        wanted = chosen.where(F.size("chosen") > 0).select("query_id", "k", "query_vec", *scope, lists)
        return keep_best(listed_topk(wanted, index.items, fields, [CosineRanker(PRECISION)], n_queries), k).select(*columns)

    found = search(asked.withColumn("chosen", F.slice("near", 1, nprobe)))
    if exact:
        # Read three times below, a few rows per query.
        found = cut_lineage(found)
        reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
        # Unit vectors: squared distance is twice the cosine distance.
        reach = F.when(F.col("n") >= k, F.sqrt(2 * (F.col("worst") + SLACK)) + SLACK)
        rest = F.slice("near", nprobe + 1, F.size("near"))
        within = F.filter(rest, lambda x: F.col("reach").isNull() | (x["floor"] <= F.col("reach")))
        open_lists = asked.join(reached.select("query_id", reach.alias("reach")).hint("merge"), "query_id", "left").withColumn("chosen", within)
        found = keep_best(found.unionByName(search(open_lists)), k).select(*columns)
    order = W.partitionBy("query_id").orderBy("distance", "item_id")
    return found.select("query_id", "item_id", "distance", F.row_number().over(order).alias("vec_rank"))


def recall_at_k(approx: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, hits, expected, recall`` against the exact lists."""
    hit = approx.select("query_id", "item_id", F.lit(1).alias("hit"))
    return (
        truth.select("query_id", "item_id")
        .join(hit, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("expected"))
        .withColumn("recall", F.round(F.col("hits") / F.col("expected"), 6))
    )
