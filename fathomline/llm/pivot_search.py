"""Exact top-k search with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.llm.common import read_rows
from fathomline.session import cut_lineage

SCALE = 1024
PIVOTS = 64
QUERY_BLOCK = 1024
ITEMS_AT_ONCE = 2048
STEP = 128
CHUNK = 30_000  # candidates a task holds while the blocks of queries pass


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, sound)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of ``column`` as rows, filled up with zeros to ``width``."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.float64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class _Best:
    """The best ``k`` of each query so far: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def limit(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def _search(queries: dict, best: _Best, ids: np.ndarray, items: np.ndarray, table: np.ndarray) -> None:
    """Takes ``items`` into ``best``, those with the highest bound on their score first.

    The distances of both to a pivot bound their own distance from below, the
    greatest such bound counts, and with the lengths it bounds the inner product
    from above. A query stops at the first bound below its k-th score; an equal
    one could still win by its id.
    """
    length = (items * items).sum(axis=1)
    gap = np.zeros((len(queries["id"]), len(items)))
    for p in range(table.shape[1]):
        np.maximum(gap, np.abs(queries["table"][:, p, None] - table[None, :, p]), out=gap)
    both = queries["length"][:, None] + length[None, :]
    bound = (both - gap * gap) / 2 + 1e-9 * both + 0.01  # room for rounding; scores are whole
    for q in range(len(bound)):
        limit = best.limit(q)
        order = np.flatnonzero((bound[q] >= limit) & (ids != queries["id"][q]))
        order = order[np.argsort(-bound[q][order], kind="stable")]
        for begin in range(0, len(order), STEP):
            part = order[begin:begin + STEP]
            limit = best.limit(q)
            if bound[q][part[0]] < limit:
                break
            part = part[bound[q][part] >= limit]
            best.add(q, np.rint(items[part] @ queries["items"][q]).astype(np.int64), ids[part])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``CHUNK``, however small the given ones are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pivot_topk(rows: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query, exactly.

    ``rows`` (vec_id, embedding); each component x becomes floor(1024 * x).
    Queries are the rows for which ``is_query`` holds, candidates all others.
    A first pass writes each vector with its distances to ``pivots`` vectors, a
    bounded choice by hash. Candidates stay where they are and are read once:
    a task holds some of them while the written blocks of about ``QUERY_BLOCK``
    queries pass, so work is the product that an exact search is, but no query
    goes through the driver. A task hands on ``k`` rows per query and chunk.
    How much the bounds rule out depends on the vectors: README has figures.

    Defined results: rows whose vector is null or holds null or non-finite
    components, and rows without an id, take no part; a shorter vector counts
    as filled up with zeros; rows with the query's id are the query's own;
    repeated rows are candidates each; a query id with several rows asks with
    the least vector; scores are exact while vectors' squared lengths stay
    under 2^53; an empty table gives none; other columns are not looked at.
    Returns query_id, rank, vec_id, score.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    base = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("items"), is_query.alias("asks")
    )
    width = base.agg(F.max(F.size("items"))).first()[0] or 0
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id", "items").limit(pivots).select("items").collect()
    places = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        places[i, :len(row[0])] = row[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = matrix(batch.column("items"), width)
            squares = (items * items).sum(axis=1)[:, None] + (places * places).sum(axis=1)[None, :] - 2 * items @ places.T
            table = np.sqrt(np.maximum(squares, 0))
            flat = lambda m: pa.ListArray.from_arrays(
                np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), flat(items), flat(table), batch.column("asks")], names=["vec_id", "items", "pivots", "asks"]
            )

    table = cut_lineage(base.mapInArrow(measure, "vec_id bigint, items array<double>, pivots array<double>, asks boolean"))
    asking = cut_lineage(
        table.where("asks").groupBy("vec_id").agg(F.min(F.struct("items", "pivots")).alias("q")).select("vec_id", "q.*")
    )
    # A file per block; tasks read them one after the other, so neither the plan nor the driver grows with the queries.
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    files = cut_lineage(asking.repartition(blocks, "vec_id")).inputFiles()
    n_pivots = len(places)

    def queries_of(path: str) -> dict | None:
        held = read_rows(path).combine_chunks().to_batches()
        if not held:
            return None
        asked = matrix(held[0].column("items"), width)
        return {
            "id": held[0].column("vec_id").to_numpy(), "items": asked, "length": (asked * asked).sum(axis=1),
            "table": matrix(held[0].column("pivots"), n_pivots),
        }

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            ids, items = held.column("vec_id").to_numpy(), matrix(held.column("items"), width)
            distances = matrix(held.column("pivots"), n_pivots)
            for queries in filter(None, map(queries_of, files)):
                best = _Best(len(queries["id"]), k)
                for begin in range(0, len(ids), ITEMS_AT_ONCE):
                    part = slice(begin, begin + ITEMS_AT_ONCE)
                    _search(queries, best, ids[part], items[part], distances[part])
                sizes = [len(s) for s in best.scores]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries["id"], sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
                    names=["query_id", "vec_id", "score"],
                )

    found = table.select("vec_id", "items", "pivots").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
