"""Best ``k`` items per query without forming query-item pairs.

Scores are computed block by block inside Arrow tasks, as matrix products or
posting counts, and only the best ``k`` rows per query leave a block. Two ways
lead there, chosen by the checked size of the query table:

* small query table: it is sent to every task, the items are read in place and
  nothing but the partial results is shuffled;
* otherwise the items are written once, in order of their ids, and pass by
  blocks of queries of bounded size: a task holds one block, so each query hands
  on its best rows once, or a few times where there are fewer blocks than cores.

Items in clustered lists are read from the files of their lists in the same way,
by the blocks of queries that ask for them.

Once a query has ``k`` rows, only what can be nearer than its k-th is looked at.
A window over the partial results (a few rows per query and task) finishes the
job; Spark cuts it to ``k`` per task before its shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.functions.trigram import trigrams
from fathomline.operators.filters import ITEM_SCOPE, QUERY_SCOPE
from fathomline.session import BROADCAST_BYTES, cut_lineage, file_system, row_bytes

# Rows of a query table that may travel to every task; its bytes are bounded too.
MAX_LOCAL_QUERIES = 10_000
# Scan tasks per core; each hands on up to k rows per query.
TASKS_PER_CORE = 4
SPLITS_PER_TASK = 8
# Items read at once, and queries of a block.
ITEMS_PER_CELL = 8_192
QUERIES_PER_CELL = 4_096
# Pairs put in order at once, about.
PAIRS_AT_ONCE = 500_000
# Sides of a score matrix held at once.
QUERY_CHUNK = 256
ITEM_CHUNK = 8_192
# Items whose products with a chunk of queries are made at once.
CACHED_ITEMS = 1_024
# The first items of a task are few, so that most queries soon have a k-th row to compare with.
FIRST_CHUNK = 1_024
# Stands between the trigrams of a text; none holds it.
GRAM_SEPARATOR = "\t"

PARTIAL_SCHEMA = "kind string, query_id bigint, item_id bigint, distance double, k int"
PARTIAL_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("query_id", pa.int64()), ("item_id", pa.int64()),
        ("distance", pa.float64()), ("k", pa.int32()),
    ]
)


def joined_trigrams(text: Column) -> Column:
    """The trigrams of a text as one string, which repeated texts share when they are written."""
    return F.array_join(trigrams(text), GRAM_SEPARATOR)


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(column) -> np.ndarray:
    return _flat(column).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _codes(column, values: pa.Array) -> np.ndarray:
    found = pc.index_in(_flat(column).cast(pa.string()), value_set=values)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def unit_rows(column, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length one, and which rows hold a usable vector."""
    array = _flat(column)
    lengths = pc.list_value_length(array)
    present = pc.is_valid(array).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    if dims is None:
        dims = int(sizes.max()) if len(sizes) else 0
    if np.any(present & (sizes != dims)):
        raise ValueError(f"vectors of unequal length; expected {dims}")
    matrix = np.zeros((len(array), dims))
    if present.any():
        values = _numbers(pc.list_flatten(array.filter(pa.array(present))))
        matrix[present] = values.reshape(-1, dims)
    lengths2 = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = present & (lengths2 > 0)
    matrix[usable] /= lengths2[usable, None]
    return matrix, usable


@dataclass(frozen=True)
class CosineRanker:
    """Cosine distance between ``query_vec`` and ``item_vec``."""

    precision: int = 6
    kind: str = "vec"
    query_column: str = "query_vec"
    item_column: str = "item_vec"

    def prepare_queries(self, queries: pa.Table):
        matrix, usable = unit_rows(queries[self.query_column])
        return matrix, usable, matrix.astype(np.float32)

    def prepare_items(self, prepared, items: pa.Table, list_id: int | None = None):
        dims = prepared[0].shape[1]
        if not prepared[1].any():
            return np.zeros((0, dims)), np.zeros(0, dtype=np.int64), np.zeros((0, dims), dtype=np.float32)
        matrix, usable = unit_rows(items[self.item_column], dims)
        matrix = matrix[usable]
        return matrix, np.flatnonzero(usable), matrix.astype(np.float32)

    def near(self, prepared, rows: slice | np.ndarray, side, bar: np.ndarray, outside, later: bool):
        """Places of query and item, and the distance, of all pairs that can be among a query's best.

        Single precision, with room for its error, tells which pairs are worth a
        distance in double precision.
        """
        matrix, usable, rough = prepared
        items, places, rough_items = side
        out = []
        if not len(places):
            return out
        full = np.flatnonzero(usable[rows] & np.isfinite(bar))
        if len(full):
            slack = 10.0**-self.precision + (matrix.shape[1] + 8) * 2.0**-23
            floor = (1.0 - bar[full] - slack).astype(np.float32)
            asked, near = rough[rows][full], []
            # A few items at once, so that their products stay in a core's cache.
            for start in range(0, len(places), CACHED_ITEMS):
                q, i = np.nonzero(asked @ rough_items[start:start + CACHED_ITEMS].T >= floor[:, None])
                near.append((q, i + start))
            q, i = map(np.concatenate, zip(*near))
            q = full[q]
            inside = outside.pairs(q, places[i])
            q, i = q[inside], i[inside]
            out.append((q, places[i], self._rounded(np.einsum("ij,ij->i", matrix[rows][q], items[i]))))
        open_ = np.flatnonzero(usable[rows] & ~np.isfinite(bar))
        if len(open_):
            mask = outside.block(open_, places)
            products = matrix[rows][open_] @ items.T
            within = np.ones(products.shape, dtype=bool) if mask is None else ~mask
            q, i = np.nonzero(within)
            out.append((open_[q], places[i], self._rounded(products[q, i])))
        return out

    def _rounded(self, products: np.ndarray) -> np.ndarray:
        # Adding zero turns a negative zero into a plain one.
        return np.round(1.0 - products, self.precision) + 0.0


@dataclass(frozen=True)
class TrigramRanker:
    """Trigram distance between ``query_grams`` and ``item_grams``.

    Items are scored once per distinct ``item_text`` of a block.
    """

    threshold: float = 0.3
    precision: int = 6
    kind: str = "lex"
    query_column: str = "query_grams"
    item_column: str = "item_grams"
    text_column: str = "item_text"

    def prepare_queries(self, queries: pa.Table):
        # Queries with the same trigrams are compared with a text once.
        asked = pc.dictionary_encode(_flat(queries[self.query_column]).cast(pa.string()))
        text_of = pc.fill_null(asked.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        grams = _split_grams(asked.dictionary)
        tokens = pc.list_flatten(grams)
        vocabulary = pc.unique(tokens)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(grams).to_numpy(zero_copy_only=False))])
        codes = _codes(tokens, vocabulary) if len(tokens) else np.zeros(0, dtype=np.int64)
        return vocabulary, codes, starts, text_of

    def prepare_items(self, prepared, items: pa.Table):
        vocabulary, codes, starts, asked = prepared
        texts = pc.dictionary_encode(_flat(items[self.text_column]).cast(pa.string()))
        text_of = pc.fill_null(texts.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        _, first = np.unique(text_of, return_index=True)
        first = first[text_of[first] >= 0]
        grams = _split_grams(_flat(items[self.item_column]).cast(pa.string()).take(pa.array(first)))
        sizes = pc.list_value_length(grams).to_numpy(zero_copy_only=False)
        tokens = _codes(pc.list_flatten(grams), vocabulary)
        parents = pc.list_parent_indices(grams).to_numpy(zero_copy_only=False)
        known = tokens >= 0
        order = np.argsort(tokens[known], kind="stable")
        tokens, holders = tokens[known][order], parents[known][order]
        bounds = np.searchsorted(tokens, np.arange(len(vocabulary) + 1))
        # For each text of a query the similar texts of items, and the least distance.
        similar, least = [], np.full(len(starts) - 1, np.inf)
        for query in range(len(starts) - 1):
            wanted = codes[starts[query]:starts[query + 1]]
            hits = np.concatenate([holders[bounds[c]:bounds[c + 1]] for c in wanted]) if len(wanted) else holders[:0]
            near, shared = np.unique(hits, return_counts=True)
            similarity = np.round(shared / (len(wanted) + sizes[near] - shared), self.precision)
            kept = similarity >= self.threshold
            similar.append((near[kept], np.round(1.0 - similarity[kept], self.precision)))
            if kept.any():
                least[query] = similar[-1][1].min()
        # Places of the items of each text.
        by_text = np.argsort(text_of, kind="stable")
        at = np.searchsorted(text_of[by_text], np.arange(len(first) + 1))
        return similar, least, by_text, at, len(text_of)

    def near(self, prepared, rows: slice, side, bar: np.ndarray, outside, later: bool):
        """Places of query and item, and the distance, of all pairs that can be among a query's best.

        With ``later`` all items have higher ids than those before, so an equal distance is none.
        """
        similar, least, by_text, at, n_items = side
        asked = prepared[3][rows]
        best = np.where(asked >= 0, np.append(least, np.inf)[asked], np.inf)
        wanted = np.flatnonzero((best < bar) if later else (best <= bar) & np.isfinite(best))
        out = []
        for text in np.unique(asked[wanted]):
            mine = wanted[asked[wanted] == text]
            texts, distance = similar[text]
            limit = bar[mine].max()
            kept = distance < limit if later and np.isfinite(limit) else distance <= limit
            texts, distance = texts[kept], distance[kept]
            counts = at[texts + 1] - at[texts]
            ends = np.cumsum(counts)
            places = by_text[np.repeat(at[texts] - (ends - counts), counts) + np.arange(counts.sum())]
            distance = np.repeat(distance, counts)
            within = distance[None, :] <= bar[mine, None]
            mask = outside.block(mine, places)
            if mask is not None:
                within &= ~mask
            q, i = np.nonzero(within)
            out.append((mine[q], places[i], distance[i]))
        return out


def _split_grams(joined: pa.Array) -> pa.ListArray:
    """The trigrams of each text; an empty or missing text has none."""
    parts = pc.split_pattern(pc.fill_null(joined, ""), GRAM_SEPARATOR)
    empty = pc.equal(pc.fill_null(joined, ""), "")
    return pc.if_else(empty, pa.scalar([], pa.list_(pa.string())), parts)


@dataclass
class _Scope:
    """The structured filters of a query table, ready to mask a block."""

    queries: pa.Table
    numbers: dict = field(default_factory=dict)
    attributes: tuple | None = None
    types: tuple | None = None

    def __post_init__(self):
        have = set(self.queries.column_names)
        for name in ("eff_min", "eff_max", "min_def", "max_def", "level"):
            if name in have:
                values = _numbers(self.queries[name])
                if not np.isnan(values).all():
                    self.numbers[name] = values
        for name, slot in (("attribute", "attributes"), ("card_type", "types")):
            if name in have and self.queries[name].null_count < self.queries.num_rows:
                values = pc.unique(_flat(self.queries[name]).drop_null())
                setattr(self, slot, (values, _codes(self.queries[name], values)))

    def side(self, items: pa.Table) -> dict:
        out: dict = {}
        for column, users in (("atk", ("eff_min", "eff_max")), ("def_", ("min_def", "max_def")), ("level", ("level",))):
            if any(u in self.numbers for u in users):
                out[column] = _numbers(items[column])
        if self.attributes:
            out["attribute"] = _codes(items["attribute"], self.attributes[0])
        if self.types:
            lists = _flat(items["properties"])
            member = np.zeros((len(self.types[0]), items.num_rows), dtype=bool)
            code = _codes(pc.list_flatten(lists), self.types[0])
            holder = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            member[code[code >= 0], holder[code >= 0]] = True
            out["member"] = member
        return out

    def pairs(self, q: np.ndarray, i: np.ndarray, side: dict) -> np.ndarray:
        """Which of the pairs of a query and an item are within the query's filters."""
        within = np.ones(len(q), dtype=bool)
        for name, column, passes in (
            ("eff_min", "atk", np.greater_equal),
            ("eff_max", "atk", np.less_equal),
            ("min_def", "def_", np.greater_equal),
            ("max_def", "def_", np.less_equal),
            ("level", "level", np.equal),
        ):
            if name in self.numbers:
                wanted = self.numbers[name][q]
                within &= np.isnan(wanted) | passes(side[column][i], wanted)
        if self.attributes:
            wanted = self.attributes[1][q]
            within &= (wanted < 0) | (side["attribute"][i] == wanted)
        if self.types:
            wanted = self.types[1][q]
            within &= (wanted < 0) | side["member"][wanted, i]
        return within

    def outside(self, rows: slice | np.ndarray, side: dict, n_items: int) -> np.ndarray | None:
        """Which pairs of a chunk the filters exclude; nothing if none is set."""
        out = None
        for name, column, fails in (
            ("eff_min", "atk", np.less),
            ("eff_max", "atk", np.greater),
            ("min_def", "def_", np.less),
            ("max_def", "def_", np.greater),
            ("level", "level", np.not_equal),
        ):
            if name in self.numbers:
                wanted = self.numbers[name][rows]
                limited = np.flatnonzero(~np.isnan(wanted))
                unknown = np.isnan(side[column])
                out = self._mark(out, rows, n_items, limited, fails(side[column], wanted[limited, None]) | unknown)
        if self.attributes:
            wanted = self.attributes[1][rows]
            limited = np.flatnonzero(wanted >= 0)
            out = self._mark(out, rows, n_items, limited, side["attribute"] != wanted[limited, None])
        if self.types:
            wanted = self.types[1][rows]
            limited = np.flatnonzero(wanted >= 0)
            out = self._mark(out, rows, n_items, limited, ~side["member"][wanted[limited]])
        return out

    @staticmethod
    def _mark(out, rows: slice | np.ndarray, n_items: int, limited: np.ndarray, failing: np.ndarray):
        if not len(limited):
            return out
        if out is None:
            out = np.zeros((len(rows) if isinstance(rows, np.ndarray) else rows.stop - rows.start, n_items), dtype=bool)
        out[limited] |= failing
        return out


@dataclass(frozen=True)
class _Outside:
    """The filters of a chunk of queries over a chunk of items, evaluated where they are asked for."""

    scope: _Scope
    rows: slice | np.ndarray
    side: dict

    def _places(self, q: np.ndarray) -> np.ndarray:
        return q + self.rows.start if isinstance(self.rows, slice) else self.rows[q]

    def pairs(self, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.scope.pairs(self._places(q), i, self.side)

    def block(self, q: np.ndarray, i: np.ndarray) -> np.ndarray | None:
        side = {name: values[..., i] for name, values in self.side.items()}
        return self.scope.outside(self._places(q), side, len(i))


class _Best:
    """Running best rows of one chunk of queries; ties go to the smaller item id."""

    def __init__(self, k: np.ndarray):
        self.k = k
        self.depth = int(k.max(initial=0))
        self.limit = np.full(len(k), np.inf)
        self.query = np.zeros(0, dtype=np.int64)
        self.item = np.zeros(0, dtype=np.int64)
        self.distance = np.zeros(0)

    def take(self, q: np.ndarray, items: np.ndarray, distance: np.ndarray) -> None:
        """Pairs of a query and an item, in any order."""
        if not len(q) or not self.depth:
            return
        # Only queries that something is offered to are put in order again.
        touched = np.zeros(len(self.k), dtype=bool)
        touched[q] = True
        again = touched[self.query]
        query = np.concatenate([self.query[again], q])
        item = np.concatenate([self.item[again], items])
        score = np.concatenate([self.distance[again], distance])
        order = np.lexsort((item, score, query))
        query, item, score = query[order], item[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k[query]
        query, item, score, rank = query[keep], item[keep], score[keep], rank[keep]
        full = rank == self.k[query] - 1
        self.limit[query[full]] = score[full]
        self.query = np.concatenate([self.query[~again], query])
        self.item = np.concatenate([self.item[~again], item])
        self.distance = np.concatenate([self.distance[~again], score])


class BlockScorer:
    """Scores blocks of items against one block of queries."""

    def __init__(self, queries: pa.Table, rankers: Sequence):
        self.rankers = rankers
        for ranker in rankers:
            if isinstance(ranker, TrigramRanker):
                # Queries of one text stand together and are answered together.
                queries = queries.sort_by(ranker.query_column).combine_chunks()
        self.ids = queries["query_id"].to_numpy()
        self.k = queries["k"].to_numpy().astype(np.int64)
        self.scope = _Scope(queries)
        self.prepared = [r.prepare_queries(queries) for r in rankers]
        count = len(self.ids)
        self.chunks = [slice(s, min(s + QUERY_CHUNK, count)) for s in range(0, count, QUERY_CHUNK)]
        self.best = [[_Best(self.k[rows]) for rows in self.chunks] for _ in rankers]
        self.seen, self.highest = False, 0

    def add(self, items: pa.Table) -> None:
        if not items.num_rows or not self.chunks:
            return
        items = items.sort_by("item_id")
        start = 0
        while start < items.num_rows:
            size = ITEM_CHUNK if self.seen else FIRST_CHUNK
            self._add_chunk(items.slice(start, size).combine_chunks())
            start += size

    def _add_chunk(self, items: pa.Table) -> None:
        ids = items["item_id"].to_numpy()
        scope = self.scope.side(items)
        sides = [r.prepare_items(p, items) for r, p in zip(self.rankers, self.prepared)]
        later = self.seen and ids[0] >= self.highest
        for at, rows in enumerate(self.chunks):
            outside = _Outside(self.scope, rows, scope)
            for ranker, prepared, side, kept in zip(self.rankers, self.prepared, sides, self.best):
                found = ranker.near(prepared, rows, side, kept[at].limit, outside, later)
                if found:
                    q, i, distance = map(np.concatenate, zip(*found))
                    kept[at].take(q, ids[i], distance)
        self.highest = max(self.highest, ids[-1]) if self.seen else ids[-1]
        self.seen = True

    def result(self) -> pa.Table:
        return _partial(
            (ranker.kind, self.ids, self.k, best, rows.start)
            for ranker, kept in zip(self.rankers, self.best)
            for rows, best in zip(self.chunks, kept)
        )


def _partial(found: Iterable[tuple]) -> pa.Table:
    """Rows of running bests: kind, ids and ``k`` of a block of queries, the best, and where its queries start in the block."""
    parts = [PARTIAL_ARROW.empty_table()]
    for kind, ids, k, best, start in found:
        at = best.query + start
        parts.append(
            pa.table(
                [
                    pa.array([kind] * len(at), pa.string()),
                    pa.array(ids[at], pa.int64()),
                    pa.array(best.item, pa.int64()),
                    pa.array(best.distance, pa.float64()),
                    pa.array(k[at], pa.int32()),
                ],
                schema=PARTIAL_ARROW,
            )
        )
    return pa.concat_tables(parts).combine_chunks()


@dataclass(frozen=True)
class Measure:
    """What the choice of the way needs to know of a query table."""

    rows: int
    bytes: int
    k_max: int
    k_sum: int

    def may_travel(self) -> bool:
        return self.rows <= MAX_LOCAL_QUERIES and self.bytes <= BROADCAST_BYTES


def measure(queries: DataFrame) -> Measure:
    row = queries.agg(F.count(F.lit(1)), F.sum(row_bytes(queries)), F.max("k"), F.sum("k")).first()
    return Measure(*[int(v or 0) for v in row])


def _set_filters(table: pa.Table) -> dict[str, bool]:
    return {
        name: name in table.column_names and table[name].null_count < table.num_rows for name in QUERY_SCOPE
    }


def _scan_predicate(table: pa.Table) -> Column:
    """What every query demands of an item; literals, so it reaches the scan."""
    predicate = F.lit(True)
    for name, column, pick, compare in (
        ("eff_min", "atk", pc.min, lambda c, v: c >= v),
        ("eff_max", "atk", pc.max, lambda c, v: c <= v),
        ("min_def", "def_", pc.min, lambda c, v: c >= v),
        ("max_def", "def_", pc.max, lambda c, v: c <= v),
    ):
        if name in table.column_names and table.num_rows and table[name].null_count == 0:
            predicate = predicate & compare(F.col(column), F.lit(pick(table[name]).as_py()))
    for name in ("level", "attribute"):
        if name in table.column_names and table.num_rows and table[name].null_count == 0:
            values = pc.unique(table[name]).to_pylist()
            if len(values) <= 64:
                predicate = predicate & F.col(name).isin(values)
    return predicate


def _scan_in_place(table: pa.Table, items: DataFrame, rankers: Sequence) -> DataFrame:
    needed = _set_filters(table)
    users = {
        "atk": ("eff_min", "eff_max"), "def_": ("min_def", "max_def"), "level": ("level",),
        "attribute": ("attribute",), "properties": ("card_type",),
    }
    drop = [c for c in ITEM_SCOPE if not any(needed[u] for u in users[c])]
    # The query table travels as Arrow IPC bytes; it is within the checked bounds.
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent = items.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    chosen = tuple(rankers)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = BlockScorer(pa.ipc.open_stream(sent.value).read_all(), chosen)
        for batch in batches:
            scorer.add(pa.Table.from_batches([batch]))
        yield from scorer.result().to_batches()

    scanned = items.where(_scan_predicate(table)).drop(*drop)
    # A task hands on its best rows once, so fewer and longer tasks hand on less. Joining
    # neighbouring splits needs no shuffle; no more than a few are joined, so that a task stays short.
    cores = items.sparkSession.sparkContext.defaultParallelism
    tasks = max(TASKS_PER_CORE * cores, -(-scanned.rdd.getNumPartitions() // SPLITS_PER_TASK))
    return scanned.coalesce(tasks).mapInArrow(score, PARTIAL_SCHEMA)


def _passing(queries: DataFrame, items: DataFrame, rankers: Sequence, n_queries: int) -> DataFrame:
    """Written items pass by blocks of queries, a task each; blocks are few rows, items are read file by file."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    tasks = TASKS_PER_CORE * cores
    written = cut_lineage(items.repartitionByRange(tasks, "item_id").sortWithinPartitions("item_id"))
    files = sorted(written.inputFiles())
    blocks = max(1, -(-n_queries // QUERIES_PER_CELL))
    if blocks > cores:
        # As many as keep all cores busy to the end.
        blocks = -(-blocks // cores) * cores
    shards = min(max(1, tasks // blocks), max(1, len(files)))
    chosen, at_once = tuple(rankers), QUERIES_PER_CELL

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, at_once):
            # The blocks of a task all have its shard, wherever their rows came from.
            shard = table["cell"][0].as_py() % shards
            scorer = BlockScorer(table.drop_columns("cell"), chosen)
            for path in files[shard::shards]:
                for batch in _batches(path):
                    scorer.add(pa.Table.from_batches([batch]))
            yield from scorer.result().to_batches()

    return _placed(queries, blocks, shards).mapInArrow(search, PARTIAL_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The same rows in tables of at most about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            held.append(batch.slice(start, most))
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _batches(path: str, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """A written file, some rows at a time."""
    store, name = file_system(path)
    with store.open_input_file(name) as source:
        yield from pq.ParquetFile(source).iter_batches(batch_size=ITEMS_PER_CELL, columns=columns)


def _placed(queries: DataFrame, blocks: int, shards: int) -> DataFrame:
    """Queries dealt to blocks; a partition is one block and one shard of the items, named by ``cell``."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * shards
    cells = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda shard: (block + shard).cast("int"))
    return queries.withColumn("cell", F.explode(cells)).repartitionById(blocks * shards, F.col("cell"))


class ListScorer:
    """Scores lists of items against those queries of one block that ask for them, with one running best over all lists."""

    def __init__(self, queries: pa.Table, rankers: Sequence):
        self.rankers = rankers
        self.ids = queries["query_id"].to_numpy()
        self.k = queries["k"].to_numpy().astype(np.int64)
        self.scope = _Scope(queries)
        self.prepared = [r.prepare_queries(queries) for r in rankers]
        asked = _flat(queries["lists"])
        holders = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False)
        lists = pc.list_flatten(asked).to_numpy(zero_copy_only=False)
        order = np.argsort(lists, kind="stable")
        self.lists, self.holders = lists[order], holders[order]
        self.best = [_Best(self.k) for _ in rankers]

    def asking(self, list_id: int) -> np.ndarray:
        """Places of the queries that ask for a list."""
        return self.holders[slice(*np.searchsorted(self.lists, [list_id, list_id + 1]))]

    def add(self, list_id: int, items: pa.Table) -> None:
        rows, start = self.asking(list_id), 0
        while len(rows) and start < items.num_rows:
            # Few items while most queries have no k-th row yet.
            full = min(np.isfinite(best.limit[rows]).mean() for best in self.best)
            size = ITEM_CHUNK if full > 0.5 else FIRST_CHUNK
            self._add_chunk(list_id, rows, items.slice(start, size).combine_chunks())
            start += size

    def _add_chunk(self, list_id: int, rows: np.ndarray, items: pa.Table) -> None:
        ids = items["item_id"].to_numpy()
        scope = self.scope.side(items)
        for ranker, prepared, best in zip(self.rankers, self.prepared, self.best):
            side = ranker.prepare_items(prepared, items, list_id)
            held, pairs = [], 0
            for start in range(0, len(rows), QUERY_CHUNK):
                mine = rows[start:start + QUERY_CHUNK]
                for q, i, distance in ranker.near(prepared, mine, side, best.limit[mine], _Outside(self.scope, mine, scope), False):
                    held.append((mine[q], ids[i], distance))
                    pairs += len(q)
                # All queries of the block are put in order together, some pairs at a time.
                if held and (pairs >= PAIRS_AT_ONCE or start + QUERY_CHUNK >= len(rows)):
                    best.take(*map(np.concatenate, zip(*held)))
                    held, pairs = [], 0

    def result(self) -> pa.Table:
        return _partial((r.kind, self.ids, self.k, best, 0) for r, best in zip(self.rankers, self.best))


def listed_topk(
    queries: DataFrame, items: DataFrame, columns: dict[str, str], rankers: Sequence, n_queries: int
) -> DataFrame:
    """Best rows of queries among the lists each asks for; ``keep_best`` finishes the job.

    ``queries`` as for ``blocked_topk``, with ``lists``, the lists a query asks
    for. ``items`` is a written table with a folder ``list_id`` for each list;
    ``columns`` gives the names its columns have for the rankers. A task holds a
    block of queries and reads the lists they ask for file by file, so no item is
    shuffled, and a query hands on its best rows once, not once per list.
    """
    files = sorted((int(re.search(r"/list_id=(\d+)/", path)[1]), path) for path in items.inputFiles())
    tasks = TASKS_PER_CORE * items.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // QUERIES_PER_CELL))
    shards = min(max(1, tasks // blocks), max(1, len(files)))
    chosen, at_once = tuple(rankers), QUERIES_PER_CELL

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, at_once):
            # The blocks of a task all have its shard, wherever their rows came from.
            shard = table["cell"][0].as_py() % shards
            scorer = ListScorer(table.drop_columns("cell"), chosen)
            for list_id, path in files[shard::shards]:
                if len(scorer.asking(list_id)):
                    for batch in _batches(path, list(columns)):
                        scorer.add(list_id, pa.Table.from_batches([batch]).rename_columns(columns))
            yield from scorer.result().to_batches()

    return _placed(queries, blocks, shards).mapInArrow(search, PARTIAL_SCHEMA)


def keep_best(partial: DataFrame, k_max: int) -> DataFrame:
    """Final ranks over partial results: ``kind, query_id, item_id, distance, k, rk``."""
    order = W.partitionBy("kind", "query_id").orderBy("distance", "item_id")
    ranked = partial.withColumn("rk", F.row_number().over(order))
    # The literal bound lets Spark cut the rows of every task.
    return ranked.where((F.col("rk") <= F.lit(k_max)) & (F.col("rk") <= F.col("k")))


def scope_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


@dataclass(frozen=True)
class Ranked:
    """``rows``: ``kind, query_id, item_id, distance, k, rk``; what is known of their number."""

    rows: DataFrame
    k_max: int
    max_rows: int | None


def blocked_topk(queries: DataFrame, items: DataFrame, rankers: Sequence, force_grid: bool = False) -> Ranked:
    """Ranks per ranker and query.

    ``queries`` holds ``query_id, k``, the rankers' query columns and any of the
    filter columns; ``items`` holds ``item_id``, the rankers' item columns and
    the filter columns. ``max_rows`` bounds the rows of one ranker if the query
    table was within the bounds.
    """
    size = measure(queries)
    if size.may_travel() and not force_grid:
        # A task's result is final for its items; one exchange by query serves all that follows.
        partial, most = _scan_in_place(queries.toArrow(), items, rankers), size.k_sum
    else:
        partial, most = _passing(queries, items, rankers, size.rows), None
    return Ranked(keep_best(partial.repartition("query_id"), size.k_max), size.k_max, most)
