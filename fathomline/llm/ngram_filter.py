"""Scores of texts under a language model held in a log-frequency Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.llm.common import text_slices, texts_of
from fathomline.session import cut_lineage

SLICE_BYTES = 4_000_000  # of text, whose words are asked for together
SHARD_WORDS = 500_000  # words, a slice's copy each, counted in one group
SHARD_TOKENS = 1_000_000  # tokens whose pairs are counted in one group
BROADCAST_BYTES = 128 << 20  # a larger filter is asked where its shards stand
ENTRY_BITS = 12  # one probe in about 200 of a pair that never stood finds it
GROWTH = 1.5  # of the counts from one level to the next, once that is more than one
END, START = b"", b" "  # no word is empty or a blank
LANES = 8  # 32-bit words of a block; an entry sets one bit in each

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SALTS = (mixed(np.arange(1, LANES + 1, dtype=np.uint64)) >> _HALF).astype(np.uint32) | np.uint32(1)


def _thresholds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out, np.int64)


# The least count of each level, and what a level stands for: the middle of its counts, 0 for none.
THRESHOLDS = _thresholds()
VALUES = np.concatenate([[0.0], (THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(THRESHOLDS, counts, side="right"), len(VALUES) - 1)


def _places(items: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What chooses an entry's block, and its bit in each lane."""
    h = mixed(items + np.uint64(1) + _ODD * np.asarray(level, np.uint64))
    bits = (h.astype(np.uint32)[:, None] * _SALTS[None, :]) >> np.uint32(27)
    return h >> _HALF, np.uint32(1) << bits


def filled(items: np.ndarray, counts: np.ndarray, entry_bits: int = ENTRY_BITS) -> np.ndarray:
    """A Bloom filter of blocks in which an item of level q stands q times: as (item, 1) to (item, q)."""
    levels = level_of(counts)
    entries = np.repeat(items, levels)
    nth = np.arange(len(entries)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    blocks = np.zeros((max(1, -(-len(entries) * entry_bits // (32 * LANES))), LANES), np.uint32)
    if len(entries):
        high, bits = _places(entries, nth)
        block = (high * np.uint64(len(blocks)) >> _HALF).astype(np.int64)
        order = np.argsort(block, kind="stable")
        found, first = np.unique(block[order], return_index=True)
        blocks[found] = np.bitwise_or.reduceat(bits[order], first, axis=0)
    return blocks


def probed(blocks: np.ndarray, begin: np.ndarray, size: np.ndarray, items: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
    """Levels of ``items`` in filters that take ``size`` of ``blocks`` from ``begin``: probes go on until one fails."""
    out = np.zeros(len(items), np.uint8)
    for at in range(0, len(items), chunk):
        alive = np.arange(at, min(at + chunk, len(items)))
        for level in range(1, len(VALUES)):
            high, bits = _places(items[alive], level)
            block = begin[alive] + (high * size[alive].astype(np.uint64) >> _HALF).astype(np.int64)
            alive = alive[((blocks[block] & bits) == bits).all(axis=1)]
            if not len(alive):
                break
            out[alive] = level
    return out


def _bytes(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _packed(values: np.ndarray) -> bytes:
    """Small numbers, compressed: the lowest bytes of all, then the next ones."""
    return pa.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


# ---------------------------------------------------------------- slices

SLICE = (
    "slice bigint, doc_ids array<bigint>, held binary, ends binary, high binary, low binary, tokens binary, "
    "n_words bigint, n_tokens bigint, train_tokens bigint, train_docs bigint"
)


def slices(docs: DataFrame, held: Column) -> DataFrame:
    """Texts as word numbers: a row for each few megabytes, with 96 bits of the hashes of its distinct words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_slices(batch, max_bytes=SLICE_BYTES):
                if not part.num_rows:
                    continue
                words: list[bytes] = []
                ends = []
                for text in texts_of(part):
                    # bytes: lower() changes A-Z alone, split() cuts at the six blanks
                    words += text.encode("utf-8", "surrogatepass").lower().split()
                    words.append(END)
                    ends.append(len(words))
                coded = pa.array(words, pa.large_binary()).dictionary_encode()
                del words
                hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), ">u8").reshape(-1, 2)
                out = np.array(part.column("held").to_pylist(), bool)
                sizes = np.diff([0, *ends])
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([nth], pa.int64()), "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": [_bytes(out, "u1")], "ends": [_bytes(ends, "<i8")], "high": [_bytes(hashes[:, 0], "<u8")],
                    "low": [_bytes(hashes[:, 1] >> _HALF, "<u4")], "tokens": [_packed(coded.indices.to_numpy())],
                    "n_words": [len(hashes)], "n_tokens": [ends[-1]], "train_tokens": [int(sizes[~out].sum())],
                    "train_docs": [int((~out).sum())],
                })
                nth += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    return rows.mapInArrow(work, SLICE)


class Slice:
    """A row of ``slices``."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.number, self.doc_ids = row["slice"], row["doc_ids"]
        self.held, self.ends = read("held", "u1").astype(bool), read("ends", "<i8")
        self.high = read("high", "<u8").astype(np.uint64)
        self.tokens = _unpacked(row["tokens"], int(self.ends[-1])).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.trained = np.repeat(~self.held, np.diff(np.append(0, self.ends)))
        # A text's first word follows the start, which is numbered behind all words.
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.begins] = len(self.high)

    def words_by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The words in the order they are asked for, and the shard of each."""
        shard = (self.high % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of each run of a sorted column."""
    begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
    yield from zip(shard[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(shard)])


# ---------------------------------------------------------------- exact counts of words


def _asked_words(rows: DataFrame, shards: int) -> DataFrame:
    """Each slice's distinct words, dealt to shards by their hash, with their counts in its learned texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                part, low = Slice(row), np.frombuffer(row["low"], "<u4")
                counts = np.bincount(part.tokens[part.trained], minlength=len(part.high))
                order, shard = part.words_by_shard(shards)
                out = [
                    (s, part.number, _bytes(part.high[order[a:b]], "<u8"), _bytes(low[order[a:b]], "<u4"), _bytes(counts[order[a:b]], "<u4"))
                    for s, a, b in _by_shard(shard)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["shard", "slice", "high", "low", "counts"])

    kept = rows.select("slice", "doc_ids", "held", "ends", "high", "low", "tokens")
    return kept.mapInArrow(work, "shard bigint, slice bigint, high binary, low binary, counts binary")


ANSWER = "slice bigint, kind int, shard bigint, answer binary"


def _joined(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one behind the other, and where each row's end."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _counted_words(asked: DataFrame, hot_count: float) -> DataFrame:
    """The corpus count of every asked word, sent back to its slice; a shard's first row also sums the shard up.

    ``hot`` lists the words of at least ``hot_count``.
    """

    def work(table: pa.Table) -> pa.Table:
        high, ends = _joined(table, "high", "<u8")
        low, counts = _joined(table, "low", "<u4")[0], _joined(table, "counts", "<u4")[0].astype(np.int64)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        answer = np.empty(len(order), np.int64)
        answer[order] = total[np.cumsum(new) - 1]
        hot = total >= hot_count
        n, begins = table.num_rows, [0, *ends[:-1].tolist()]
        first = lambda value, empty: [value] + [empty] * (n - 1)
        return pa.table({
            "slice": table.column("slice"), "kind": pa.array([0] * n, pa.int32()), "shard": table.column("shard"),
            "answer": pa.array([_bytes(answer[a:b], "<i8") for a, b in zip(begins, ends.tolist())], pa.binary()),
            "known": pa.array(first(int((total > 0).sum()), 0), pa.int64()),
            "hot": pa.array(first(_bytes(high[new][hot], "<u8"), b""), pa.binary()),
            "hot_counts": pa.array(first(_bytes(total[hot], "<i8"), b""), pa.binary()),
        })

    return asked.groupBy("shard").applyInArrow(work, ANSWER + ", known bigint, hot binary, hot_counts binary")


# ---------------------------------------------------------------- counts of pairs


@dataclass
class Sharding:
    """Where the pairs of a word stand: all in one shard, or dealt by their second word if the first one is frequent.

    A word of c among N tokens has 1 + c * shards // N parts, so no shard gets
    much more than its share. Only words of at least N / shards have several:
    there are at most ``shards`` of them.
    """

    shards: int
    high: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, shards: int, tokens: int, high: np.ndarray, counts: np.ndarray) -> Sharding:
        order = np.argsort(high)
        return cls(shards, high[order], 1 + counts[order] * shards // max(tokens, 1))

    def n_parts(self, high: np.ndarray) -> np.ndarray:
        if not len(self.high):
            return np.ones(len(high), np.int64)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where(self.high[at] == high, self.parts[at], 1)


_START_HIGH = np.frombuffer(xxhash.xxh3_128_digest(START), ">u8").astype(np.uint64)[:1]


class Pairs:
    """The distinct pairs of neighbours in a slice and the contexts they stand in, both in the order of the shards.

    A context is a first word and one of its parts. ``items`` names a pair
    within its shard, ``context_items`` a context, whose count is the number of
    different words that follow.
    """

    def __init__(self, part: Slice, sharding: Sharding, learned: bool):
        words = len(part.high)
        high = np.append(part.high, _START_HIGH)
        code = part.before * words + part.tokens
        self.codes, self.place = np.unique(code[part.trained] if learned else code, return_inverse=True)
        self.counts = np.bincount(self.place if learned else self.place[part.trained], minlength=len(self.codes))
        first, second = np.divmod(self.codes, words)
        n_parts = sharding.n_parts(high)
        present = np.unique(first)
        sizes = n_parts[present]
        self.first = np.repeat(present, sizes)
        nth = np.arange(len(self.first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        name = mixed(high[self.first] + nth.astype(np.uint64) * _ODD)
        shard = (mixed(name) % np.uint64(sharding.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.first, self.context_shard, self.names = self.first[order], shard[order], (name >> _HALF)[order]
        begin = np.zeros(words + 1, np.int64)
        begin[present] = np.cumsum(sizes) - sizes
        of = rank[begin[first] + (mixed(high[second]) % n_parts[first].astype(np.uint64)).astype(np.int64)]
        self.order = np.argsort(of, kind="stable")
        self.runs = np.bincount(of, minlength=len(self.first))
        self.keys = mixed(mixed(high[second]) + _ODD * high[first])[self.order] >> _HALF
        self.shard = np.repeat(self.context_shard, self.runs)
        self.second = second[self.order]

    def rows(self, number: int) -> list[tuple]:
        """(shard, slice, contexts, runs, keys, counts), a row per shard."""
        counts, ends = self.counts[self.order], np.append(0, np.cumsum(self.runs))
        return [
            (s, number, _bytes(self.names[a:b], "<u4"), _bytes(self.runs[a:b], "<u4"), _bytes(self.keys[ends[a]:ends[b]], "<u4"),
             _bytes(counts[ends[a]:ends[b]], "<u4"))
            for s, a, b in _by_shard(self.context_shard)
        ]


def pair_items(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return names.astype(np.uint64) << _HALF | keys.astype(np.uint64)


def context_items(names: np.ndarray) -> np.ndarray:
    return mixed(names.astype(np.uint64) + _ODD)


def _asked_pairs(rows: DataFrame, sharding: Sharding, learned: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Slice(batch.slice(i, 1).to_pylist()[0])
                if out := Pairs(part, sharding, learned).rows(part.number):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    names = ["shard", "slice", "contexts", "runs", "keys", "counts"]
    kept = rows.select("slice", "doc_ids", "held", "ends", "high", "tokens")
    return kept.mapInArrow(work, "shard bigint, slice bigint, contexts binary, runs binary, keys binary, counts binary")


def _shard_filter(table: pa.Table, entry_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The filter of a shard's pairs and contexts, and what was asked: contexts, pairs, and where each row's end."""
    names, name_ends = _joined(table, "contexts", "<u4")
    runs, (keys, key_ends) = _joined(table, "runs", "<u4")[0], _joined(table, "keys", "<u4")
    asked = pair_items(np.repeat(names, runs), keys)
    counts = _joined(table, "counts", "<u4")[0].astype(np.int64)
    held = counts > 0
    order = np.argsort(asked[held], kind="stable")
    sorted_ = asked[held][order]
    begins = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, int)
    pairs = sorted_[begins]
    times = np.add.reduceat(counts[held][order], begins) if len(begins) else np.zeros(0, np.int64)
    followed, fans = np.unique(pairs >> _HALF, return_counts=True)
    blocks = filled(np.concatenate([pairs, context_items(followed)]), np.concatenate([times, fans]), entry_bits)
    return blocks, context_items(names), name_ends, asked, key_ends


def _filters(asked: DataFrame, entry_bits: int) -> DataFrame:
    """(shard, n_blocks, blocks): the filter's shards, each of a size its share of the tokens bounds."""

    def work(table: pa.Table) -> pa.Table:
        blocks = _shard_filter(table, entry_bits)[0]
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "n_blocks": pa.array([len(blocks)], pa.int64()), "blocks": [_bytes(blocks, "<u4")],
        })

    return asked.groupBy("shard").applyInArrow(work, "shard bigint, n_blocks bigint, blocks binary")


def _answered_pairs(asked: DataFrame, entry_bits: int) -> DataFrame:
    """Levels of the asked contexts and pairs, found where the shards are built and sent back to the slices."""

    def work(table: pa.Table) -> pa.Table:
        blocks, contexts, context_ends, pairs, pair_ends = _shard_filter(table, entry_bits)
        levels = []
        for items in (contexts, pairs):
            levels.append(probed(blocks, np.zeros(len(items), np.int64), np.full(len(items), len(blocks)), items))
        rows, kinds = [], []
        for kind, (found, ends) in enumerate(((levels[0], context_ends), (levels[1], pair_ends)), 1):
            rows += [found[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            kinds += [kind] * table.num_rows
        twice = lambda c: pa.concat_arrays(table.column(c).chunks * 2)
        return pa.table({"slice": twice("slice"), "kind": pa.array(kinds, pa.int32()), "shard": twice("shard"), "answer": pa.array(rows, pa.binary())})

    return asked.groupBy("shard").applyInArrow(work, ANSWER)


class Filter:
    """All shards of a filter, one behind the other."""

    def __init__(self, shards: int, rows: Iterator):
        self.begin, self.size = np.zeros(shards, np.int64), np.ones(shards, np.int64)
        parts, at = [], 0
        for shard, n_blocks, blocks in rows:
            self.begin[shard], self.size[shard] = at, n_blocks
            parts.append(np.frombuffer(blocks, "<u4").reshape(-1, LANES))
            at += n_blocks
        self.blocks = np.concatenate(parts) if parts else np.zeros((1, LANES), np.uint32)

    def levels(self, shard: np.ndarray, items: np.ndarray) -> np.ndarray:
        return probed(self.blocks, self.begin[shard], self.size[shard], items)


# ---------------------------------------------------------------- scores


def _scores(part: Slice, counts: np.ndarray, pairs: Pairs, fans: np.ndarray, follows: np.ndarray, train_tokens: int, train_docs: int,
            known: int) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of a slice's documents.

    ``fans`` are the levels of its contexts, ``follows`` those of its pairs. With
    c(v, w) and the number T(v) of words seen behind v, both read from levels,
    and the exact c(v), a word's probability is (c(v, w) + T(v) * base(w)) /
    (c(v) + T(v)): Witten and Bell's interpolation with the smoothed unigrams.
    """
    base = (counts + 0.5) / (train_tokens + 0.5 * (known + 1))
    seen = np.append(counts, train_docs)
    first, second = np.repeat(pairs.first, pairs.runs), pairs.second
    # A pair is no more frequent than its words; a false positive of an unseen word is known to be one.
    both = np.minimum(VALUES[follows], np.minimum(seen[first], counts[second]))
    fan = np.bincount(pairs.first, weights=VALUES[fans], minlength=len(seen))
    fan = np.where(seen > 0, np.maximum(fan, 1), 1)[first]
    chance = np.log10((both + fan * base[second]) / (seen[first] + fan))
    by_code = np.empty(len(chance))
    by_code[pairs.order] = chance
    alone = np.log10(base)
    sums = lambda values: np.add.reduceat(values, part.begins)
    return [np.diff(np.append(0, part.ends)), sums((counts > 0).astype(np.int64)[part.tokens]), sums(alone[part.tokens]),
            sums(by_code[pairs.place])]


def score_texts(docs: DataFrame, held_out: Column, broadcast_bytes: int = BROADCAST_BYTES, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """log10 probabilities of the texts of ``docs`` (doc_id, text) under a model of those that are not ``held_out``.

    Texts become word numbers once, a few megabytes in a row, and are written.
    Each such slice asks for its distinct words, which are counted by shards of
    their hash (exactly, unless two words agree in 96 bits). Pairs of neighbours are counted the same way and go
    into a log-frequency Bloom filter: a pair of quantised count q is entered
    as (pair, 1) to (pair, q), and so is the number of different words behind a
    word. A count is read by probing until a probe fails; it is never too low.
    The filter's size is known before it is sent: up to ``broadcast_bytes`` it
    goes to all workers, a larger one is probed where its shards stand, and
    the levels go back to the slices, with equal results. A frequent word's
    pairs are dealt to several shards; a word's count costs one key a slice.

    Defined results: a null or empty text is its end alone; a null id or null
    ``held_out`` is learned from; with nothing to learn from every token has
    probability one over one; repeated rows are learned and scored as rows of
    their own; an empty table gives none; other columns are not looked at.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = cut_lineage(slices(docs, held_out))
    n_words, train_tokens, train_docs, n_tokens = (x or 0 for x in rows.agg(*map(F.sum, ("n_words", "train_tokens", "train_docs", "n_tokens"))).first())
    shards, word_shards = max(1, n_tokens // SHARD_TOKENS), max(1, n_words // SHARD_WORDS)
    asked = _asked_words(rows, word_shards)
    counted = cut_lineage(_counted_words(asked, max(1, train_tokens / shards)))
    known = counted.agg(F.sum("known")).first()[0] or 0
    # At most ``shards`` words, one for each million tokens.
    hot = counted.where(F.octet_length("hot") > 0).select("hot", "hot_counts").collect()
    sharding = Sharding.of(
        shards, train_tokens, np.concatenate([np.frombuffer(r.hot, "<u8") for r in hot] + [_START_HIGH]),
        np.concatenate([np.frombuffer(r.hot_counts, "<i8") for r in hot] + [[train_docs]]).astype(np.int64),
    )
    filters = cut_lineage(_filters(_asked_pairs(rows, sharding, True), entry_bits))
    size = 4 * LANES * (filters.agg(F.sum("n_blocks")).first()[0] or 0)
    answers, sent = counted.select("slice", "kind", "shard", "answer"), None
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast(Filter(shards, (tuple(r) for r in filters.toLocalIterator())))
    else:
        answers = answers.unionByName(_answered_pairs(_asked_pairs(rows, sharding, False), entry_bits))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Slice(left.to_pylist()[0])
        given: dict[int, list] = {0: [], 1: [], 2: []}
        for row in right.sort_by("shard").to_pylist():
            given[row["kind"]].append(row["answer"])
        counts = np.empty(len(part.high), np.int64)
        counts[part.words_by_shard(word_shards)[0]] = np.frombuffer(b"".join(given[0]), "<i8")
        pairs = Pairs(part, sharding, False)
        if sent is None:
            fans, follows = (np.frombuffer(b"".join(given[kind]), np.uint8) for kind in (1, 2))
        else:
            fans = sent.value.levels(pairs.context_shard, context_items(pairs.names))
            follows = sent.value.levels(pairs.shard, pair_items(np.repeat(pairs.names, pairs.runs), pairs.keys))
        columns = _scores(part, counts, pairs, fans, follows, train_tokens, train_docs, known)
        n = len(part.ends)
        return pa.table({
            "doc_id": pa.array(part.doc_ids, pa.int64()), "held_out": pa.array(part.held), "n_tokens": pa.array(columns[0], pa.int64()),
            "n_known": pa.array(columns[1], pa.int64()), "train_tokens": pa.array([train_tokens] * n, pa.int64()),
            "base_score": pa.array(columns[2]), "score": pa.array(columns[3]),
        })

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    kept = rows.select("slice", "doc_ids", "held", "ends", "high", "tokens")
    return kept.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, schema)
