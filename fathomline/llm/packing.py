"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fathomline.llm.common import text_slices
from fathomline.session import cut_lineage

LENGTH = 1024
END = 0  # the id put behind each document
DIMENSIONS = 4
BITS = 15  # of the curve's key, per dimension
UNITS = 150_000  # encoded units a task remembers
SLICE_BYTES = 1_500_000  # of texts encoded at once; what a task holds for them is many times more
SPECIAL = "<|endoftext|>"
# A blank whose neighbours are no blanks starts a unit of its own; texts with other uses of blanks are encoded whole.
IRREGULAR = r"^ |[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
TOKENS_PER_PARTITION = 4_000_000


class Encoder:
    """Ids of whole texts under a byte-level BPE vocabulary.

    Under its pattern no token reaches from a non-blank into a following blank,
    so a text can be cut there and each distinct unit be encoded once. The
    vocabulary file is read in each task from its place on the worker.
    """

    def __init__(self, path: str):
        self.path, self.loaded = path, None
        self.known: dict[str, int] = {}
        # Of the remembered units: their ids one behind the other, and how many each has.
        self.flat, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        self.fast = self._fast(path)
        if self.size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")

    @property
    def whole(self):
        """The vocabulary as the file states it, read when a text has to be encoded whole."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def size(self) -> int:
        return self.fast.n_vocab if self.fast else self.whole.get_vocab_size()

    @staticmethod
    def _fast(path: str):
        """The same vocabulary in a library that encodes short units faster, where its file of ranks lies beside."""
        import base64
        from pathlib import Path

        import tiktoken
        from public_tokenizers import PATTERN

        ranks = Path(path).with_suffix(".tiktoken")
        if not ranks.exists():
            return None
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
        return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different units one behind the other, how many each unit has, and the place of each of ``words`` among the units.

        Units are remembered between calls until there are too many; then what
        is not among them is encoded with each call.
        """
        known = self.known
        fresh = [w for w in words if w not in known]
        made = list(map(self.fast.encode_ordinary, fresh)) if self.fast else self.ids_whole(fresh)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.uint16, int(sizes.sum()))
        flat, sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        places = dict(zip(fresh, range(len(known), len(known) + len(fresh))))
        at = np.fromiter((known[w] if w in known else places[w] for w in words), np.int64, len(words))
        if len(known) + len(fresh) <= UNITS:
            known.update(places)
            self.flat, self.sizes = flat, sizes
        return flat, sizes, at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts`` one behind the other, and where each text's ids begin and the last one's end."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.match_substring(texts, SPECIAL))
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = split.flatten()
        leading = np.zeros(len(words), bool)
        leading[offsets[:-1]] = True
        # Units after the first of a text begin with the blank before them.
        units = pc.binary_join_element_wise(pc.if_else(pa.array(leading), "", " "), words, "").dictionary_encode()
        flat, sizes, places = self.units(units.dictionary.to_pylist())
        at = places[units.indices.to_numpy()]
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(flat))
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes[at])])[offsets]
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            given = dict(zip(rows.tolist(), self.ids_whole(texts.take(pa.array(rows)).to_pylist())))
            parts = [np.array(given[i], np.uint16) if i in given else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds


def with_end(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``END`` behind each text."""
    out = np.full(len(ids) + len(bounds) - 1, END, np.uint16)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out[at] = ids
    return out, bounds + np.arange(len(bounds))


def directions(size: int = 1 << 16, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A direction of the projection for each id, the same in every task."""
    return np.random.default_rng(20).standard_normal((size, dimensions)).astype(np.float32)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, row, n_ids, ids, p0, p1, ...): ids as little-endian 16-bit numbers, and the projected id counts.

    A document's vector holds the share of each id among its ids; its
    projection is the mean of the ids' directions. The 16 bits are the
    vocabulary's bound, checked here.
    """
    names = [f"p{i}" for i in range(DIMENSIONS)]
    schema = "doc_id bigint, row bigint, n_ids int, ids binary, " + ", ".join(f"{n} float" for n in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(vocabulary), directions()
        for batch in batches:
            for part in text_slices(batch, max_bytes=SLICE_BYTES):
                ids, bounds = with_end(*encoder.encode(part.column("text")))
                sizes = np.diff(bounds)
                sums = np.add.reduceat(table[ids], bounds[:-1], axis=0)
                sums /= sizes[:, None]
                offsets = pa.py_buffer((bounds * 2).astype(np.int32))
                blob = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(sizes.astype(np.int32)), blob]
                    + [pa.array(sums[:, i]) for i in range(DIMENSIONS)],
                    names=["doc_id", "row", "n_ids", "ids", *names],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(work, schema)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points whose coordinates (a column each) have ``bits`` bits.

    Works on all points at once: each bit plane is reflected and exchanged with
    the first axis from the top down, then the axes are Gray-coded and their
    bits interleaved.
    """
    axes = [cells[:, i].astype(np.uint64).copy() for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        top, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            flip = (axes[i] & top) != 0
            swap = np.where(flip, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        top = one << np.uint64(level)
        turn = np.where((axes[-1] & top) != 0, turn ^ (top - one), turn)
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ turn) >> np.uint64(level)) & one)
    return key.astype(np.int64)


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, partition_tokens: int = TOKENS_PER_PARTITION,
                   with_ids: bool = False) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``length`` ids.

    Documents are projected to four dimensions, scaled by the mean and spread
    of all documents, range-sorted by their place on a Hilbert curve through
    that space (and by row, so that copies, however many, spread over ranges),
    and laid end to end along it. Each range is cut every ``length`` ids; its
    last sequence alone can be short, one in some thousands. Texts are encoded
    once; their ids are written, and moved once.

    Defined results: a null or empty text is the end id alone; null and repeated
    ids are documents of their own; an empty table gives none; other columns are
    not looked at.
    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` its ids as 16-bit numbers.
    """
    names = [f"p{i}" for i in range(DIMENSIONS)]
    rows = cut_lineage(encoded(docs, vocabulary))
    stats = rows.agg(F.sum("n_ids"), *[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
    centre = [stats[1 + 2 * i] or 0.0 for i in range(DIMENSIONS)]
    spread = [stats[2 + 2 * i] or 1.0 for i in range(DIMENSIONS)]
    partitions = max(1, -(-(stats[0] or 0) // partition_tokens))

    @F.pandas_udf("bigint")
    def place(points: pd.DataFrame) -> pd.Series:
        z = np.clip((points.to_numpy(np.float64) - centre) / spread, -4, 4)
        return pd.Series(hilbert_key(((z + 4) / 8 * ((1 << BITS) - 1)).astype(np.int64)))

    thin = rows.select("doc_id", "row", "ids", place(F.struct(*names)).alias("place"))
    ordered = thin.repartitionByRange(partitions, "place", "row").sortWithinPartitions("place", "row")
    schema = (
        "part int, nth bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "offset bigint" + ", ids binary" * with_ids
    )
    numbers = ("nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, blobs = {name: [] for name in numbers}, []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                tokens, start = len(ids) // 2, 0
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                while start < tokens:
                    take = min(length - filled % length, tokens - start)
                    for name, value in (
                        ("nth", filled // length), ("doc_id", doc_id), ("start", start), ("length", take),
                        ("ids_crc32", zlib.crc32(memoryview(wide)[4 * start:4 * (start + take)])), ("doc_tokens", tokens),
                        ("offset", filled % length),
                    ):
                        out[name].append(value)
                    if with_ids:
                        blobs.append(ids[2 * start:2 * (start + take)])
                    start += take
                    filled += take
            columns = {"part": pa.array([part] * len(out["nth"]), pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(blobs, pa.binary())} if with_ids else {}))

    pieces = cut_lineage(ordered.mapInArrow(lay, schema))
    # A row per range: bounded by the number of partitions, sent to all tasks.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("part").agg((F.max("nth") + 1).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    return pieces.join(F.broadcast(bases), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), "offset",
        *["ids"] * with_ids,
    )
