"""SimHash near-duplicates by BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import merge_labels, text_slices, texts_of
from fathomline.llm.components import components
from fathomline.session import cut_lineage, fits_broadcast

RADIUS = 3
BLOCK = 16  # four blocks: two fingerprints within the radius agree in one of them
SEED = 42
TREE_ROWS = 50_000
SPREAD = 64  # distances are below this, so parent * SPREAD ... parent * SPREAD + 64 are a parent's edges


def fingerprint(text: str) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's three-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z, splits at ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < 3:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(ends[:-3] + 1).tolist()]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[2:].tolist())], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed bigint) of whole texts; a null text is an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                prints = np.array([fingerprint(t) for t in texts_of(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, fingerprint bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees, one for each block value, built together.

    A node's children are keyed by their integer Hamming distance to it. All
    trees grow level by level: whatever stands at a node goes on to the child of
    its distance, and the first to come to an open place becomes the child.
    Edges are kept sorted by parent and distance, so those within a radius of a
    distance are one range.
    """

    def __init__(self, values: np.ndarray, prints: np.ndarray):
        n = len(prints)
        order = np.argsort(values, kind="stable")
        self.values, at = np.unique(values[order], return_index=True)
        self.roots = order[at]
        self.prints = prints
        below = np.setdiff1d(np.arange(n), self.roots)
        parent = self.roots[np.searchsorted(self.values, values[below])]
        keys, nodes = [], []
        while len(below):
            key = parent * SPREAD + np.minimum(distance(prints[below], prints[parent]), SPREAD - 1)
            found, first, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            nodes.append(below[first])
            stay = np.ones(len(below), bool)
            stay[first] = False
            parent, below = below[first][group][stay], below[stay]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], nodes[order]

    def within(self, values: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``prints``, node) at most ``radius`` bits apart, level by level."""
        root = np.searchsorted(self.values, values)
        root = np.minimum(root, len(self.values) - 1)
        asked = np.flatnonzero(self.values[root] == values)
        node = self.roots[root[asked]]
        while len(asked):
            d = distance(prints[asked], self.prints[node])
            near = d <= radius
            yield asked[near], node[near]
            low = np.searchsorted(self.keys, node * SPREAD + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * SPREAD + np.minimum(d + radius, SPREAD - 1), side="right")
            count = high - low
            asked = np.repeat(asked, count)
            edge = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(asked))
            node = self.children[edge]


def _links(tree: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each print that is linked, the smallest one it is joined to through links found here: as many rows at most."""
    forest = Forest(*tree)
    every, place = np.unique(np.concatenate([tree[1], queries[1]]), return_inverse=True)
    of_tree, of_query = place[:len(tree[1])], place[len(tree[1]):]
    label = np.arange(len(every))
    for begin in range(0, len(queries[1]), 2000):
        part = slice(begin, begin + 2000)
        for asked, node in forest.within(queries[0][part], queries[1][part], radius):
            a, b = of_query[part][asked], of_tree[node]
            open_ = label[a] != label[b]
            if open_.any():
                # Earlier links stand in the labels; only these few are merged again.
                label = merge_labels(
                    np.concatenate([np.arange(len(label)), a[open_]]), np.concatenate([label, b[open_]]), len(label)
                )
    joined = np.flatnonzero(label != np.arange(len(label)))
    return every[joined], every[label[joined]]


def near_links(prints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (a, b) that join the distinct values of ``prints`` (fingerprint) at most ``radius`` bits apart.

    Two values that near agree in one of four 16-bit blocks, so a value is
    looked for among those that share a block with it, not among all. Shards
    are ranges of block values of about ``tree_rows`` values; a shard holds the
    BK-trees of its block values, written as one row of bounded size. A shard
    that is overfull, because very many values share a block, is split into
    parts, and each part's trees meet each part's values. Trees go to the
    values as a broadcast if they are measured to be small, otherwise by a
    join. A cell gives each value at most one edge, so a dense group does not
    become all its pairs.
    """
    if radius > 64 // BLOCK - 1:
        raise ValueError("blocks of this width find differences of up to three bits")
    distinct = cut_lineage(prints.select("fingerprint").distinct())
    shards = max(1, distinct.count() // tree_rows)
    block = F.posexplode(F.array(*[
        F.shiftrightunsigned("fingerprint", BLOCK * i).bitwiseAND(F.lit((1 << BLOCK) - 1)) for i in range(64 // BLOCK)
    ])).alias("block", "value")
    blocked = distinct.select("fingerprint", block).select(
        "fingerprint", "value", (F.col("block") * shards + F.pmod(F.xxhash64("value"), F.lit(shards))).cast("bigint").alias("shard")
    )
    # A row per shard; shards grow with the table, each with the values of a tree.
    counts = blocked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(4 * tree_rows)).cast("int").alias("parts"))
    split = blocked.join(F.broadcast(counts) if fits_broadcast(counts) else counts, "shard").withColumn(
        "part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    )

    def bring(table: pa.Table) -> pa.Table:
        rows = [table.column(c).to_numpy() for c in ("value", "fingerprint")]
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "part": table.column("part").slice(0, 1),
            "parts": table.column("parts").slice(0, 1), "block_values": [rows[0].astype("<i8").tobytes()],
            "prints": [rows[1].astype("<i8").tobytes()],
        })

    held = cut_lineage(split.groupBy("shard", "part").applyInArrow(
        bring, "shard bigint, part int, parts int, block_values binary, prints binary"
    ))
    asked = held.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("part"),
        F.col("block_values").alias("asked_values"), F.col("prints").alias("asked_prints"),
    )
    trees = held.drop("parts")
    cells = asked.join(F.broadcast(trees) if fits_broadcast(trees) else trees, ["shard", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda name, kind: np.frombuffer(row[name], "<i8").astype(np.int64).view(kind)
                a, b = _links(
                    (read("block_values", np.int64), read("prints", np.uint64)),
                    (read("asked_values", np.int64), read("asked_prints", np.uint64)), radius,
                )
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    spread = cells.repartition(max(cells.sparkSession.sparkContext.defaultParallelism, shards))
    return spread.mapInArrow(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """The fingerprint and the near-duplicate group of every row of ``docs`` (doc_id, text).

    A group is named by its smallest doc_id. Texts are read once; from then on
    only fingerprints are moved, those of equal texts folded first.

    Defined results: a null or empty text has fingerprint zero and is linked like
    any other; a row without an id belongs to its fingerprint's group, whose
    name is null if no row of it has an id; repeated rows are rows of their own;
    an empty table gives none; other columns are not looked at.
    Returns doc_id, fingerprint (16 lower-case hex digits), component_id.
    """
    rows = cut_lineage(fingerprints(docs))
    joined = components(near_links(rows))
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = cut_lineage(least.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    ))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # Fingerprints that stand alone name their own group; only the others need the join.
    grouped = rooted.join(named.where("n > 1").select("root", "component_id"), "root", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id")
    )
    return rows.join(grouped, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
