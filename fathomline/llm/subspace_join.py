"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import join_measured, merge_labels, read_rows, written
from fathomline.llm.components import components
from fathomline.llm.pivot_search import usable
from fathomline.session import cut_lineage

COSINE = 0.95
BLOCK_DIMS = 16
LEAF_ROWS = 8192
SAMPLE = 4096
SLACK = 1e-5  # room for single precision in what only narrows the search
PAIRS_AT_ONCE = 100_000
MOST_TASKS = 10_000


def rotation(dims: int) -> np.ndarray:
    """A rotation of ``dims`` dimensions, the same in every task."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def blocks_of(dims: int) -> list[slice]:
    """The dimensions in blocks of about ``BLOCK_DIMS``."""
    edges = np.linspace(0, dims, max(1, round(dims / BLOCK_DIMS)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def budgets(dims: int, cosine: float) -> list[float]:
    """The squared distance of unit vectors with that cosine, shared out by the dimensions of the blocks.

    If every block were over its share, the whole distance would be too large.
    """
    return [(2 - 2 * cosine) * (b.stop - b.start) / dims for b in blocks_of(dims)]


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated, in single precision: stored digits, so that every task sees the same."""
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(axis=1)[:, None]
    wide = wide / scale
    wide /= np.sqrt((wide * wide).sum(axis=1))[:, None]
    return (wide @ rotation(wide.shape[1])).astype(np.float32)


class Splits:
    """Halving planes: each cell is cut at the median of its widest coordinate, as learned from a sample."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        cells = [np.arange(len(sample))]
        for _ in range(levels):
            axis, cut, following = [], [], []
            for rows in cells:
                points = sample[rows]
                i = int(points.var(axis=0).argmax()) if len(rows) else 0
                m = float(np.median(points[:, i])) if len(rows) else 0.0
                axis.append(i)
                cut.append(m)
                following += [rows[points[:, i] < m], rows[points[:, i] >= m]] if len(rows) else [rows, rows]
            self.levels.append((np.array(axis), np.array(cut)))
            cells = following

    def leaf(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int64)
        for axis, cut in self.levels:
            cell = 2 * cell + (points[np.arange(len(points)), axis[cell]] >= cut[cell])
        return cell


def _links(x: dict, y: dict, same: bool, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, smallest class it is joined to here, rows it is linked to) of two leaves of one block.

    A pair counts in the first block whose share it keeps within, so it is
    counted once in all; its cosine is then taken in double precision from the
    vectors as given.
    """
    dims = x["vectors"].shape[1]
    cuts, shares = blocks_of(dims), budgets(dims, cosine)
    a, b = rotated(x["vectors"]), rotated(y["vectors"])
    pa_, pb = a[:, cuts[block]], b[:, cuts[block]]
    # One product gives all squared distances: of (p, |p|^2, 1) and (-2 q, 1, |q|^2).
    one = lambda n: np.ones((n, 1), np.float32)
    square = lambda m: (m * m).sum(axis=1)[:, None]
    left = np.hstack([pa_, square(pa_), one(len(pa_))])
    right = np.ascontiguousarray(np.hstack([-2 * pb, one(len(pb)), square(pb)]).T)
    wide = x["vectors"].astype(np.float64), y["vectors"].astype(np.float64)
    norms = [np.sqrt((w * w).sum(axis=1)) for w in wide]
    every, place = np.unique(np.concatenate([x["ids"], y["ids"]]), return_inverse=True)
    of_x, of_y = place[:len(a)], place[len(a):]
    label, links = np.arange(len(every)), np.zeros(len(every), np.int64)
    for begin in range(0, len(a), 128):
        near = np.flatnonzero(left[begin:begin + 128] @ right <= np.float32(shares[block] + 10 * SLACK))
        i, j = np.divmod(near, len(pb))
        i = i + begin
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), PAIRS_AT_ONCE):
            p, q = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
            gap = (a[p].astype(np.float64) - b[q]) ** 2
            within = np.stack([gap[:, c].sum(axis=1) <= s + SLACK for c, s in zip(cuts, shares)], axis=1)
            mine = within[:, block] & (within.argmax(axis=1) == block)
            p, q = p[mine], q[mine]
            linked = np.einsum("ij,ij->i", wide[0][p], wide[1][q]) >= cosine * norms[0][p] * norms[1][q]
            p, q = p[linked], q[linked]
            np.add.at(links, of_x[p], y["rows"][q])
            np.add.at(links, of_y[q], x["rows"][p])
            if (label[of_x[p]] != label[of_y[q]]).any():
                label = merge_labels(
                    np.concatenate([np.arange(len(label)), of_x[p]]), np.concatenate([label, of_y[q]]), len(label)
                )
    found = np.flatnonzero(links)
    return every[found], every[label[found]], links[found]


def _boxes(files: list[str]) -> dict[tuple[int, int], tuple[list, np.ndarray, np.ndarray]]:
    """For each (dims, block), its cells in order and the corners of their boxes."""
    rows: dict[tuple[int, int], list] = {}
    for file in files:
        for r in read_rows(file).to_pylist():
            rows.setdefault((r["dims"], r["block"]), []).append(((r["leaf"], r["part"]), r["low"], r["high"]))
    return {
        key: ([c for c, _, _ in held], np.array([low for _, low, _ in held]), np.array([high for _, _, high in held]))
        for key, held in ((key, sorted(held)) for key, held in rows.items())
    }


def _partners(mine: int, n: int) -> list[int]:
    """The cells that cell ``mine`` of ``n`` is compared with: itself and half of the others, so that each pair is met once."""
    half = [(mine + step) % n for step in range((n + 1) // 2)]
    return half + [mine + n // 2] * (n % 2 == 0 and mine < n // 2)


def near_vectors(rows: DataFrame, cosine: float = COSINE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links and groups of the vectors of ``rows`` (vec_id, embedding) whose cosine is at least ``cosine``.

    Equal vectors are folded into classes. Unit vectors are rotated and split
    into blocks of about 16 dimensions; a pair that near is within its share of
    the squared distance in one block at least. In each block, cells learned
    from a bounded sample hold about ``leaf_rows`` classes, one row of bounded
    size each in a file of its own; an overfull cell is split by hash. A task
    takes a cell, leaves out the cells whose boxes are farther away than the
    block's share, and reads the others one by one: vectors are shuffled once,
    into their cells. What is within the share is verified there. A pair of
    cells hands on one row for a class, so dense groups do not become all their
    pairs. How many cells the boxes rule out depends on the data and its size:
    README has figures.

    Defined results: vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of different lengths, are not linked;
    equal vectors are; repeated rows and rows with one id are rows of their own;
    a row without an id is linked but names no group (component_id is null if
    no row of its group has an id); an empty table gives none; other columns
    are not looked at.
    Returns vec_id, n_links, component_id, kept.
    """
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    kind, digits = ("float", "<f4") if kind == "float" else ("double", "<f8")
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    good = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    classes = cut_lineage(given.where(good).groupBy("embedding").agg(
        F.count("*").alias("rows"), F.min("vec_id").alias("least")
    ).withColumn("class", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("embedding")).count().collect()}
    splits: dict[int, list[Splits]] = {}
    for dims, count in sizes.items():
        sample = classes.where(F.size("embedding") == dims).orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding")
        points = rotated(np.array([r[0] for r in sample.collect()], digits))
        levels = max(0, int(np.ceil(np.log2(count / leaf_rows))))
        splits[dims] = [Splits(points[:, b], levels) for b in blocks_of(dims)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            lengths = pa.compute.list_value_length(lists).to_numpy()
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                vectors = part.column("embedding").flatten().to_numpy().reshape(-1, dims)
                turned = rotated(vectors)
                for i, (cut, split) in enumerate(zip(blocks_of(dims), splits[dims])):
                    n = len(vectors)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, i, np.int32)), pa.array(split.leaf(turned[:, cut])),
                         part.column("class"), part.column("rows"), part.column("embedding")],
                        names=["dims", "block", "leaf", "class", "rows", "embedding"],
                    )

    dealt = classes.select("class", "rows", "embedding").mapInArrow(
        deal, f"dims int, block int, leaf bigint, class bigint, rows bigint, embedding array<{kind}>"
    )
    counts = dealt.groupBy("dims", "block", "leaf").agg(F.ceil(F.count("*") / F.lit(2 * leaf_rows)).cast("int").alias("parts"))
    split_up = join_measured(dealt, counts, ["dims", "block", "leaf"]).withColumn(
        "part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    )

    def bring(table: pa.Table) -> pa.Table:
        dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        points = rotated(vectors)[:, blocks_of(dims)[block]].astype(np.float64)
        numbers = lambda name: table.column(name).to_numpy().astype("<i8").tobytes()
        return pa.table({
            "dims": pa.array([dims], pa.int32()), "block": pa.array([block], pa.int32()), "leaf": table.column("leaf").slice(0, 1),
            "part": table.column("part").slice(0, 1), "low": [points.min(axis=0).tolist()], "high": [points.max(axis=0).tolist()],
            "ids": [numbers("class")], "rows": [numbers("rows")], "vectors": [vectors.astype(digits).tobytes()],
        })

    schema = "dims int, block int, leaf bigint, part int, low array<double>, high array<double>, ids binary, rows binary, vectors binary"
    folder = written(split_up.groupBy("dims", "block", "leaf", "part").applyInArrow(bring, schema), "dims", "block", "leaf", "part")
    cells = spark.read.schema(schema).parquet(folder)
    # A box per cell, without its vectors: small files that every task reads.
    files = cut_lineage(cells.select("dims", "block", "leaf", "part", "low", "high")).inputFiles()

    def held(dims: int, block: int, leaf: int, part: int) -> dict:
        table = read_rows(f"{folder}/dims={dims}/block={block}/leaf={leaf}/part={part}", ["ids", "rows", "vectors"])
        row = table.to_pylist()[0]
        return {
            "ids": np.frombuffer(row["ids"], "<i8"), "rows": np.frombuffer(row["rows"], "<i8"),
            "vectors": np.frombuffer(row["vectors"], digits).reshape(-1, dims),
        }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = None
        for batch in batches:
            for dims, block, leaf, part in zip(*(c.to_pylist() for c in batch.columns)):
                boxes = boxes or _boxes(files)
                names, low, high = boxes[dims, block]
                mine = names.index((leaf, part))
                gap = np.maximum(np.maximum(low[mine] - high, low - high[mine]), 0)
                near = (gap * gap).sum(axis=1) <= budgets(dims, cosine)[block] + SLACK
                x = held(dims, block, leaf, part)
                for other in _partners(mine, len(names)):
                    if near[other]:
                        y = x if other == mine else held(dims, block, *names[other])
                        found = _links(x, y, other == mine, block, cosine)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["class", "root", "links"])

    # A cell a task: the cells it meets are read where they are written.
    jobs = cells.select("dims", "block", "leaf", "part")
    tiles = jobs.repartition(max(1, min(jobs.count(), MOST_TASKS)))
    links = cut_lineage(tiles.mapInArrow(compare, "class bigint, root bigint, links bigint"))
    joined = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(linked, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left").select(
        "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")
    )
    known = cut_lineage(known)
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    full = known.join(named, "root").select(F.col("embedding").alias("vector"), "n_links", "component_id")
    # Only usable vectors are joined: the others, however many, stay where they are.
    whole = given.where(good).join(full, F.col("embedding") == F.col("vector")).select("vec_id", "n_links", "component_id")
    alone = given.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
