"""The index table as versioned Parquet folders."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathomline.operators.merge import latest_per_key, merge_delete, merge_upsert
from fathomline.schemas import INDEX_SCHEMA
from fathomline.session import cut_lineage, fits_broadcast, hadoop_file_system as _file_system


def upgrade_schema(df: DataFrame, target: T.StructType = INDEX_SCHEMA) -> DataFrame:
    """``df`` in the target's columns and types; absent columns become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def union_versions(*tables: DataFrame) -> DataFrame:
    """Tables of different schema versions on top of each other."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged


def write_index(df: DataFrame, path: str, sort_by: Sequence[str] = ("atk",), files: int | None = None) -> None:
    """Writes ``df`` range-partitioned and sorted, so filters skip row groups.

    Equal leading values are split further by the following columns; put a key
    last where one value is very frequent.
    """
    order = [F.col(c) for c in sort_by]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


# The columns that filters name.
FILTERED = ("atk", "def_", "level", "english_attribute")
LAYOUT_BITS = 5
LAYOUT_SAMPLE = 20_000


def splitters(df: DataFrame, columns: Sequence[str], bits: int = LAYOUT_BITS, sample: int = LAYOUT_SAMPLE) -> dict[str, dict]:
    """Values that cut each column into ranges of about equal numbers of rows, with the number of the range each begins.

    They come from a sample of at most about ``sample`` rows; they decide where
    rows are written, and nothing else. A value that very many rows share is one
    range, and the numbers it would have taken are left out.
    """
    rows = df.select(*columns)
    share = min(1.0, sample / max(rows.count(), 1))
    drawn = rows.sample(share, 1).limit(2 * sample).collect()
    out = {}
    for column in columns:
        values = sorted(r[column] for r in drawn if r[column] is not None)
        cuts: dict = {}
        for i in range(1, 1 << bits):
            if values:
                cuts.setdefault(values[len(values) * i // (1 << bits)], i)
        out[column] = cuts
    return out


def z_order(cuts: dict[str, dict], bits: int = LAYOUT_BITS) -> Column:
    """A number whose bits are those of the columns' ranges in turn; NULL counts as the lowest range.

    Rows near each other in this order are near in every column, so a group of
    rows spans a small part of each.
    """
    total = F.lit(0).cast("bigint")
    for place, (column, values) in enumerate(cuts.items()):
        rank = F.lit(0).cast("bigint")
        if values:
            below = F.size(F.filter(F.array(*map(F.lit, values)), lambda cut: cut <= F.col(column)))
            numbers = F.array(F.lit(0), *map(F.lit, values.values()))
            rank = F.when(F.col(column).isNull(), 0).otherwise(F.element_at(numbers, below + 1)).cast("bigint")
        for bit in range(bits):
            total = total.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), bit * len(cuts) + place))
    return total


def write_clustered(
    df: DataFrame, path: str, columns: Sequence[str] = FILTERED, key: str = "item_key", files: int | None = None
) -> None:
    """Writes ``df`` in Z-order of ``columns``, so that a filter on any one of them skips row groups.

    ``key`` comes last in the order, so that equal rows still spread over files.
    """
    placed = df.withColumn("__z", z_order(splitters(df, columns)))
    ranged = placed.repartitionByRange(files, "__z", key) if files else placed.repartitionByRange("__z", key)
    ranged.sortWithinPartitions("__z", key).drop("__z").write.mode("overwrite").parquet(path)


# The writer of jobs that run once. A stream brings a name of its own, because it numbers its batches itself.
JOB = "job"


class Version(NamedTuple):
    number: int
    writer: str
    batch: int
    full: bool
    path: str


class IndexStore:
    """The index under one root: full snapshots, and changes written after them.

    A batch of changes costs what it changes: its rows are written beside the
    snapshot, and a read lays them over it. After ``compact_after`` such batches
    the next one writes a full snapshot again.

    A folder counts once Spark has marked it finished, so a job that fails leaves
    nothing a reader sees. Each writer numbers its own batches, and writes each
    once: a retried stream batch is harmless, and neither an ingest nor another
    stream takes a stream's number away. Older versions stay readable.

    With ``cluster_by``, full snapshots are written in Z-order of these columns,
    in about ``files`` files, so that filters on a read skip most of them.
    """

    def __init__(
        self, spark: SparkSession, root: str, compact_after: int = 16, cluster_by: Sequence[str] = (), files: int | None = None
    ):
        self.spark = spark
        self.root = root
        self.compact_after = compact_after
        self.cluster_by = cluster_by
        self.files = files

    def _folders(self) -> list[Version]:
        """All versions, finished or not, oldest first: one listing."""
        fs, path = _file_system(self.spark, self.root)
        base = path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        found = [re.fullmatch(r"(full|change)-(\d+)-(\w+)-batch(\d+)", name) for name in names]
        return sorted(
            Version(int(m[2]), m[3], int(m[4]), m[1] == "full", posixpath.join(self.root, m[0])) for m in found if m
        )

    def _finished(self, version: Version) -> bool:
        fs, path = _file_system(self.spark, self.root)
        return fs.exists(path(posixpath.join(version.path, "_SUCCESS")))

    def versions(self) -> list[Version]:
        """Finished versions, oldest first."""
        return [v for v in self._folders() if self._finished(v)]

    def _current(self) -> tuple[Version | None, list[Version]]:
        """The latest full snapshot and the changes since; older folders are not looked into."""
        changes: list[Version] = []
        for version in reversed(self._folders()):
            if self._finished(version):
                if version.full:
                    return version, changes[::-1]
                changes.append(version)
        return None, changes[::-1]

    def read(self) -> DataFrame:
        """The index as of now, in the current schema; empty if nothing was written."""
        full, changes = self._current()
        base = self.spark.read.parquet(full.path) if full else self.spark.createDataFrame([], INDEX_SCHEMA)
        base = upgrade_schema(base)
        if not changes:
            return base
        rows = [
            self.spark.read.parquet(v.path).withColumn("__version", F.lit(v.number)) for v in changes
        ]
        last = latest_per_key(union_versions(*rows), "item_key", ["__version"])
        untouched = base.join(last.select("item_key"), "item_key", "left_anti")
        return untouched.select(*base.columns).unionByName(upgrade_schema(last.where(~F.col("deleted"))))

    def published(self, batch_id: int, writer: str = JOB) -> bool:
        return any(self._finished(v) for v in self._folders() if (v.writer, v.batch) == (writer, batch_id))

    def _next(self, kind: str, batch_id: int | None, writer: str) -> str | None:
        if batch_id is not None and self.published(batch_id, writer):
            return None
        folders = self._folders()
        if batch_id is None:
            batch_id = max((v.batch for v in folders if v.writer == writer), default=-1) + 1
        number = max((v.number for v in folders), default=0) + 1
        return posixpath.join(self.root, f"{kind}-{number:08d}-{writer}-batch{batch_id}")

    def publish(self, df: DataFrame, batch_id: int | None = None, writer: str = JOB) -> str | None:
        """Writes ``df`` as a full snapshot; the version read before stays intact."""
        path = self._next("full", batch_id, writer)
        if path and self.cluster_by:
            # Sampled, then written: what ``df`` costs is paid once.
            write_clustered(cut_lineage(upgrade_schema(df)), path, self.cluster_by, files=self.files)
        elif path:
            upgrade_schema(df).write.mode("overwrite").parquet(path)
        return path

    def apply(
        self, upserts: DataFrame, deletes: DataFrame | None = None, batch_id: int | None = None, writer: str = JOB
    ) -> str | None:
        """Deletes, then upserts by key; both tables hold a key once.

        Vectors an upsert leaves out are taken from the stored row.
        """
        if batch_id is not None and self.published(batch_id, writer):
            return None
        index = self.read()
        remaining = index if deletes is None else merge_delete(index, deletes)
        small = fits_broadcast(upserts)
        if not small or len(self._current()[1]) >= self.compact_after:
            return self.publish(merge_upsert(remaining, upserts, small=small), batch_id, writer)
        wanted = F.broadcast(upserts.select("item_key"))
        # No more rows than there are upserts.
        stored = remaining.join(wanted, "item_key", "left_semi")
        known = merge_upsert(stored, upserts, small=True).withColumn("deleted", F.lit(False))
        if deletes is not None:
            gone = deletes.select("item_key").distinct().join(wanted, "item_key", "left_anti")
            known = known.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        path = self._next("change", batch_id, writer)
        if path:
            known.write.mode("overwrite").parquet(path)
        return path


def existing_hashes(index: DataFrame) -> DataFrame:
    """The two columns the skip needs; the scan reads no others."""
    return index.select("item_key", "content_hash")
