"""Small helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.session import checkpoint_dir, cut_lineage, file_system, fits_broadcast

# A word: anything but a blank or one of the five ASCII control blanks. ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *by: str) -> str:
    """The folder in the shared place that ``df`` is written to, with a folder for each value of ``by``; removed when the application ends."""
    spark = df.sparkSession
    path = posixpath.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def read_rows(path: str, columns: list[str] | None = None) -> pa.Table:
    """What a task needs of a written file, or of the files of a written folder."""
    store, name = file_system(path)
    return pq.read_table(name, columns=columns, filesystem=store, partitioning=None)


def as_written(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain read of files, whose rows come in the same order each time; otherwise written and read back."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return df if steps <= {"Project", "Filter", "Relation"} else cut_lineage(df)


def join_measured(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which is sent to every task only if it is measured to be small."""
    return left.join(F.broadcast(right) if fits_broadcast(right) else right, on, how)


ROW = "__row"


def row_column(docs: DataFrame) -> str:
    """The column ``numbered`` adds: ``ROW``, or longer where the table has that."""
    name = ROW
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a number of each row's own, in the order of doc_id (null last), then of a hash of the text.

    Ids that are counted to be unique and not null are the numbers. Otherwise
    the rows are sorted and written with their numbers, so that these stay the
    same whatever reads them.
    """
    key, name = F.col("doc_id").cast("bigint"), row_column(docs)
    if not docs.groupBy(key.alias("id")).count().where("count > 1 or id is null").limit(1).count():
        return docs.withColumn(name, key)
    # The last key deals out equal rows.
    order = [F.asc_nulls_last(key), F.xxhash64("text"), F.col("__from")]
    dealt = docs.withColumn("__from", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.drop("__from").withColumn(name, F.monotonically_increasing_id()))


def give_back() -> None:
    """Memory that is no longer used goes back to the machine: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``max_bytes`` of text, or one row where a text is longer."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, base + max_bytes, side="right")), begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return ["" if text is None else text for text in batch.column(column).to_pylist()]


def merge_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 joined by edges a-b, the smallest node each is joined to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # follow labels to their own labels
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


__all__ = [
    "ROW", "WORD", "as_written", "cut_lineage", "file_system", "fits_broadcast", "join_measured", "merge_labels", "numbered", "read_rows", "row_column",
    "table", "text_slices", "texts_of", "written",
]
