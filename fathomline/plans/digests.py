"""Reconciliation by digests: files and rows that agree are neither opened nor compared one by one.

A manifest beside the index says of each file what it was when it was last read
and which row it stands for. Files and rows are counted into buckets; a digest
of a bucket does not depend on the order of its rows. Only buckets whose digests
differ are compared row by row, and only files that differ there are opened.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.operators.encode import Encoder
from fathomline.operators.merge import latest_per_key
from fathomline.plans.ingest import encode_rows, stored_widths
from fathomline.session import cut_lineage
from fathomline.sources.index_table import IndexStore, _file_system
from fathomline.sources.items import list_files, parse_documents, read_bodies, to_index_rows
from fathomline.sources.paths import key_from_path

BUCKETS = 256
MANIFEST_SCHEMA = "path string, modified_at timestamp, n_bytes bigint, item_key bigint, content_hash string, bucket int"
FILE = ("path", "modified_at", "n_bytes")
ROW = ("item_key", "content_hash")


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def digests(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``bucket, digest``: number of rows, and two sums of their hashes that no order changes.

    Tasks add up their own rows first, so one row per task and bucket is shuffled.
    """
    seen = F.xxhash64(*columns)
    again = F.xxhash64(F.lit("again"), *columns)
    digest = F.struct(
        F.count(F.lit(1)).alias("n"), F.sum(seen.cast("decimal(38,0)")).alias("total"), F.bit_xor(again).alias("mixed")
    )
    return rows.groupBy("bucket").agg(digest.alias("digest"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """The buckets whose digests are not the same on both sides; at most as many rows as there are buckets."""
    both = left.join(right.withColumnRenamed("digest", "other"), "bucket", "full_outer")
    return both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("bucket")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What the last run wrote; empty before the first."""
    fs, to_path = _file_system(spark, path)
    if not fs.exists(to_path(path)):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def bucketed_files(spark: SparkSession, directory: str, buckets: int) -> DataFrame:
    """``path, modified_at, n_bytes, bucket`` of the files present; none is opened."""
    return list_files(spark, directory).withColumn("bucket", bucket_of(F.col("path"), buckets))


def read_rows(files: DataFrame) -> DataFrame:
    """Index rows of listed files, read by the tasks that hold their names.

    What cannot be read as a document has no key; a file that vanished since it was listed has ``gone`` set.
    """
    bodies = read_bodies(files.select("path", "modified_at"), max_bytes=None)
    rows = to_index_rows(parse_documents(bodies.drop("problem")))
    return rows.withColumns({
        "gone": F.col("n_bytes").isNull(),
        "content_hash": F.when(F.col("item_key").isNotNull(), F.col("content_hash")),
    })


@dataclass(frozen=True)
class DigestResult:
    """The version written (none if the index was right), the paths opened, the keys dropped, and those whose encoder failed."""

    version: str | None
    opened: DataFrame
    dropped: DataFrame
    failed: DataFrame


def reconcile_digests(
    spark: SparkSession,
    directory: str,
    store: IndexStore,
    encoders: Mapping[str, Encoder | None],
    manifest: str,
    buckets: int = BUCKETS,
) -> DigestResult:
    """Makes the index hold what the directory holds, like ``reconcile``, at the cost of what differs.

    ``manifest`` is a folder of this directory and index; ``buckets`` stays the
    same over its life. A file counts as the same while path, time and size are.
    The index is compared by key and content hash, so a row that another job
    changed, or that failed in its encoder, is put right as well. Of files
    with the same key the latest stands for it; a file that cannot be read keeps
    what is stored under its name. The index is written before the manifest: a
    run that dies between is repeated harmlessly.
    """
    known = read_manifest(spark, manifest)
    listed = cut_lineage(bucketed_files(spark, directory, buckets))
    suspect = cut_lineage(differing(digests(listed, FILE), digests(known, FILE)))
    opened = spark.createDataFrame([], "path string")
    present, renewed, read = known, None, None
    if not suspect.isEmpty():
        renewed, read = _changed_files(listed, known, F.broadcast(suspect))
        present = known.join(F.broadcast(suspect), "bucket", "left_anti").select(*known.columns).unionByName(renewed)
        opened = read.select("path")

    # Rows: what the files stand for against what the index holds, by buckets of keys.
    index = store.read().select("item_key", "content_hash").withColumn("bucket", bucket_of(F.col("item_key"), buckets))
    stands = present.where(F.col("item_key").isNotNull()).withColumn("bucket", bucket_of(F.col("item_key"), buckets))
    off = cut_lineage(differing(digests(stands, ROW), digests(index, ROW)))
    version, dropped, failed = None, index.select("item_key").where("false"), spark.createDataFrame([], "item_key bigint, embed_error string")
    if not off.isEmpty():
        stale, dropped = _stale_rows(present, stands, index, F.broadcast(off), buckets)
        unread = stale if read is None else stale.join(opened, "path", "left_anti")
        if not unread.isEmpty():
            more = cut_lineage(read_rows(unread))
            read = more if read is None else read.unionByName(more)
            opened = read.select("path")
        if not stale.isEmpty():
            rows = read.where(~F.col("gone") & F.col("item_key").isNotNull()).join(stale.select("path"), "path", "left_semi")
            widths = stored_widths(store.read(), [c for c, encoder in encoders.items() if encoder])
            good, failed = encode_rows(latest_per_key(rows.drop("gone", "bad_record")), encoders, widths)
        else:
            good = store.read().where("false")
        if not (good.isEmpty() and dropped.isEmpty()):
            version = store.apply(good, dropped)
    if renewed is not None:
        _write_buckets(spark, renewed, suspect, manifest)
    return DigestResult(version, opened, dropped, failed)


def _changed_files(listed: DataFrame, known: DataFrame, suspect: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest's rows of the ``suspect`` buckets as they are now, and what was read of the files that differ."""
    here, there = listed.join(suspect, "bucket"), known.join(suspect, "bucket")
    read = cut_lineage(read_rows(here.join(there.select(*FILE), list(FILE), "left_anti")))
    # With the size of the listing, so that a file that grew since is opened again.
    fresh = read.where(~F.col("gone")).drop("n_bytes").join(here.select("path", "n_bytes", "bucket"), "path")
    same = there.join(here.select(*FILE), list(FILE), "left_semi")
    return cut_lineage(same.select(*known.columns).unionByName(fresh.select(*known.columns))), read


def _stale_rows(
    present: DataFrame, stands: DataFrame, index: DataFrame, off: DataFrame, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """In the buckets that are ``off``: files whose row the index does not hold, and keys no file stands for."""
    stored = index.join(off, "bucket").drop("bucket")
    wanted = latest_per_key(stands.join(off, "bucket").drop("bucket"))
    stale = cut_lineage(wanted.join(stored, list(ROW), "left_anti").select("path", "modified_at", "item_key"))
    # A file stands for the key in its name and for the one in its document.
    names = F.explode(F.array_distinct(F.array(key_from_path(F.col("path")), F.col("item_key")))).alias("item_key")
    held = present.select(names).where(F.col("item_key").isNotNull())
    held = held.withColumn("bucket", bucket_of(F.col("item_key"), buckets)).join(off, "bucket")
    return stale, cut_lineage(stored.select("item_key").join(held, "item_key", "left_anti"))


def _write_buckets(spark: SparkSession, renewed: DataFrame, suspect: DataFrame, manifest: str) -> None:
    """Puts ``renewed`` in the place of the ``suspect`` buckets of the manifest."""
    emptied = suspect.join(renewed.select("bucket").distinct(), "bucket", "left_anti").collect()
    whole = renewed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    whole.partitionBy("bucket").parquet(manifest)
    # A bucket that lost its last file has no rows to be overwritten by; there are no more of them than buckets.
    fs, to_path = _file_system(spark, manifest)
    for row in emptied:
        fs.delete(to_path(f"{manifest}/bucket={row['bucket']}"), True)
