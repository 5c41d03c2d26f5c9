"""Keyed changes of the index table: skip, dedupe, upsert, delete, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fathomline.schemas import VECTOR_COLUMNS
from fathomline.session import fits_broadcast


def reject_missing_key(df: DataFrame, key: str = "item_key") -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a key."""
    return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())


def changed_rows(
    source: DataFrame,
    index: DataFrame,
    key: str = "item_key",
    hash_col: str = "content_hash",
    require_vectors: Sequence[str] = (),
) -> DataFrame:
    """Source rows that are not stored unchanged.

    A stored NULL hash equals nothing, so such rows are processed again, and so
    are source rows without a key. ``require_vectors`` also treats a stored row
    as stale when one of those columns is NULL.
    """
    stored = index.where(F.col(hash_col).isNotNull() & F.col(key).isNotNull())
    for column in require_vectors:
        stored = stored.where(F.col(column).isNotNull())
    keyed, keyless = reject_missing_key(source, key)
    # Rows without a key match nothing; kept out of the join they do not pile up in one task.
    return keyed.join(stored.select(key, hash_col), [key, hash_col], "left_anti").select(*source.columns).union(
        keyless
    )


def latest_per_key(
    df: DataFrame, key: str = "item_key", order: Sequence[str] = ("modified_at", "path")
) -> DataFrame:
    """The last row of each key; Spark keeps one row per key and task before the shuffle."""
    window = W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__place", F.row_number().over(window)).where(F.col("__place") <= 1).drop("__place")


def merge_upsert(
    index: DataFrame,
    changes: DataFrame,
    key: str = "item_key",
    keep_if_null: Sequence[str] = VECTOR_COLUMNS,
    small: bool | None = None,
) -> DataFrame:
    """The index after inserting or overwriting by key.

    Every field of a change replaces the stored one, also by NULL; only the
    ``keep_if_null`` columns keep the stored value where the change has none.
    Both tables hold one row per key. A change table of checked size is sent to
    the index, which then is not shuffled; a larger one meets it in one full
    outer join.
    """
    keep = set(keep_if_null)
    columns = [c for c in index.columns if c != key]
    if small is None:
        small = fits_broadcast(changes)
    change = F.struct(*[F.col(c).alias(c) for c in columns]).alias("__new")
    incoming = changes.select(F.col(key), change)

    def merged(stored: DataFrame) -> DataFrame:
        fields = []
        for c in columns:
            new, old = F.col(f"__new.{c}"), F.col(c)
            fields.append(
                F.when(F.col("__new").isNull(), old).otherwise(F.coalesce(new, old) if c in keep else new).alias(c)
            )
        return stored.select(key, *fields).select(*index.columns)

    if not small:
        return merged(index.join(incoming, key, "full_outer"))
    overwritten = merged(index.join(F.broadcast(incoming), key, "left"))
    # Keys of the change table that are stored; no more rows than that table has.
    present = index.select(key).join(F.broadcast(changes.select(key)), key, "left_semi")
    inserted = changes.join(F.broadcast(present), key, "left_anti").select(*index.columns)
    return overwritten.unionByName(inserted)


def merge_delete(index: DataFrame, tombstones: DataFrame, key: str = "item_key") -> DataFrame:
    """The index without the keys of ``tombstones``."""
    gone = tombstones.select(key).distinct()
    # A small table of keys is sent to the index, whose vectors then stay where they are.
    return index.join(F.broadcast(gone) if fits_broadcast(gone) else gone, key, "left_anti").select(*index.columns)


def missing_tombstones(index: DataFrame, tombstones: DataFrame, key: str = "item_key") -> DataFrame:
    """Keys that were to be deleted but are not stored."""
    return tombstones.select(key).distinct().join(index.select(key), key, "left_anti")


def snapshot_diff(
    listing: DataFrame, index: DataFrame, key: str = "item_key", hash_col: str = "content_hash"
) -> DataFrame:
    """``key, action`` with ``insert``, ``update``, ``delete`` or ``unchanged``."""
    new = listing.select(key, F.col(hash_col).alias("__new"), F.lit(True).alias("__listed"))
    old = index.select(key, F.col(hash_col).alias("__old"), F.lit(True).alias("__stored"))
    action = (
        F.when(F.col("__stored").isNull(), F.lit("insert"))
        .when(F.col("__listed").isNull(), F.lit("delete"))
        .when(F.col("__new") == F.col("__old"), F.lit("unchanged"))
        .otherwise(F.lit("update"))
    )
    return new.join(old, key, "full_outer").select(key, action.alias("action"))


def check_keys(df: DataFrame, key: str = "item_key") -> DataFrame:
    """Violations of the key: ``key, n`` for repeated keys, and for NULL keys."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    )


def index_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total"))


def ingest_stats(
    source: DataFrame,
    changed: DataFrame,
    quarantined: DataFrame | None = None,
    failed: DataFrame | None = None,
    key: str = "item_key",
) -> DataFrame:
    """``status, n`` with ``ingested``, ``skipped``, ``rejected``, ``quarantined`` and ``failed``.

    ``changed`` are the rows of ``source`` left after the skip, ``failed`` those
    of them that could not be encoded. One count over all inputs.
    """
    status = F.when(F.col(key).isNull(), F.lit("rejected")).otherwise(F.lit("changed"))
    every = source.where(F.col(key).isNotNull()).select(F.lit("seen").alias("status")).unionByName(
        changed.select(status.alias("status"))
    )
    for name, part in (("quarantined", quarantined), ("failed", failed)):
        if part is not None:
            every = every.unionByName(part.select(F.lit(name).alias("status")))
    return status_counts(every)


def status_counts(statuses: DataFrame) -> DataFrame:
    """``status, n`` of a run, from one ``status`` per document and ``failed`` once more for each that was not encoded.

    ``seen`` stands for a row that was either changed, and then comes once more, or skipped.
    """
    names = ("seen", "changed", "skipped", "rejected", "quarantined", "failed")
    counted = statuses.agg(*[F.count(F.when(F.col("status") == name, 1)).alias(name) for name in names])
    rows = [
        ("ingested", F.col("changed") - F.col("failed")),
        ("skipped", F.col("skipped") + F.greatest(F.col("seen") - F.col("changed"), F.lit(0))),
        ("rejected", F.col("rejected")),
        ("quarantined", F.col("quarantined")),
        ("failed", F.col("failed")),
    ]
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("status"), v.alias("n")) for n, v in rows])).alias("s")
    ).select("s.status", "s.n")
