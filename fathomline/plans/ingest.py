"""Ingest and reconciliation of a directory with the index table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.operators.encode import Encoder, embed_many
from fathomline.operators.merge import latest_per_key, status_counts
from fathomline.session import cut_lineage, deal, fits_broadcast
from fathomline.sources.index_table import IndexStore, upgrade_schema
from fathomline.sources.items import read_items, split_bad_records, to_index_rows
from fathomline.sources.paths import key_from_path


@dataclass(frozen=True)
class IngestResult:
    """``stats`` counts by status; documents that could not be read, keys that could not be encoded; each document's status."""

    stats: DataFrame
    quarantined: DataFrame
    failed: DataFrame
    version: str | None
    documents: DataFrame


def stored_widths(index: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How long the vectors of each column are, as far as the index holds any; one row of each is looked at."""
    found = {c: index.where(F.col(c).isNotNull()).select(F.size(c)).first() for c in columns}
    return {c: row[0] for c, row in found.items() if row}


def encode_rows(
    rows: DataFrame, encoders: Mapping[str, Encoder | None], widths: Mapping[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Index rows with their vectors, and ``item_key, embed_error`` of those that failed.

    A failed row is not stored, so that the next run takes it up again. A vector
    that is not as long as ``widths`` says for its column has failed, too. The
    encoders' output feeds several joins; it is written once here.
    """
    made = embed_many(deal(rows), "content", encoders, error_col="embed_error")
    for column, width in (widths or {}).items():
        wrong = F.col(column).isNotNull() & (F.size(column) != width)
        told = F.concat(F.lit(f"{column}: "), F.size(column).cast("string"), F.lit(f" dimensions, not {width}"))
        made = made.withColumn("embed_error", F.coalesce("embed_error", F.when(wrong, told)))
    made = cut_lineage(made)
    good = upgrade_schema(made.where(F.col("embed_error").isNull()))
    return good, made.where(F.col("embed_error").isNotNull()).select("item_key", "embed_error")


def mark_documents(
    documents: DataFrame, index: DataFrame, on_bad: str = "quarantine", require_vectors: Sequence[str] = ()
) -> DataFrame:
    """Index rows with a ``status``: ``quarantined``, ``rejected`` (no key), ``skipped`` (stored unchanged) or ``changed``.

    The documents are read once and written. Only their keys and hashes meet the
    stored ones; changed rows are then taken from what was written, and only
    they keep their fields. A stored row without a hash, or without one of the
    ``require_vectors``, is not up to date.
    """
    readable, _ = split_bad_records(documents, on_bad)
    if on_bad == "fail":
        documents = readable.withColumn("bad_record", F.lit(None).cast("string"))
    rows = cut_lineage(to_index_rows(documents).withColumn("__row", F.monotonically_increasing_id()))
    stored = index.select("item_key", "content_hash", *require_vectors).dropna()
    # Rows without a key match nothing, and their hashes spread them over the tasks of the join.
    status = (
        F.when(F.col("bad_record").isNotNull(), F.lit("quarantined"))
        .when(F.col("item_key").isNull(), F.lit("rejected"))
        .when(F.col("__stored"), F.lit("skipped"))
        .otherwise(F.lit("changed"))
    )
    slim = ["path", "modified_at", "item_key", "bad_record"]
    marked = cut_lineage(
        rows.select(*slim, "content_hash", "__row")
        .join(stored.select("item_key", "content_hash", F.lit(True).alias("__stored")), ["item_key", "content_hash"], "left")
        .select(*slim, "__row", status.alias("status"))
    )
    wanted = marked.where(F.col("status") == "changed").select("__row")
    changed = rows.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "__row", "left_semi").drop("__row")
    others = marked.where(F.col("status") != "changed").drop("__row")
    return changed.withColumn("status", F.lit("changed")).unionByName(others, allowMissingColumns=True)


def ingest_documents(
    documents: DataFrame,
    store: IndexStore,
    encoders: Mapping[str, Encoder | None],
    on_bad: str = "quarantine",
    require_vectors: Sequence[str] = (),
) -> IngestResult:
    """Upserts the parsed documents whose content is new or changed.

    Unchanged documents are neither embedded nor written again. When nothing
    changed, no new version is written. A vector of another length than those
    the index holds is a failure of its document.
    """
    index = store.read()
    marked = mark_documents(documents, index, on_bad, require_vectors)
    changed = marked.where(F.col("status") == "changed").drop("status", "bad_record")
    widths = stored_widths(index, [c for c, encoder in encoders.items() if encoder])
    fresh, failed = encode_rows(latest_per_key(changed), encoders, widths)
    stats = status_counts(marked.select("status").unionByName(failed.select(F.lit("failed").alias("status"))))
    quarantined = marked.where(F.col("status") == "quarantined").select("path", "bad_record")
    version = None if fresh.isEmpty() else store.apply(fresh)
    return IngestResult(stats, quarantined, failed, version, marked.select("path", "item_key", "status"))


def ingest(
    spark: SparkSession,
    directory: str,
    store: IndexStore,
    encoders: Mapping[str, Encoder | None],
    on_bad: str = "quarantine",
    require_vectors: Sequence[str] = (),
    max_bytes: int | None = None,
) -> IngestResult:
    """``ingest_documents`` for the JSON files of a directory."""
    return ingest_documents(read_items(spark, directory, max_bytes), store, encoders, on_bad, require_vectors)


def reconcile(
    spark: SparkSession, directory: str, store: IndexStore, encoders: Mapping[str, Encoder | None]
) -> IngestResult:
    """Makes the index hold what the directory holds: ingest, then drop the rest."""
    result = ingest(spark, directory, store, encoders)
    index = store.read()
    # A file stands for the key in its name and for the one in its document.
    keys = F.explode(F.array_distinct(F.array(key_from_path(F.col("path")), F.col("item_key")))).alias("item_key")
    present = result.documents.select(keys).where(F.col("item_key").isNotNull())
    # Counted, measured and applied: written, so that files and index meet once.
    gone = cut_lineage(index.select("item_key").join(present, "item_key", "left_anti"))
    if gone.isEmpty():
        return result
    return replace(result, version=store.apply(index.where("false"), gone))
