"""File events to keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.sources.paths import path_is_item

UPSERT, DELETE = "upsert", "delete"


def normalize_events(events: DataFrame, *keep: str) -> DataFrame:
    """``op, path, debounce_type, ts`` for each event that changes an item.

    Created and modified files are upserted, a moved file is upserted at its
    destination and never deleted at its source, only a deletion deletes.
    Events of directories and of other files are dropped. ``debounce_type`` is
    NULL for deletions, which are never held back; a move counts as a creation.
    Works on batches and streams.
    """
    kind = F.col("event_type")
    path = F.when(kind == "moved", F.col("dest_path")).when(
        kind.isin("created", "modified", "deleted"), F.col("src_path")
    )
    op = F.when(kind == "deleted", F.lit(DELETE)).otherwise(F.lit(UPSERT))
    debounce_type: Column = F.when(kind.isin("created", "moved"), F.lit("created")).when(
        kind == "modified", F.lit("modified")
    )
    return (
        events.where(~F.coalesce(F.col("is_directory"), F.lit(False)))
        .select(op.alias("op"), path.alias("path"), debounce_type.alias("debounce_type"), "ts", *keep)
        .where(path_is_item(F.col("path")))
    )


def ignored_moves(events: DataFrame) -> DataFrame:
    """Moves whose source row is kept on purpose; for the log."""
    return events.where(
        (F.col("event_type") == "moved")
        & ~F.coalesce(F.col("is_directory"), F.lit(False))
        & path_is_item(F.col("src_path"))
    ).select("src_path", "dest_path", "ts")
