"""Append-only logs of file events.

A file source tells neither edits in place nor deletions of the files it has
seen, so changes are read from a log that some notifier appends to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.schemas import CHANGE_SCHEMA


def read_change_log(
    spark: SparkSession, directory: str, file_format: str = "json", files_per_batch: int = 1000, stream: bool = True
) -> DataFrame:
    """The events under ``directory`` as a stream, or at once."""
    if stream:
        return (
            spark.readStream.format(file_format)
            .schema(CHANGE_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .load(directory)
        )
    return spark.read.format(file_format).schema(CHANGE_SCHEMA).load(directory)
