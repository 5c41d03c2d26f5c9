"""The change stream: normalise, debounce, then apply to the index table."""

from __future__ import annotations

import hashlib
import posixpath
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from fathomline.operators.encode import Encoder
from fathomline.operators.events import DELETE, UPSERT, normalize_events
from fathomline.operators.merge import latest_per_key, reject_missing_key
from fathomline.plans.ingest import encode_rows
from fathomline.session import cut_lineage
from fathomline.sources.index_table import IndexStore, _file_system
from fathomline.sources.items import parse_documents, read_bodies, split_bad_records, to_index_rows
from fathomline.sources.paths import MAX_ITEM_BYTES, key_from_path

# Debounce window and how long its state is kept.
DEBOUNCE_MS = 500
STATE_TTL_MS = 10_000

KEPT_SCHEMA = "path string, debounce_type string, us bigint"


class KeepLeading(StatefulProcessor):
    """Per (path, type): keeps events at least one window away from the last kept one.

    The state is a single time, the latest kept; it expires. An event that comes
    late, before that time, is kept like any other unless it lies within the
    window. Times are microseconds since 1970, whatever the session's zone.
    """

    def __init__(self, window_ms: int, ttl_ms: int, by_arrival: bool = False):
        self.window = window_ms * 1000
        self.ttl_ms = ttl_ms
        self.by_arrival = by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Rows come in any order; only their distinct times are held, eight bytes each.
        times, now = np.zeros(0, dtype=np.int64), 0
        for part in rows:
            times = np.union1d(times, part["us"].to_numpy(dtype=np.int64))
            now = max(now, int(part["clock"].max()))
        stored = self.last.get()[0] if self.last.exists() else None
        if stored is not None:
            times = times[np.abs(times - stored) >= self.window]
        at, kept = 0, []
        while at < len(times):
            kept.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + self.window))
        if not kept:
            return
        newest = kept[-1] if stored is None else max(kept[-1], stored)
        self.last.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer((now if self.by_arrival else newest // 1000) + self.ttl_ms)
        path, debounce_type = key
        yield pd.DataFrame({"path": path, "debounce_type": debounce_type, "us": kept})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def debounce_stream(
    changes: DataFrame, window_ms: int = DEBOUNCE_MS, ttl_ms: int | None = None, lateness: str | None = "10 seconds"
) -> DataFrame:
    """Debounced upserts of a normalised stream; needs the RocksDB state store.

    With ``lateness`` given, state expires in event time and events later than
    that are dropped by the watermark. With ``lateness=None`` the watermark
    follows the time at which batches arrive: no event is ever dropped for its
    own time, and state expires by arrival. State outlives the window:
    ``ttl_ms`` is 10 seconds or twice the window by default, and must be longer
    than the window.
    """
    ttl_ms = max(STATE_TTL_MS, 2 * window_ms) if ttl_ms is None else ttl_ms
    if ttl_ms <= window_ms:
        raise ValueError(f"state must outlive the window of {window_ms} ms, not expire after {ttl_ms} ms")
    held = changes.where(F.col("op") == UPSERT)
    if lateness is None:
        held = held.withColumn("clock", F.current_timestamp()).withWatermark("clock", "0 seconds")
    else:
        held = held.withWatermark("ts", lateness).withColumn("clock", F.col("ts"))
    kept = (
        held.select("path", "debounce_type", F.unix_micros("ts").alias("us"), F.unix_millis("clock").alias("clock"),
                    F.col("clock").alias("marked"))
        .groupBy("path", "debounce_type")
        .transformWithStateInPandas(
            statefulProcessor=KeepLeading(window_ms, ttl_ms, by_arrival=lateness is None),
            outputStructType=KEPT_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return kept.select(F.lit(UPSERT).alias("op"), "path", "debounce_type", F.timestamp_micros("us").alias("ts"))


# The table of what was kept lately, beside what Spark keeps in the checkpoint.
HELD = "held"
HELD_SCHEMA = "path string, debounce_type string, us bigint, expires bigint"


def _leading(window_us: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of rows in order of path, type and time, those at least a window after the last kept one; one time is held."""

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for part in parts:
            kept = np.zeros(len(part), dtype=bool)
            for i, (path, kind, us) in enumerate(zip(part["path"], part["debounce_type"], part["us"].tolist())):
                if (path, kind) != key or us > last and us - last >= window_us:
                    key, last, kept[i] = (path, kind), us, True
            yield part[kept]

    return pick


def debounce_batch(
    changes: DataFrame, folder: str, batch_id: int, window_ms: int = DEBOUNCE_MS, ttl_ms: int | None = None, now_ms: int | None = None
) -> DataFrame:
    """A batch of normalised changes without the upserts that are held back, by the rule of ``KeepLeading``.

    The latest kept time of each (path, type) is a table under ``folder``, one
    version a batch, which meets the batch's events in one join: keys cost no
    calls of their own. State expires by arrival, ``ttl_ms`` after the batch
    that kept it last, so the table is as long as what was kept lately. A batch
    that is repeated starts from the version before it. An upsert without a
    time is not held back.
    """
    ttl_ms = max(STATE_TTL_MS, 2 * window_ms) if ttl_ms is None else ttl_ms
    if ttl_ms <= window_ms:
        raise ValueError(f"state must outlive the window of {window_ms} ms, not expire after {ttl_ms} ms")
    spark, now = changes.sparkSession, int(time.time() * 1000) if now_ms is None else now_ms
    before = _last_finished(spark, folder, batch_id)
    state = spark.read.schema(HELD_SCHEMA).parquet(before) if before else spark.createDataFrame([], HELD_SCHEMA)
    key, window_us = ["path", "debounce_type"], window_ms * 1000
    events = changes.where(F.col("op") == UPSERT).select(*key, F.unix_micros("ts").alias("us"))
    # A key's events stay together, also beside a state small enough to be sent around.
    timed = events.where(F.col("us").isNotNull()).repartition(*key)
    open_ = timed.join(state.select(*key, F.col("us").alias("stored")), key, "left").where(
        F.col("stored").isNull() | (F.abs(F.col("us") - F.col("stored")) >= window_us)
    )
    in_order = open_.select(*key, "us").sortWithinPartitions(*key, "us")
    kept = cut_lineage(in_order.mapInPandas(_leading(window_us), KEPT_SCHEMA))
    newest = kept.withColumn("expires", F.lit(now + ttl_ms))
    held = state.unionByName(newest).groupBy(*key).agg(F.max("us").alias("us"), F.max("expires").alias("expires"))
    held.where(F.col("expires") > now).write.mode("overwrite").parquet(posixpath.join(folder, f"batch={batch_id}"))
    # What this batch started from is needed if it is repeated; older versions are not.
    fs, path = _file_system(spark, folder)
    for name in _folder_names(spark, folder):
        if before and name.startswith("batch=") and int(name.partition("=")[2]) < int(before.rpartition("=")[2]):
            fs.delete(path(posixpath.join(folder, name)), True)
    others = changes.where((F.col("op") == DELETE) | F.col("ts").isNull()).select("op", "path", "ts")
    return others.unionByName(kept.select(F.lit(UPSERT).alias("op"), "path", F.timestamp_micros("us").alias("ts")))


FAILURES = "_failures"
FAILURE_SCHEMA = "path string, ts timestamp, reason string, detail string"
ENCODER = "encoder"  # the reason that is tried again
STREAM = "stream"


def _failure_folder(store: IndexStore, writer: str, batch_id: int | None = None) -> str:
    folder = posixpath.join(store.root, FAILURES, f"writer={writer}")
    return folder if batch_id is None else posixpath.join(folder, f"batch={batch_id}")


def _folder_names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def read_failures(spark: SparkSession, store: IndexStore) -> DataFrame:
    """``path, ts, reason, detail, writer, batch`` of all that could not be brought into the index.

    Reasons: ``missing``, ``too large``, ``not UTF-8``, ``unreadable``, ``no key`` and ``encoder``. What fails in the
    encoder is tried again with each batch, and listed by each batch in which it fails.
    """
    schema, root = FAILURE_SCHEMA + ", writer string, batch bigint", posixpath.join(store.root, FAILURES)
    if not _folder_names(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def _last_finished(spark: SparkSession, folder: str, before: int) -> str | None:
    """The folder of the last finished batch before ``before``."""
    fs, path = _file_system(spark, folder)
    batches = [int(n.partition("=")[2]) for n in _folder_names(spark, folder) if n.startswith("batch=")]
    for batch in sorted((n for n in batches if n < before), reverse=True):
        found = posixpath.join(folder, f"batch={batch}")
        if fs.exists(path(posixpath.join(found, "_SUCCESS"))):
            return found
    return None


def open_failures(spark: SparkSession, store: IndexStore, before: int, writer: str | None = None) -> DataFrame:
    """What the last batch of ``writer`` (or of each) before ``before`` left to be tried again; each passes on what still fails."""
    root = posixpath.join(store.root, FAILURES)
    writers = [writer] if writer else [n.partition("=")[2] for n in _folder_names(spark, root) if n.startswith("writer=")]
    last = [found for name in writers if (found := _last_finished(spark, _failure_folder(store, name), before))]
    if not last:
        return spark.createDataFrame([], FAILURE_SCHEMA)
    return spark.read.schema(FAILURE_SCHEMA).parquet(*last).where(F.col("reason") == ENCODER)


def apply_changes(
    spark: SparkSession,
    changes: DataFrame,
    store: IndexStore,
    encoders: Mapping[str, Encoder | None],
    batch_id: int,
    max_bytes: int = MAX_ITEM_BYTES,
    writer: str = STREAM,
) -> str | None:
    """One batch of ``op, path, ts`` onto the index; the last operation per path wins.

    ``batch_id`` counts the batches of ``writer``, whatever else writes to the index.

    Files are read where the work is, in the executors. What cannot be brought
    in is written beside the versions with its reason, before the version;
    items whose encoder failed are tried again with the next batch.
    """
    if store.published(batch_id, writer):
        return None
    again = open_failures(spark, store, batch_id, writer)
    wanted = changes.select("op", "path", "ts").unionByName(again.select(F.lit(UPSERT).alias("op"), "path", "ts"))
    order = W.partitionBy("path").orderBy(F.col("ts").desc(), F.col("op"))
    last = wanted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 1)
    last = cut_lineage(last.select("op", "path", "ts"))
    if last.isEmpty():
        return None
    gone = (
        last.where(F.col("op") == DELETE)
        .groupBy(key_from_path(F.col("path")).alias("item_key"))
        .agg(F.max("ts").alias("gone_at"))
        .where(F.col("item_key").isNotNull())
    )
    # Upserts are read from storage, so they must not be read twice.
    upserts = last.where(F.col("op") == UPSERT).select("path", F.col("ts").alias("modified_at"))
    bodies = cut_lineage(read_bodies(upserts, max_bytes))
    documents, unreadable = split_bad_records(parse_documents(bodies.where(F.col("problem").isNull()).drop("problem")))
    keyed, keyless = reject_missing_key(to_index_rows(documents))
    # A document written before its key was deleted stays deleted.
    alive = (
        latest_per_key(keyed)
        .join(gone, "item_key", "left")
        .where(F.col("gone_at").isNull() | (F.col("modified_at") > F.col("gone_at")))
        .drop("gone_at")
    )
    fresh, failed = encode_rows(alive, encoders)
    at = F.col("modified_at").alias("ts")
    problems = [
        bodies.where(F.col("problem").isNotNull()).select("path", at, F.col("problem").alias("reason"), F.lit(None).cast("string")),
        unreadable.join(bodies, "path").select("path", at, F.lit("unreadable"), "bad_record"),
        keyless.select("path", at, F.lit("no key"), F.lit(None).cast("string")),
        failed.join(latest_per_key(keyed), "item_key").select("path", at, F.lit(ENCODER), "embed_error"),
    ]
    listed = problems[0]
    for more in problems[1:]:
        listed = listed.union(more)
    listed = listed.toDF("path", "ts", "reason", "detail")
    listed.write.mode("overwrite").parquet(_failure_folder(store, writer, batch_id))
    if fresh.isEmpty() and gone.isEmpty():
        return None
    return store.apply(fresh, gone, batch_id, writer)


def watch(
    events: DataFrame,
    store: IndexStore,
    encoders: Mapping[str, Encoder | None],
    checkpoint: str,
    window_ms: int | None = DEBOUNCE_MS,
    on_batch: Callable[[int, str | None], None] | None = None,
):
    """A writer for the change stream; start it with the trigger of your choice.

    Events are never dropped for being late: an upsert means that a file is to
    be read again, whenever it is heard of. Batches are numbered by the
    checkpoint, so it names the writer: a stream that starts anew, with another
    checkpoint, is another one. Without a ``window_ms`` nothing is held back:
    the differences of listings are told once already.
    """
    writer = f"{STREAM}_{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    changes = normalize_events(events)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if window_ms is not None:
            batch = debounce_batch(batch, posixpath.join(checkpoint, HELD), batch_id, window_ms)
        version = apply_changes(spark, batch, store, encoders, batch_id, writer=writer)
        if on_batch:
            on_batch(batch_id, version)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
