"""A directory as a stream of file events: each batch is the difference of two listings."""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fathomline.schemas import CHANGE_SCHEMA
from fathomline.session import is_local, regular_file

BUCKETS = 32  # files of a listing, by hash of the path; as many tasks compare two listings
FORMAT = "directory_changes"
LINES_HELD = 20_000  # lines of a listing that are held before they are written
CHANGES_AT_ONCE = 10_000
READ_BYTES = 1 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "/" + path)


class Bucket(InputPartition):
    """The part of two listings that holds the same paths."""

    def __init__(self, before: str | None, after: str, taken_us: int):
        self.before, self.after, self.taken_us = before, after, taken_us


def listed_files(path: str | None) -> Iterator[tuple[str, tuple[int, int]]]:
    """path and (time in microseconds, size) of each file of one bucket, line by line."""
    if path is None:
        return
    system, name = _open(path)
    with system.open_input_stream(name) as stream:
        for line in io.TextIOWrapper(io.BufferedReader(stream, READ_BYTES), encoding="utf-8", newline="\n"):
            path, us, size = json.loads(line)
            yield path, (us, size)


def read_listing(path: str | None) -> dict[str, tuple[int, int]]:
    """(time in microseconds, size) by path of one bucket."""
    return dict(listed_files(path))


def changes_between(before: dict, after: dict | Iterable, taken_us: int) -> Iterator[tuple[str, str, int]]:
    """(event, path, microseconds): files of one listing only, and those whose time or size differs.

    A deletion has no time of its own; it counts as of the later listing, of
    which one file is held at a time if it is given as pairs.
    """
    left = dict(before)
    for path, state in after.items() if isinstance(after, dict) else after:
        known = left.pop(path, None)
        if known is None:
            yield "created", path, state[0]
        elif known != state:
            # A file put back with an older time has still changed after it was listed.
            yield "modified", path, max(state[0], known[0] + 1)
    for path in left:
        yield "deleted", path, taken_us


class ListingWriter:
    """A listing on its way to its files: lines are held up to ``most``, then written to their buckets.

    The digest of a bucket is the number of its lines and the sum of their
    hashes, so it is the same whatever order the files are met in, and nothing
    is sorted. A listing that stays within ``most`` lines leaves no file until
    it is kept.
    """

    def __init__(self, state: str, buckets: int, most: int = LINES_HELD):
        self.system, self.root = _open(state)
        self.folder, self.most = uuid.uuid4().hex, most
        self.lines: list[list[bytes]] = [[] for _ in range(buckets)]
        self.held, self.counts, self.sums = 0, [0] * buckets, [0] * buckets
        self.streams: list = []

    def add(self, path: str, us: int, size: int) -> None:
        line = json.dumps([path, us, size]).encode()
        bucket = zlib.crc32(path.encode()) % len(self.lines)
        self.lines[bucket].append(line)
        self.counts[bucket] += 1
        self.sums[bucket] = (self.sums[bucket] + int.from_bytes(hashlib.blake2b(line, digest_size=16).digest())) % (1 << 128)
        self.held += 1
        if self.held >= self.most:
            self._flush()

    def _flush(self) -> None:
        if not self.streams:
            base = f"{self.root}/{self.folder}"
            self.system.create_dir(base, recursive=True)
            self.streams = [self.system.open_output_stream(f"{base}/{i}") for i in range(len(self.lines))]
        for lines, out in zip(self.lines, self.streams):
            if lines:
                out.write(b"\n".join(lines) + b"\n")
                lines.clear()
        self.held = 0

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.counts, self.sums]).encode()).hexdigest()

    def keep(self) -> str:
        """The folder of the listing, written to its end."""
        self._flush()
        for out in self.streams:
            out.close()
        return self.folder

    def drop(self) -> None:
        """Removes what was written of it."""
        for out in self.streams:
            out.close()
        if self.streams:
            self.system.delete_dir(f"{self.root}/{self.folder}")


class DirectoryReader(DataSourceStreamReader):
    """Offsets name listings, which are written to the state folder before they are handed out.

    A listing is one folder of ``BUCKETS`` files, so what Spark keeps as an
    offset does not grow with the directory, and the tasks compare the buckets.
    A directory that has not changed gets no new listing. Listings are kept
    until the batch that starts at them is done.
    """

    def __init__(self, options: dict[str, str]):
        self.directory, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.buckets = int(options.get("buckets", BUCKETS))

    def initialOffset(self) -> dict:
        return {"listing": 0, "folder": "", "taken_us": 0}

    def _last(self) -> dict:
        """The newest listing that was written to its end."""
        from pyarrow import fs

        system, base = _open(self.state)
        done = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = [i.base_name for i in done if i.type == fs.FileType.File and i.base_name.startswith("listing-")]
        if not names:
            return self.initialOffset() | {"digest": ""}
        with system.open_input_stream(f"{base}/{max(names)}") as stream:
            return json.loads(stream.read())

    def _files(self) -> Iterator[tuple[str, int, int]]:
        """path, time in microseconds and size of the files right under the directory; those of a local one are met one by one."""
        from pyarrow import fs

        system, base = _open(self.directory)
        prefix = self.directory[: len(self.directory) - len(base)] if self.directory.endswith(base) else ""
        if not is_local(system):
            for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    yield prefix + info.path, info.mtime_ns // 1000, info.size
            return
        try:
            found = os.scandir(base or "/")
        except FileNotFoundError:
            return
        with found:
            for entry in found:
                state = regular_file(entry.path)
                if state:
                    yield f"{prefix}{base}/{entry.name}", state.st_mtime_ns // 1000, state.st_size

    def latestOffset(self) -> dict:
        taken_us = time.time_ns() // 1000
        listing = ListingWriter(self.state, self.buckets)
        try:
            for path, us, size in self._files():
                listing.add(path, us, size)
            last, digest = self._last(), listing.digest()
            if last["digest"] == digest:
                listing.drop()
                return {k: last[k] for k in ("listing", "folder", "taken_us")}
            offset = {"listing": last["listing"] + 1, "folder": listing.keep(), "taken_us": taken_us}
        except BaseException:
            listing.drop()
            raise
        state, root = _open(self.state)
        # Written last: a listing without this file was not finished and is not seen.
        with state.open_output_stream(f"{root}/listing-{offset['listing']:012d}") as out:
            out.write(json.dumps(offset | {"digest": digest}).encode())
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["folder"] == end["folder"]:
            return []
        at = lambda offset, i: f"{self.state}/{offset['folder']}/{i}" if offset["folder"] else None
        return [Bucket(at(start, i), at(end, i), end["taken_us"]) for i in range(self.buckets)]

    def read(self, partition: Bucket) -> Iterator:
        import pyarrow as pa

        # Of the earlier listing a bucket is held, of the later one a file.
        changes = changes_between(read_listing(partition.before), listed_files(partition.after), partition.taken_us)
        for rows in batched(changes, CHANGES_AT_ONCE):
            kinds, paths, times = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(paths), pa.nulls(len(rows), pa.string()), pa.array([False] * len(rows)),
                 pa.array(times, pa.int64()).cast(pa.timestamp("us", tz="UTC"))],
                names=CHANGE_SCHEMA.names,
            )

    def commit(self, end: dict) -> None:
        """Listings before ``end`` are read no more."""
        from pyarrow import fs

        system, base = _open(self.state)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith("listing-") and int(info.base_name.partition("-")[2]) < end["listing"]:
                with system.open_input_stream(info.path) as stream:
                    folder = json.loads(stream.read())["folder"]
                if system.get_file_info(f"{base}/{folder}").type == fs.FileType.Directory:
                    system.delete_dir(f"{base}/{folder}")
                system.delete_file(info.path)


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return CHANGE_SCHEMA

    def streamReader(self, schema) -> DirectoryReader:
        return DirectoryReader(dict(self.options))


def read_directory_changes(spark: SparkSession, directory: str, state: str, buckets: int = BUCKETS) -> DataFrame:
    """What happens to the files right under ``directory``, as a stream of file events.

    Each trigger lists the directory; files that are new, that have another
    time or size, or that are gone since the last listing are events. A stream
    without a checkpoint begins with all files as created. ``state`` is a shared
    folder of this stream's own, beside its checkpoint. Changes between two
    listings are one event, and a move is a creation and a deletion.

    The listing passes through one process, as any listing does, file by file:
    what it holds does not grow with a local directory (other file systems give
    all names at once). Contents are read by the tasks that apply the events.
    """
    spark.dataSource.register(DirectorySource)
    return spark.readStream.format(FORMAT).option("state", state).option("buckets", buckets).load(directory)
