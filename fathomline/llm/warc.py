"""WARC archives as a Spark data source: files are planned as partitions, headers are read before payloads."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from fathomline.llm.common import file_system, join_measured
from fathomline.session import checkpoint_dir, cut_lineage

MANIFEST = "_COMMITTED"  # names the files of finished writes; others are leftovers of lost tasks
ROLL_BYTES = 64 << 20  # an archive is closed once it has this size
PARTITION_BYTES = 64 << 20  # small archives are read together up to this size
BATCH_BYTES = 4 << 20
WINDOW = 1 << 20
HEAD = 4096
MIN_REVISIT = 1000

# Column, its type, and the header field it comes from.
HEADERS = (
    ("record_id", "string", "WARC-Record-ID"), ("warc_type", "string", "WARC-Type"), ("date", "string", "WARC-Date"),
    ("target_uri", "string", "WARC-Target-URI"), ("refers_to", "string", "WARC-Refers-To"),
    ("payload_digest", "string", "WARC-Payload-Digest"), ("payload_length", "bigint", "WARC-Payload-Length"),
    ("content_type", "string", "Content-Type"), ("content_length", "bigint", "Content-Length"),
)
SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in HEADERS) + ", payload binary"
ARROW = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k, _ in HEADERS] + [("payload", pa.binary())])
COMPARE = {
    EqualTo: lambda x, y: x is not None and x == y, EqualNullSafe: lambda x, y: x == y,
    In: lambda x, y: x is not None and x in y, StringStartsWith: lambda x, y: x is not None and x.startswith(y),
    GreaterThan: lambda x, y: x is not None and x > y, GreaterThanOrEqual: lambda x, y: x is not None and x >= y,
    LessThan: lambda x, y: x is not None and x < y, LessThanOrEqual: lambda x, y: x is not None and x <= y,
    IsNull: lambda x, _: x is None, IsNotNull: lambda x, _: x is not None,
}


# Names the fields of a record whose values are percent-encoded.
ENCODED = "X-Percent-Encoded"


def header_value(text: str) -> str:
    """``text`` on one line, without blanks around it, so that ``unquote`` gives it back: what cannot stand in a field is percent-encoded."""
    return re.sub(r"[%\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), text)


def member(data: bytes) -> bytes:
    """``data`` as a gzip member whose extra field ``sl`` holds the lengths of the member and of its content."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    extra = b"sl" + struct.pack("<HII", 8, 12 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack(
        "<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A WARC record; the payload of a response stands behind an HTTP head."""
    payload = row.get("payload") or b""
    block = b""
    if row["warc_type"] == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = {name: row.get(name) for name, _, _ in HEADERS} | {"content_length": len(block)}
    if block:
        fields["content_type"] = "application/http;msgtype=response"
    given = {title: str(fields[name]) for name, _, title in HEADERS if fields[name] is not None}
    # Values are written as they are wherever a field can hold them, so addresses that are encoded themselves stay readable.
    odd = [title for title, text in given.items() if re.search(r"[\x00-\x1f\x7f]|^ | $", text)]
    lines = [f"{title}: {header_value(text) if title in odd else text}" for title, text in given.items()]
    lines += [f"{ENCODED}: {', '.join(odd)}"] if odd else []
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Bytes:
    """A file seen through a window, so that what is skipped is not read."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.size, self.begin, self.window = self.file.size(), 0, b""

    def at(self, offset: int, length: int) -> bytes:
        low = offset - self.begin
        if low < 0 or low + length > len(self.window):
            self.file.seek(offset)
            self.begin, self.window, low = offset, self.file.read(max(length, WINDOW)), 0
        return self.window[low:low + length]


def _fields(head: bytes) -> dict:
    """Columns of a record's header block."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    given = {}
    for line in lines:
        name, _, value = line.partition(":")
        given[name.strip().lower()] = value.strip(" \t")
    for title in filter(None, given.get(ENCODED.lower(), "").lower().split(", ")):
        given[title] = unquote(given[title])
    found = {name: given.get(title.lower()) for name, _, title in HEADERS}
    for name, kind, _ in HEADERS:
        if kind == "bigint" and found[name] is not None:
            found[name] = int(found[name])
    return found


def _payload(fields: dict, block: bytes) -> bytes:
    if (fields["content_type"] or "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _plain_records(data: _Bytes, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    offset = 0
    while offset < data.size:
        need = HEAD
        while (end := (seen := data.at(offset, need)).find(b"\r\n\r\n")) < 0:
            if len(seen) < need:
                raise ValueError(f"a header without an end at {offset}")
            need *= 4
        fields, start = _fields(seen[:end]), offset + end + 4
        length = fields["content_length"]
        if length is None:
            length = _until_next(data, start)
        if wanted(fields):
            yield fields, _payload(fields, data.at(start, length)) if payloads else None
        offset = start + length + 4


def _until_next(data: _Bytes, start: int) -> int:
    """The length of a block that does not state it: up to the next record, or to the end."""
    at, mark = start, b"\r\n\r\nWARC/1."
    while at < data.size:
        found = data.at(at, min(WINDOW, data.size - at))[:WINDOW].find(mark)
        if found >= 0:
            return at + found - start
        at += WINDOW - len(mark)
    return max(0, data.size - start - (4 if data.at(max(start, data.size - 4), 4)[:4] == b"\r\n\r\n" else 0))


def _member_length(head: bytes) -> int | None:
    """The length a member's ``sl`` field states."""
    if len(head) >= 24 and head[3] & 4 and head[12:16] == b"sl\x08\0":
        return struct.unpack("<I", head[16:20])[0]
    return None


def _gzip_records(data: _Bytes, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of one member each: the head is inflated, and the rest only if the record is wanted.

    A member that states its length is left at once; one that does not is
    inflated to its end, piece by piece, and its payload is thrown away.
    """
    offset = 0
    while offset < data.size:
        length = _member_length(data.at(offset, 24))
        inflate, read, head = zlib.decompressobj(31), 0, b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            raw = inflate.unconsumed_tail
            if not raw:
                raw = data.at(offset + read, min(HEAD, data.size - offset - read))
                read += len(raw)
            if not raw or inflate.eof:
                raise ValueError(f"a header without an end in the member at {offset}")
            head += inflate.decompress(raw, HEAD)
        fields = _fields(head[:end])
        keep = wanted(fields)
        parts = [head[end + 4:]]
        if length is None or (keep and payloads):
            while not inflate.eof:
                raw = inflate.unconsumed_tail
                if not raw:
                    raw = data.at(offset + read, min(WINDOW, data.size - offset - read))
                    read += len(raw)
                if not raw:
                    raise ValueError(f"the member at {offset} is cut short")
                piece = inflate.decompress(raw, WINDOW)
                if keep and payloads:
                    parts.append(piece)
        if keep:
            yield fields, _payload(fields, b"".join(parts)[:fields["content_length"]]) if payloads else None
        offset += length if length is not None else read - len(inflate.unused_data)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcReader(DataSourceReader):
    """Reads the archives of a folder.

    Predicates on header columns are taken over and decided on the parsed
    header; with the option ``payload`` set to ``false`` no payload is decoded.
    """

    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        columns = {name for name, _, _ in HEADERS}
        for item in filters:
            column = ".".join(getattr(item, "attribute", ()))
            if type(item) in COMPARE and column in columns:
                self.tests.append((type(item), column, getattr(item, "value", None)))
            else:
                yield item

    def partitions(self) -> list[_Files]:
        store, folder = file_system(self.path)
        infos = store.get_file_info(fs.FileSelector(folder, recursive=False))
        named = [i for i in infos if i.base_name.startswith(MANIFEST)]
        kept = {name for i in named for name in json.loads(store.open_input_file(i.path).read())} if named else None
        files = sorted(
            (i for i in infos if i.base_name.endswith((".warc", ".warc.gz")) and (kept is None or i.base_name in kept)),
            key=lambda i: i.base_name,
        )
        groups: list[list[str]] = []
        room = 0
        for i in files:
            if not groups or room < i.size:
                groups.append([])
                room = self.limit
            groups[-1].append(i.path)
            room -= i.size
        return [_Files(g) for g in groups] or [_Files([])]

    def wanted(self, fields: dict) -> bool:
        return all(COMPARE[kind](fields[column], value) for kind, column, value in self.tests)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        rows, held = [], 0
        for path in partition.value:
            data = _Bytes(store, path)
            records = _gzip_records if path.endswith(".gz") else _plain_records
            for fields, payload in records(data, self.wanted, self.payloads):
                rows.append(fields | {"payload": payload})
                held += len(payload or b"") + 200
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes archives; those of lost or repeated tasks are never named in the manifest, so they are never read."""

    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("rollbytes", ROLL_BYTES))
        self.packed = options.get("compression", "gzip").lower() == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        names, out, room = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or room <= 0:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out, room = store.open_output_stream(f"{folder}/{names[-1]}", compression=None), self.roll
                data = member(record(row)) if self.packed else record(row)
                out.write(data)
                room -= len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}") as out:
            out.write(json.dumps([name for m in messages if m for name in m.names]).encode())

    def abort(self, messages: list) -> None:
        store, folder = file_system(self.path)
        for name in [name for m in messages if m for name in m.names]:
            store.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``; filters on header columns skip payloads. Turns filter push-down on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Adds archives of ``records`` (columns of the header table and payload) to the folder ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").options(**options).mode("append").save(path)


def page_records(pages: DataFrame) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html); repeated payloads become revisits.

    Among payloads of at least 1000 bytes that are equal, the one with the
    largest page_id is the response and the others revisit it. Only digests are
    grouped. The few that repeat are sent to the pages if they are measured to
    be small; otherwise they are joined, where a digest with very many pages
    is split at run time.

    Defined results: a null html is empty; a null page_id is smaller than any
    other and revisits any other page; rows that share the largest page_id are
    all responses, as are all rows of a group without ids; a null url has no
    header; other columns are not looked at.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("payload"), F.sha1(html).alias("digest"),
        F.octet_length(html).cast("bigint").alias("bytes"),
    )
    repeated = cut_lineage(
        rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 and kept is not null").select("digest", "kept")
    )
    joined = join_measured(rows, repeated, "digest", "left")
    again = F.col("kept").isNotNull() & F.coalesce(F.col("page_id") != F.col("kept"), F.lit(True))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("url").alias("target_uri"),
        F.when(again, urn(F.col("kept"))).alias("refers_to"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_length"), F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives in a new folder and returns what reading them back shows.

    Length and digest of a response are computed from the payload that was read;
    a revisit states those of the payload it stands for.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url.
    """
    spark = pages.sparkSession
    folder = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), folder)
    back = read_warc(spark, folder)
    held = F.col("warc_type") == "response"
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    return back.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(held, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(held, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"), F.col("target_uri").alias("url"),
    )
