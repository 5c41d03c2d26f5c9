"""Directories of one-object JSON files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathomline.functions.binding import let
from fathomline.functions.text import build_content, clean_int, content_hash
from fathomline.session import deal, file_system, hadoop_file_system, is_local, local_path, regular_file
from fathomline.sources.paths import MAX_ITEM_BYTES, key_from_path

# Names of a listing, and bytes of files, that a task hands on at once.
LISTED_AT_ONCE = 10_000
READ_AT_ONCE = 16 * 1024 * 1024

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("item_key", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("english_attribute", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("atk", T.IntegerType()),
        T.StructField("def_", T.IntegerType()),
        T.StructField("properties", T.ArrayType(T.StringType())),
        T.StructField("effect_text", T.StringType()),
        T.StructField("bad_record", T.StringType()),
    ]
)


def json_int(document: Column, path: str) -> Column:
    """The integer at ``path`` of a parsed document.

    A JSON number is cut to its integer part, a boolean counts as 0 or 1, a
    string must be an integer by itself; anything else is NULL.
    """

    def read(text: Column) -> Column:
        number = text.try_cast("double")
        whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
        return (
            F.when(text.startswith('"'), clean_int(F.btrim(text, F.lit('"'))))
            .when(text == "true", F.lit(1))
            .when(text == "false", F.lit(0))
            .otherwise(whole.try_cast("int"))
        )

    return let(F.to_json(F.try_variant_get(document, path, "variant")), read)


def parse_documents(files: DataFrame) -> DataFrame:
    """Documents from ``path, modified_at, n_bytes, body``; bad ones keep their text."""
    parsed = files.withColumn("doc", F.try_parse_json("body"))
    doc = F.col("doc")
    # What parses and opens with a brace is an object.
    is_object = doc.isNotNull() & F.col("body").rlike(r"\A\s*\{")

    def text(path: str) -> Column:
        return F.try_variant_get(doc, path, "string")

    return parsed.select(
        "path",
        "modified_at",
        "n_bytes",
        F.try_variant_get(doc, "$.id", "bigint").alias("item_key"),
        text("$.name").alias("name"),
        text("$.englishAttribute").alias("english_attribute"),
        json_int(doc, "$.level").alias("level"),
        json_int(doc, "$.atk").alias("atk"),
        json_int(doc, "$.def").alias("def_"),
        F.try_variant_get(doc, "$.properties", "array<string>").alias("properties"),
        text("$.effectText").alias("effect_text"),
        F.when(~is_object, F.col("body")).alias("bad_record"),
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """``path, modified_at, n_bytes`` of the JSON files directly in ``directory``; none is opened.

    A directory is listed by one task, name after name, and leaves it in batches;
    hidden files and folders below are left out. Names of a local directory are
    dealt over all cores, which look up time and size; a file that is gone by
    then is left out. Paths and times (in milliseconds) are as Spark's own
    readers give them.
    """
    fs, to_path = hadoop_file_system(spark, directory)
    if not fs.exists(to_path(directory)):
        raise FileNotFoundError(directory)
    root = fs.makeQualified(to_path(directory)).toString().rstrip("/")
    schema = "path string, ms bigint, n_bytes bigint"

    def shown(name: str) -> bool:
        hidden = name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
        return name.endswith(".json") and not name.startswith(".") and not hidden

    def batch(paths: list[str], times: list[int | None], sizes: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"path": pa.array(paths, pa.string()), "ms": pa.array(times, pa.int64()), "n_bytes": pa.array(sizes, pa.int64())}
        )

    def entries() -> Iterator[tuple[str, int | None, int | None]]:
        system, base = file_system(root)
        if not is_local(system):
            from pyarrow import fs

            for info in system.get_file_info(fs.FileSelector(base)):
                if info.type == fs.FileType.File and shown(info.base_name):
                    yield info.base_name, info.mtime_ns // 1_000_000, info.size
            return
        with os.scandir(base or "/") as found:
            for entry in found:
                try:
                    if shown(entry.name) and entry.is_file():
                        yield entry.name, None, None
                except FileNotFoundError:
                    continue

    def listed(_) -> Iterator[pa.RecordBatch]:
        for part in batched(entries(), LISTED_AT_ONCE):
            names, times, sizes = zip(*part)
            yield batch([f"{root}/{name}" for name in names], times, sizes)

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = file_system(root)[1].rstrip("/")
        for part in parts:
            found = []
            for path in part.column("path").to_pylist():
                state = regular_file(base + path[len(root):])
                if state:
                    found.append((path, state.st_mtime_ns // 1_000_000, state.st_size))
            if found:
                yield batch(*map(list, zip(*found)))

    rows = spark.range(0, 1, 1, 1).mapInArrow(listed, schema)
    if is_local(file_system(root)[0]):
        rows = deal(rows).mapInArrow(looked_up, schema)
    return rows.select("path", F.timestamp_millis("ms").alias("modified_at"), "n_bytes")


def read_items(spark: SparkSession, directory: str, max_bytes: int | None = None) -> DataFrame:
    """One row per JSON file directly in ``directory``.

    Hidden files and folders below are not read, files that vanish are passed
    over, files larger than ``max_bytes`` are not opened. An empty directory
    gives an empty table.
    """
    files = open_files(list_files(spark, directory), max_bytes).where(F.col("problem").isNull())
    return parse_documents(files.select("path", "modified_at", "n_bytes", F.col("content").cast("string").alias("body")))


def split_bad_records(documents: DataFrame, on_bad: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Readable documents and quarantined ones.

    ``on_bad="fail"`` stops the job at the first unreadable document instead.
    """
    bad = F.col("bad_record").isNotNull()
    if on_bad == "fail":
        checked = documents.where(
            F.when(bad, F.raise_error(F.concat(F.lit("unreadable document "), F.col("path")))).isNull()
        )
        return checked.drop("bad_record"), documents.where(F.lit(False)).select("path", "bad_record")
    if on_bad != "quarantine":
        raise ValueError(f"on_bad must be 'quarantine' or 'fail', not {on_bad!r}")
    return documents.where(~bad).drop("bad_record"), documents.where(bad).select("path", "bad_record")


def to_index_rows(documents: DataFrame) -> DataFrame:
    """The index fields of documents, with content text and its hash."""
    content = build_content(
        F.col("name"), F.col("english_attribute"), F.col("level"), F.col("atk"), F.col("def_"),
        F.col("properties"), F.col("effect_text"),
    )
    return (
        documents.withColumn("content", content)
        .withColumn("content_hash", content_hash(F.col("content")))
        .drop("effect_text")
    )


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """``item_key, path, modified_at`` of the files present, without opening them."""
    files = list_files(spark, directory).select(key_from_path(F.col("path")).alias("item_key"), "path", "modified_at")
    return files.where(F.col("item_key").isNotNull())


def open_files(paths: DataFrame, max_bytes: int | None = MAX_ITEM_BYTES) -> DataFrame:
    """``path, modified_at, n_bytes, content, problem`` of listed files; a content or a problem is there.

    The files named by a change log lie anywhere, so each task opens its own:
    names are few bytes and much work, so they are dealt over all cores. A
    file that is gone or too large is an outcome. Any other error,
    such as a store that does not answer, fails the task, which Spark repeats.
    """

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def local(name: str) -> tuple[int | None, bytes | None, str | None]:
            state = regular_file(name)
            if state is None:
                return None, None, "missing"
            if max_bytes is not None and state.st_size > max_bytes:
                return state.st_size, None, "too large"
            try:
                with open(name, "rb", buffering=0) as stream:
                    return state.st_size, stream.readall(), None
            except (FileNotFoundError, NotADirectoryError):
                return None, None, "missing"

        def one(path: str) -> tuple[int | None, bytes | None, str | None]:
            path = path if "://" in path or path.startswith(("/", "file:")) else "/" + path
            plain = local_path(path)
            if plain is not None:
                return local(plain)
            system, name = file_system(path)
            info = system.get_file_info(name)
            if info.type != fs.FileType.File:
                return None, None, "missing"
            if max_bytes is not None and info.size > max_bytes:
                return info.size, None, "too large"
            try:
                with system.open_input_stream(name) as stream:
                    return info.size, stream.read(), None
            except FileNotFoundError:
                return None, None, "missing"

        def batch(named: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            sizes, contents, problems = zip(*rows)
            arrays = [*named.columns, pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(problems, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "us", "n_bytes", "content", "problem"])

        for part in parts:
            rows, held, start = [], 0, 0
            for path in part.column("path").to_pylist():
                rows.append(one(path))
                held += rows[-1][0] or 0
                if held > READ_AT_ONCE:
                    yield batch(part.slice(start, len(rows)), rows)
                    rows, held, start = [], 0, start + len(rows)
            if rows:
                yield batch(part.slice(start, len(rows)), rows)

    dealt = deal(paths.select("path", F.unix_micros("modified_at").alias("us")))
    read = dealt.mapInArrow(load, "path string, us bigint, n_bytes bigint, content binary, problem string")
    return read.select("path", F.timestamp_micros("us").alias("modified_at"), "n_bytes", "content", "problem")


def read_bodies(paths: DataFrame, max_bytes: int | None = MAX_ITEM_BYTES) -> DataFrame:
    """``path, modified_at, n_bytes, body, problem`` of listed files; a body or a problem is there.

    A file that is gone, too large or not UTF-8 is an outcome.
    """
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return open_files(paths, max_bytes).select(
        "path", "modified_at", "n_bytes", F.when(valid, text).alias("body"),
        F.when(~valid, F.lit("not UTF-8")).otherwise(F.col("problem")).alias("problem"),
    )
