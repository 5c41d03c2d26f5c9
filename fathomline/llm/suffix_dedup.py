"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fathomline.llm.common import WORD, join_measured, text_slices
from fathomline.session import cut_lineage

PASSAGE = 50  # words a passage has at least
PREFIX = 10  # words by which suffixes are sorted
REACH = PASSAGE - PREFIX + 1  # prefixes in a passage; their minimiser keeps its suffix
BASE = 0x9E3779B97F4A7C15


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``texts``, A-Z in lower case, and where each text's words begin and the last one's end."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    bounds = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    return distinct[words.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64), bounds - bounds[0]


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words; those that begin too late are zero.

    Runs are doubled: a run of 2n words is its first n times a power, plus its
    last n.
    """
    out = np.zeros_like(words)
    if len(words) < length:
        return out
    run, size = words, 1
    whole, done = None, 0
    rest = length
    while rest:
        if rest & 1:
            if whole is None:
                whole, done = run, size
            else:  # the collected run stands behind this one
                n = len(words) - done - size + 1
                whole, done = run[:n] * _power(done) + whole[size:size + n], done + size
        rest >>= 1
        if rest:
            n = len(run) - size
            run, size = run[:n] * _power(size) + run[size:size + n], size * 2
    whole = whole[:len(words) - length + 1]
    mixed = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out[:len(whole)] = mixed ^ (mixed >> np.uint64(29))
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _slide(values: np.ndarray, length: int, how, fill) -> np.ndarray:
    """``how`` over the ``length`` values from each place on."""
    out, size = values, 1
    while size * 2 <= length:
        out = how(out, np.concatenate([out[size:], np.full(min(size, len(out)), fill, out.dtype)]))
        size *= 2
    step = length - size
    return how(out, np.concatenate([out[step:], np.full(min(step, len(out)), fill, out.dtype)])) if step else out


def minimisers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the prefixes at each place, and the least one in each passage-long window (zero where none fits).

    A place is retained if its prefix is the least of a window, ties included:
    that depends on the words of the window alone, so equal windows retain
    suffixes at the same places.
    """
    prefixes = run_hashes(words, PREFIX)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    fits = np.arange(len(words)) + PASSAGE <= ends
    least = _slide(prefixes, REACH, np.minimum, np.uint64(2**64 - 1))
    return prefixes, np.where(fits, least, np.uint64(0))


def _back(values: np.ndarray, length: int) -> np.ndarray:
    """The greatest of the ``length`` values up to each place."""
    return _slide(values[::-1], length, np.maximum, np.uint64(0))[::-1]


def _retained(prefixes: np.ndarray, least: np.ndarray) -> np.ndarray:
    return np.flatnonzero((_back(least, REACH) == prefixes) & (prefixes != 0))


def _first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` without later copies of whole texts, and the copies: (doc_id, first_doc_id, n_words)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    digest = rows.withColumn("digest", F.md5("text"))
    again = cut_lineage(
        digest.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
        .where("last > first_doc_id").select("digest", "first_doc_id")
    )
    marked = join_measured(digest, again, "digest", "left")
    later = F.col("first_doc_id") < F.col("doc_id")
    copies = marked.where(later).select(
        "doc_id", "first_doc_id", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words")
    )
    return marked.where(F.coalesce(~later, F.lit(True))).select("doc_id", "text"), copies


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of at least 50 words of ``docs`` (doc_id, text) that stand elsewhere before.

    A word is a run of characters other than ASCII blanks; A-Z count as a-z. A
    passage stands before if the same words stand in a document with a smaller
    doc_id, or earlier in the same one.

    1. Retain: of the ten-word prefixes in each 50-word window, the one with the
       least hash keeps its suffix, so equal windows keep the same suffix.
    2. Compare: suffixes that agree with another in their ten words are kept.
       They are grouped by a hash of these words, not sorted: in one sorted
       order a passage that very many documents share is one range, while its
       group is counted within the tasks first. Most suffixes end here.
    3. Extend: around each kept suffix, left and right, the windows whose least
       prefix it is are hashed. Equal windows are found the same way, and each
       is referred to its first place, which need not be a neighbour's. Runs of
       windows with one alignment are a passage.

    Every repeated window is found, since its own least prefix repeats as well.
    Later copies of whole texts are set aside first by digest and refer to the
    first one. Texts are read twice; if the places kept in step 2 are measured
    to be small they are sent to the second reading, otherwise joined. Windows
    are always joined by shuffle.
    Comparisons are of 64-bit hashes.

    Defined results: null texts and rows without an id take no part; empty and
    short texts have no passage; rows with one doc_id count as one document, in
    which a word at the same place is the same word; an empty table gives none;
    other columns are not looked at.
    Returns doc_id, start_word, n_words, first_doc_id, first_start_word.
    """
    texts, copies = _first_texts(docs)

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, bounds = word_hashes(part.column("text"))
                prefixes, least = minimisers(words, bounds)
                at = _retained(prefixes, least)
                row = np.searchsorted(bounds, at, side="right") - 1
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefixes[at].view(np.int64)), pa.array(ids[row]), pa.array((at - bounds[row]).astype(np.int32))],
                    names=["prefix", "doc_id", "place"],
                )

    suffixes = cut_lineage(texts.mapInArrow(retain, "prefix bigint, doc_id bigint, place int"))
    # Written first: a join that reads its sides from shuffles of their own can split a prefix that very many share.
    agreeing = cut_lineage(suffixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"))
    # The places of one document: as many as it has words, at most.
    places = cut_lineage(
        join_measured(suffixes, agreeing, "prefix").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, bounds = word_hashes(part.column("text"))
                prefixes, least = minimisers(words, bounds)
                kept = part.column("places")
                rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(kept).to_numpy())
                marks = np.zeros(len(words), np.uint64)
                at = bounds[:-1][rows] + kept.flatten().to_numpy()
                at = at[at < bounds[1:][rows]]  # rows with one id and texts of several lengths
                marks[at] = prefixes[at]
                # Windows that hold a marked place whose prefix is their least one.
                reach = _slide_equal(marks, least)
                window = run_hashes(words, PASSAGE)
                begin = np.flatnonzero(reach)
                row = np.searchsorted(bounds, begin, side="right") - 1
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window[begin].view(np.int64)), pa.array(ids[row]), pa.array((begin - bounds[row]).astype(np.int32))],
                    names=["window", "doc_id", "place"],
                )

    windows = cut_lineage(
        join_measured(texts, places, "doc_id").mapInArrow(extend, "window bigint, doc_id bigint, place int")
    )
    first = cut_lineage(
        windows.groupBy("window").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("window", "first")
    )
    # The repeated windows grow as the texts do, so they are joined by shuffle at every size.
    later = windows.join(first.hint("merge"), "window").where(F.struct("doc_id", "place") > F.col("first")).select(
        "doc_id", "place", F.col("first.doc_id").alias("first_doc_id"), F.col("first.place").alias("first_place")
    ).distinct()
    run = Window.partitionBy("doc_id", "first_doc_id", "shift").orderBy("place")
    passages = later.withColumn("shift", F.col("place") - F.col("first_place")).withColumn(
        "run", F.col("place") - F.row_number().over(run)
    ).groupBy("doc_id", "first_doc_id", "shift", "run").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    found = passages.select(
        "doc_id", F.col("start").cast("bigint").alias("start_word"), (F.col("n") + PASSAGE - 1).alias("n_words"), "first_doc_id",
        (F.col("start") - F.col("shift")).cast("bigint").alias("first_start_word"),
    )
    zero = F.lit(0).cast("bigint")
    return found.unionByName(copies.where(F.col("n_words") >= PASSAGE).distinct().select(
        "doc_id", zero.alias("start_word"), "n_words", "first_doc_id", zero.alias("first_start_word")
    ))


def _slide_equal(marks: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the window from each place on holds a mark equal to its least prefix."""
    held = np.zeros(len(marks), bool)
    at = np.flatnonzero(marks)
    for back in range(REACH):
        begin = at - back
        ok = begin >= 0
        held[begin[ok][least[begin[ok]] == marks[at[ok]]]] = True
    return held


def without_repeats(docs: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs``, with all columns, less the words of ``passages`` (as found by ``repeated_passages``).

    ``key`` is the column that was searched as doc_id. Rows of one key are cut
    alike; pass row numbers where ids repeat or are null.

    The first place of a passage stays. A document of which nothing is left
    goes; one that was empty or null stays. The spans of a document are sent to the
    scan if they are measured to be small, otherwise joined.
    """
    spans = cut_lineage(passages.groupBy(F.col("doc_id").alias("__cut_id")).agg(
        F.collect_set(F.struct(F.col("start_word").alias("start"), F.col("n_words").alias("n"))).alias("__cut_spans")
    ))
    marked = join_measured(docs, spans, F.col(key) == F.col("__cut_id"), "left").drop("__cut_id")
    names, text_at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            hit = np.flatnonzero(batch.columns[-1].is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, bool)
            if len(hit):
                texts = columns[text_at].to_pylist()
                for i in hit:
                    if texts[i] is not None:
                        texts[i] = cut_words(texts[i], [(s["start"], s["n"]) for s in batch.columns[-1][int(i)].as_py()])
                        keep[i] = bool(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return marked.mapInArrow(cut, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (start, number) and the blanks behind them."""
    begins = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    last = len(begins) - 1
    gone = np.zeros(last, bool)
    for start, n in spans:
        gone[start:start + n] = True
    if gone.all():
        return ""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at:begins[a]])
        at = begins[b]
    return ("".join(out) + text[at:]).rstrip(" \t\n\r\x0b\x0c")
