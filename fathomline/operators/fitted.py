"""An encoder fitted to a table of texts: truncated singular vectors of its weighted trigram counts.

Texts are rows of a matrix with one column per hashed trigram: the logarithm of
its count, times how rare the trigram is, scaled to length one. The leading
right singular vectors are found by subspace iteration. A pass over the table
multiplies each task's rows by a thin matrix and back; what leaves a task, and
what the driver holds, is ``features`` rows of that matrix, whatever the number
and the lengths of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.functions.trigram import padded_words
from fathomline.operators.encode import BLANK, SLOT_FACTORS
from fathomline.session import cut_lineage, deal

FEATURES = 2048
OVERSAMPLE = 16
ITERATIONS = 3
# Rows multiplied at a time.
CHUNK = 256


def trigram_counts(padded: str, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns a text of padded words has, and how often."""
    code = np.frombuffer(padded.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(code) < 3:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    a, b, c = code[:-2], code[1:-1], code[2:]
    # Windows that end in two blanks lie between words.
    inside = (b != BLANK) | (c != BLANK)
    slots = ((a * SLOT_FACTORS[0] + b * SLOT_FACTORS[1] + c * SLOT_FACTORS[2]) % features)[inside]
    found, counts = np.unique(slots, return_counts=True)
    return found.astype(np.int32), counts.astype(np.int32)


def weighted_rows(slots: Sequence[np.ndarray], counts: Sequence[np.ndarray], rarity: np.ndarray) -> np.ndarray:
    """Rows of the matrix; a text without trigrams is a row of zeros."""
    out = np.zeros((len(slots), len(rarity)))
    if len(slots):
        row = np.repeat(np.arange(len(slots)), [len(found) for found in slots])
        column, n = np.concatenate(slots), np.concatenate(counts)
        value = (1 + np.log(n)) * rarity[column]
        length = np.sqrt(np.bincount(row, value**2, minlength=len(slots)))
        out[row, column] = value / length[row]
    return out


def used_columns(slots: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The columns that some of the texts have, and the columns of each text by their places there."""
    used, places = np.unique(np.concatenate(slots), return_inverse=True)
    return used, np.split(places, np.cumsum([len(found) for found in slots])[:-1])


def counted(texts: DataFrame, text_col: str, features: int) -> DataFrame:
    """``slots, counts`` of each text that is not NULL."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [trigram_counts(text, features) for text in part["padded"]]
            yield pd.DataFrame({"slots": [m[0] for m in made], "counts": [m[1] for m in made]})

    padded = texts.where(F.col(text_col).isNotNull()).select(padded_words(F.col(text_col)).alias("padded"))
    return padded.mapInPandas(count, "slots array<int>, counts array<int>")


def rarities(rows: DataFrame, features: int) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the trigram)) + 1 of each column; at most ``features`` rows reach the driver."""
    n = rows.count()
    held = np.zeros(features)
    for slot, texts in rows.select(F.explode("slots").alias("slot")).groupBy("slot").count().toLocalIterator():
        held[slot] = texts
    return np.log((1 + n) / (1 + held)) + 1


def multiplied(rows: DataFrame, rarity: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """Transposed matrix times matrix times ``thin``: one pass; partial products are added by Spark, a row of them at a time."""
    width = thin.shape[1]

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(thin)
        for part in parts:
            for start in range(0, len(part), CHUNK):
                at = slice(start, start + CHUNK)
                # A few texts have few of the columns; the others would be multiplied as zeros.
                used, places = used_columns(part["slots"].iloc[at].tolist())
                block = weighted_rows(places, part["counts"].iloc[at].tolist(), rarity[used])
                total[used] += block.T @ (block @ thin[used])
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pd.DataFrame({"slot": used.astype(np.int32), "values": list(total[used])})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": part["slot"].iloc[:1], "values": [np.sum(part["values"].tolist(), axis=0)]})

    schema = "slot int, values array<double>"
    # A group holds one row per task that saw the column; a level of tasks between would serve tens of thousands of them.
    sums = rows.mapInPandas(partial, schema).groupBy("slot").applyInPandas(added, schema)
    out = np.zeros((len(rarity), width))
    for slot, values in sums.toLocalIterator():
        out[slot] = values
    return out


@dataclass(frozen=True)
class FittedEncoder:
    """Projects weighted trigram counts on the fitted directions and scales to length one.

    Goes wherever an ``Encoder`` goes. A text that shares no trigram with the
    fitted table has a vector of zeros, which no search ranks.
    """

    rarity: np.ndarray
    directions: np.ndarray
    strengths: np.ndarray

    @property
    def dims(self) -> int:
        return self.directions.shape[1]

    def prepare(self, text: Column) -> Column:
        return padded_words(text)

    def load(self) -> Callable[[Sequence[str]], np.ndarray]:
        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dims))
            for start in range(0, len(texts), CHUNK):
                counts = [trigram_counts(text, len(self.rarity)) for text in texts[start:start + CHUNK]]
                used, places = used_columns([c[0] for c in counts])
                block = weighted_rows(places, [c[1] for c in counts], self.rarity[used])
                out[start:start + CHUNK] = block @ self.directions[used]
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            # What is left of a row that lies outside the fitted space is rounding.
            return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 1e-9)

        return encode

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per hashed trigram, and one (-1) for the strengths."""
        rows = [(i, float(r), d.tolist()) for i, (r, d) in enumerate(zip(self.rarity, self.directions))]
        rows.append((-1, 0.0, self.strengths.tolist()))
        spark.createDataFrame(rows, "slot int, rarity double, direction array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> FittedEncoder:
        rows = spark.read.parquet(path).orderBy("slot").collect()
        return FittedEncoder(
            np.array([r.rarity for r in rows[1:]]), np.array([r.direction for r in rows[1:]]), np.array(rows[0].direction)
        )


def fit_encoder(
    texts: DataFrame,
    text_col: str,
    dims: int,
    features: int = FEATURES,
    oversample: int = OVERSAMPLE,
    iterations: int = ITERATIONS,
    seed: int = 7,
) -> FittedEncoder:
    """An encoder of ``dims`` dimensions fitted to all ``texts``.

    The table is counted once and written; it is read once more for the
    rarities and once for each of ``iterations`` + 1 products. NULL texts take
    no part. Directions whose strength is nothing, as on a table with fewer
    different texts than ``dims``, are zeros. Each direction's sign makes its
    largest part positive, so that fits agree.
    """
    if not 0 < dims <= features:
        raise ValueError(f"dims must be between 1 and the {features} features, not {dims}")
    # As many files as tasks, so that the passes over them use all cores too.
    rows = cut_lineage(counted(deal(texts.select(text_col)), text_col, features))
    rarity = rarities(rows, features)
    basis = np.random.default_rng(seed).standard_normal((features, min(features, dims + oversample)))
    basis = np.linalg.qr(basis)[0]
    for _ in range(iterations):
        basis = np.linalg.qr(multiplied(rows, rarity, basis))[0]
    small = basis.T @ multiplied(rows, rarity, basis)
    squares, inner = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-squares, kind="stable")[:dims]
    squares = np.maximum(squares[order], 0)
    directions = basis @ inner[:, order]
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(dims)])
    directions[:, squares <= 1e-12 * max(squares.max(initial=0.0), 1e-300)] = 0
    return FittedEncoder(rarity, directions, np.sqrt(squares))
