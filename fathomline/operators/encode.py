"""Text to vectors with pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.trigram import padded_words

Encode = Callable[[Sequence[str]], Sequence[Sequence[float]]]

# Fixed values of the hashed encoder: slot = (a * 961 + b * 31 + c) mod dims.
SLOT_FACTORS = (961, 31, 1)
BLANK = 32


class Encoder(Protocol):
    def prepare(self, text: Column) -> Column:
        """What is sent to the encoder, as an expression of the text."""

    def load(self) -> Encode:
        """Called once per Python task; the result encodes lists of texts."""


@dataclass(frozen=True)
class HashedTrigramEncoder:
    """Counts of hashed trigrams, scaled to length one.

    A stand-in that needs no model: texts that share words get near vectors.
    Words are split by Spark, only the counting is done here.
    """

    dims: int = 64

    def prepare(self, text: Column) -> Column:
        return padded_words(text)

    def load(self) -> Encode:
        dims = self.dims

        def encode(texts: Sequence[str]) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            for some in _some_at_once(texts):
                out.extend(hashed_counts(some, dims))
            return out

        return encode


# Characters that are counted together: many short texts, or one long one.
CHARACTERS_AT_ONCE = 100_000


def _some_at_once(texts: Sequence[str]) -> Iterator[list[str]]:
    held: list[str] = []
    total = 0
    for text in texts:
        if held and total + len(text) > CHARACTERS_AT_ONCE:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def hashed_counts(padded: Sequence[str], dims: int) -> np.ndarray:
    """A row per padded text: counts of its hashed trigrams, scaled to length one."""
    code = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(padded)), [len(text) for text in padded])
    a, b, c = code[:-2], code[1:-1], code[2:]
    # Windows that end in two blanks lie between words, and none reaches into the next text.
    inside = ((b != BLANK) | (c != BLANK)) & (row[:-2] == row[2:])
    slot = (a * SLOT_FACTORS[0] + b * SLOT_FACTORS[1] + c * SLOT_FACTORS[2]) % dims
    at = row[:-2][inside] * dims + slot[inside]
    counts = np.bincount(at, minlength=len(padded) * dims).astype(np.float64).reshape(len(padded), dims)
    length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    return counts / np.where(length == 0, 1.0, length)


def encode_column(encoder: Encoder, on_error: str = "null") -> Callable[[Column], Column]:
    """A column function giving ``struct<vector, error>``.

    A batch that fails is tried again row by row; with ``on_error="null"`` the
    rows that still fail get no vector and an error text, with ``"fail"`` the
    task fails.
    """
    if on_error not in ("null", "fail"):
        raise ValueError(f"on_error must be 'null' or 'fail', not {on_error!r}")

    def as_list(vector) -> list[float]:
        return np.asarray(vector, dtype=np.float32).tolist()

    @F.pandas_udf("vector array<float>, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder.load()
        for texts in parts:
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            at = [i for i, text in enumerate(texts) if text is not None]
            wanted = [texts.iloc[i] for i in at]
            try:
                for i, vector in zip(at, encode(wanted) if wanted else [], strict=True):
                    vectors[i] = as_list(vector)
            except Exception:
                if on_error == "fail":
                    raise
                for i, text in zip(at, wanted):
                    try:
                        vectors[i], errors[i] = as_list(encode([text])[0]), None
                    except Exception as problem:
                        vectors[i], errors[i] = None, f"{type(problem).__name__}: {problem}"
            yield pd.DataFrame({"vector": vectors, "error": errors}, columns=["vector", "error"]).astype(object)

    # Kept from being copied or moved by the optimizer: an encoder is costly.
    once = run.asNondeterministic()
    return lambda text: once(encoder.prepare(text))


def embed(
    df: DataFrame,
    text_col: str,
    encoder: Encoder,
    out_col: str = "embedding",
    on_error: str = "null",
    error_col: str | None = None,
) -> DataFrame:
    """Adds the vector of ``text_col``; NULL text has no vector."""
    made = df.withColumn("__made", encode_column(encoder, on_error)(F.col(text_col)))
    out = made.withColumn(out_col, F.col("__made.vector"))
    if error_col:
        out = out.withColumn(error_col, F.col("__made.error"))
    return out.drop("__made")


def embed_many(
    df: DataFrame,
    text_col: str,
    encoders: Mapping[str, Encoder | None],
    on_error: str = "null",
    error_col: str | None = None,
) -> DataFrame:
    """One vector column per encoder; a missing encoder gives a NULL column.

    ``error_col`` holds the first error of a row's encoders.
    """
    errors = []
    for column, encoder in encoders.items():
        if encoder is None:
            df = df.withColumn(column, F.lit(None).cast("array<float>"))
        else:
            errors.append(f"__error_{column}")
            df = embed(df, text_col, encoder, column, on_error, errors[-1])
    if error_col:
        df = df.withColumn(error_col, F.coalesce(*errors, F.lit(None).cast("string")))
    return df.drop(*errors)
