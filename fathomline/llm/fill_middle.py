"""Fill-in-middle examples: documents cut at two ranks of an indexable skip list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import text_slices, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10  # of the documents stay as they are
SPM_PERCENT = 20  # of the others have the suffix in front
FAN = 4  # one node in so many of a lane stands in the lane above
SCHEMA = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"
)


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Where the units of a text begin: a run of ASCII letters is one unit, any other code point another."""
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    inside = np.zeros(len(points), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


class SkipList:
    """An indexable skip list over the units of a text.

    Lane 0 links all units. Each lane above links those of the lane below whose
    hash says so, one in ``FAN``. A link carries two widths: the units and the
    code points it skips. Heights come from a hash of the unit's number, so a
    text has the same lanes in every task.
    """

    def __init__(self, starts: np.ndarray, n_chars: int):
        self.n_units = len(starts)
        # Unit n_units stands behind the last one and ends all lanes.
        at = np.append(starts, n_chars)
        nodes = np.arange(self.n_units + 1)
        mixed = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = []  # widths of the links, in units and in code points
        self.down: list[np.ndarray] = []  # place of a lane's node in the lane below
        level = 0
        while True:
            self.lanes.append((np.diff(nodes), np.diff(at[nodes])))
            if len(nodes) <= 2 * FAN:
                break
            chosen = mixed[nodes] >> np.uint64(2 * level) & np.uint64(FAN - 1) == 0
            chosen[0] = chosen[-1] = True
            level += 1
            if level > 31:  # the hash has no bits left
                break
            self.down.append(np.flatnonzero(chosen))
            nodes = nodes[chosen]

    def chars_before(self, rank: int) -> int:
        """Code points before unit ``rank``: links are followed while they do not pass it, then the lane below is taken."""
        units = chars = place = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            by_units, by_chars = self.lanes[level]
            while place < len(by_units) and units + by_units[place] <= rank:
                units += int(by_units[place])
                chars += int(by_chars[place])
                place += 1
            if level:
                place = int(self.down[level - 1][place])
        return chars


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers that the id alone decides; a null id counts as an empty one."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i:8 * i + 8], 16) for i in range(4))


def transformed(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and the output for one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = unit_starts(points)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    units = SkipList(starts, len(points))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.chars_before(first), units.chars_before(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text an output was made of. No text in these forms holds a mark, so each mark's first place is its own."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return other + middle + head if form == "spm" else head + middle + other


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """A training example of each row of ``docs`` (doc_id, text) for filling in a middle.

    A text is cut into prefix, middle and suffix at two ranks among its units
    (runs of ASCII letters, or single code points), which the id decides. The
    ranks are found in a skip list built over the whole text. Rows are worked on
    where they are read: nothing is shuffled, and a task holds a few megabytes
    of text or one longer text.

    Defined results: a null text is an empty one; an empty text, one that holds
    a mark, and one in ten others stay plain; a null id draws as an empty id;
    repeated rows are rows of their own; an empty table gives none; other
    columns are not looked at.
    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (code points, null if plain), output, restored (the text
    rebuilt from output and form).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for part in text_slices(batch):
                rows = [transformed(i, t) for i, t in zip(part.column("doc_id").to_pylist(), texts_of(part))]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                back = [restored(output, form) for _, form, _, _, output in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(back, pa.string())],
                    names=["doc_id", *names, "restored"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, SCHEMA)
