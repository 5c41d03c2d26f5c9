"""Leading-edge debounce: an event is kept if the last kept one is far enough back.

Which events are kept depends on the whole chain before them, so a plain ``lag``
is not enough; and one key may hold a large part of all events, so a key cannot
be one task's work either. The chain is cut into stretches of time instead:

1. equal timestamps of a key are folded into one (only the first can be kept);
2. per stretch, a table says for each event that could be the first kept one
   where the chain leaves the stretch. Only events within one window of the
   stretch's start can be, a small part of it;
3. such tables are functions of the last kept event, and functions compose: the
   tables of up to ``FAN`` neighbouring stretches become one of the same form,
   level by level, until one node is left of each key. Then the last kept event
   before each node is handed down the same levels: a parallel scan, in which
   no task sees more than one node of a key at a time;
4. with that known, all stretches pick their kept events in parallel.

All steps work on whole Arrow batches; the most any holds is one batch and the
tables of one node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.session import cut_lineage

# Windows per stretch, and nodes that are composed to one of the next level.
STRETCH = 1024
FAN = 64


def _starts(frame: pd.DataFrame, by: str = "__part") -> np.ndarray:
    """Positions where a new (key, stretch or node) begins."""
    key, part = frame["__key"].to_numpy(), frame[by].to_numpy()
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])


def whole_stretches(parts: Iterator[pd.DataFrame], by: str = "__part") -> Iterator[pd.DataFrame]:
    """The same rows, regrouped so that no stretch (or node) is divided between frames."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if part.empty:
            continue
        last = _starts(part, by)[-1]
        same = bool(held) and (held[-1][["__key", by]].iloc[-1] == part[["__key", by]].iloc[0]).all()
        if last == 0 and same:
            held.append(part)
            continue
        if last == 0:
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [part]
            continue
        yield pd.concat([*held, part.iloc[:last]], ignore_index=True)
        held = [part.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


class Chains:
    """All stretches of a frame laid out on one ascending axis."""

    def __init__(self, frame: pd.DataFrame, span: int, window: int):
        self.window = window
        self.starts = _starts(frame)
        sizes = np.diff(np.r_[self.starts, len(frame)])
        self.run = np.repeat(np.arange(len(self.starts)), sizes)
        self.ends = self.starts + sizes
        self.times = frame["__us"].to_numpy()
        # Twice the span, so that one window past a stretch is still short of the next.
        self.step = 2 * span
        self.origin = frame["__part"].to_numpy()[self.starts] * span
        self.axis = self.run * self.step + (self.times - self.origin[self.run])
        # The next event a kept event lets through; its own end if there is none.
        self.following = np.minimum(np.searchsorted(self.axis, self.axis + window), self.ends[self.run])

    def leaves(self) -> np.ndarray:
        """For each event, the last time kept in its stretch if it is kept."""
        at = np.arange(len(self.times))
        goes_on = self.following < self.ends[self.run]
        step = np.where(goes_on, self.following, at)
        while True:
            further = step[step]
            if np.array_equal(further, step):
                return self.times[step]
            step = further

    def enterable(self) -> np.ndarray:
        """Events a chain may enter a stretch at: those in its first window and the next."""
        beyond = np.searchsorted(self.axis, np.arange(len(self.starts)) * self.step + self.window)
        return np.arange(len(self.times)) <= beyond[self.run]

    def kept(self, last: np.ndarray) -> np.ndarray:
        """Positions kept, given the last kept time before each stretch (NaN: none)."""
        offset = np.maximum(np.nan_to_num(last + self.window - self.origin, nan=0.0), 0).astype(np.int64)
        front = np.searchsorted(self.axis, np.arange(len(self.starts)) * self.step + offset)
        ends = self.ends
        marked = np.zeros(len(self.times), dtype=bool)
        while len(front):
            alive = front < ends
            front, ends = front[alive], ends[alive]
            marked[front] = True
            front = self.following[front]
        return np.flatnonzero(marked)


class Tables:
    """The entry-to-leave tables of a frame: per (key, node) those of its children, in order of time."""

    def __init__(self, frame: pd.DataFrame, window: int):
        self.window = window
        self.entry, self.leave = frame["entry"].to_numpy(), frame["leave"].to_numpy()
        self.begins = _starts(frame, "__node")
        self.ends = np.append(self.begins[1:], len(frame))
        children = _starts(frame)
        self.children = np.unique(np.concatenate([children, self.begins]))

    def nodes(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Each node, and where the tables of its children begin and end."""
        edges = np.append(self.children, len(self.entry))
        first = np.searchsorted(self.children, self.begins)
        last = np.append(first[1:], len(self.children))
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            yield i, list(zip(edges[a:b].tolist(), edges[a + 1:b + 1].tolist()))

    def after(self, last: np.ndarray, table: tuple[int, int]) -> np.ndarray:
        """The last kept times behind a child, given those before it."""
        entry, leave = self.entry[slice(*table)], self.leave[slice(*table)]
        at = np.searchsorted(entry, last + self.window)
        return np.where(at < len(entry), leave[np.minimum(at, len(entry) - 1)], last)

    def composed(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes that start at ``starts``: positions of the entries that can be met first, and where the chain then leaves the node."""
        positions, leaves = [], []
        for i, tables in self.nodes():
            begin, end = int(self.begins[i]), int(self.ends[i])
            beyond = begin + int(np.searchsorted(self.entry[begin:end], starts[i] + self.window))
            at = np.arange(begin, min(beyond + 1, end))
            last = self.leave[at].copy()
            for table in tables[1:]:
                earlier = int(np.searchsorted(at, table[0]))
                last[:earlier] = self.after(last[:earlier], table)
            positions.append(at)
            leaves.append(last)
        return np.concatenate(positions), np.concatenate(leaves)

    def entered(self, last: list[int | None]) -> list[int | None]:
        """The last kept time before each child, given that before each node."""
        out: list[int | None] = []
        for i, tables in self.nodes():
            held = last[i]
            for table in tables:
                out.append(held)
                held = int(self.leave[table[0]]) if held is None else int(self.after(np.array([held]), table)[0])
        return out


def _entering(tables: DataFrame, window_us: int, span: int, fan: int) -> DataFrame:
    """(__key, __part, last): the last kept time before each stretch, null if there is none; from (__key, __part, entry, leave)."""
    first, final = tables.agg(F.min("__part"), F.max("__part")).first()
    first, final = first or 0, final or 0
    base, unit, levels = first * span, span, [tables.withColumn("__part", F.col("__part") - first)]
    schema = "__key string, __part bigint, entry bigint, leave bigint"

    def by_node(df: DataFrame) -> DataFrame:
        nodes = df.withColumn("__node", F.floor(F.col("__part") / fan))
        return nodes.repartition("__key", "__node").sortWithinPartitions("__key", "__node", "__part", "entry")

    def compose(unit: int):
        def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in whole_stretches(parts, "__node"):
                held = Tables(frame, window_us)
                at, leave = held.composed(base + frame["__node"].to_numpy()[held.begins] * unit)
                yield frame[["__key", "__node", "entry"]].iloc[at].rename(columns={"__node": "__part"}).assign(leave=leave)

        return work

    def descend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_stretches(parts, "__node"):
            held = Tables(frame, window_us)
            before = frame["last"].astype("Int64").iloc[held.begins]
            last = held.entered([None if x is pd.NA else int(x) for x in before])
            yield frame[["__key", "__part"]].iloc[held.children].assign(last=pd.array(last, "Int64"))

    while fan ** len(levels) < final - first + 1:
        unit *= fan
        levels.append(cut_lineage(by_node(levels[-1]).mapInPandas(compose(unit), schema)))
    last = None
    for table in reversed(levels):
        nodes = table.withColumn("__node", F.floor(F.col("__part") / fan))
        if last is None:
            nodes = nodes.withColumn("last", F.lit(None).cast("bigint"))
        else:
            nodes = nodes.join(last.withColumnRenamed("__part", "__node"), ["__key", "__node"])
        sorted_ = nodes.repartition("__key", "__node").sortWithinPartitions("__key", "__node", "__part", "entry")
        last = sorted_.mapInPandas(descend, "__key string, __part bigint, last bigint")
    return last.withColumn("__part", F.col("__part") + first)


def instant(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (then UTC)."""
    value = F.col(ts)
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        value = F.concat(value.cast("string"), F.lit("Z")).cast("timestamp")
    return F.unix_micros(value)


def debounce(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    window_us: int,
    tie_breaker: str,
    stretch: int = STRETCH,
    fan: int = FAN,
) -> DataFrame:
    """The kept rows of ``events``.

    ``ts`` is a timestamp and ``window_us`` is in microseconds. Of several
    events of a key at the same instant the one with the smallest
    ``tie_breaker`` stands first; the tie breaker is unique within a key.
    """
    span = window_us * stretch
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    keyed = events.withColumns({"__key": key, "__us": instant(events, ts)})
    # Folded within each task before the shuffle.
    instants = keyed.groupBy("__key", "__us").agg(F.min(tie_breaker).alias("__first"))
    instants = instants.withColumn("__part", F.floor(F.col("__us") / span))

    def by_stretch(df: DataFrame) -> DataFrame:
        return df.repartition("__key", "__part").sortWithinPartitions("__key", "__part", "__us")

    def tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_stretches(parts):
            chains = Chains(frame, span, window_us)
            table = frame[["__key", "__part"]].assign(entry=chains.times, leave=chains.leaves())
            yield table[chains.enterable()]

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_stretches(parts):
            chains = Chains(frame, span, window_us)
            last = frame["last"].to_numpy(dtype="float64", na_value=np.nan)[chains.starts]
            yield frame[["__key", "__first"]].iloc[chains.kept(last)]

    entry_tables = by_stretch(instants).mapInPandas(tables, "__key string, __part bigint, entry bigint, leave bigint")
    entering = _entering(cut_lineage(entry_tables), window_us, span, fan)
    first_type = instants.schema["__first"].dataType.simpleString()
    chosen = by_stretch(instants.join(entering, ["__key", "__part"])).mapInPandas(
        pick, f"__key string, __first {first_type}"
    )
    kept = chosen.select("__key", F.col("__first").alias(tie_breaker))
    return keyed.join(kept, ["__key", tie_breaker], "left_semi").select(*events.columns)
