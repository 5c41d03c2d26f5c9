"""Structured filters: one filter set on a table, or a table of filter sets.

SQL's three-valued logic holds throughout: a NULL field fails a set filter, and
a filter that is not set restricts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathomline.session import cut_lineage

# Filter columns of an item table, as the operators name them.
ITEM_SCOPE = ("atk", "def_", "level", "attribute", "properties")
# Filter columns of a prepared query table.
QUERY_SCOPE = ("eff_min", "eff_max", "min_def", "max_def", "level", "attribute", "card_type")


@dataclass(frozen=True)
class Filters:
    """One set of filters; ``None`` means not set."""

    min_atk: int | None = None
    max_atk: int | None = None
    min_def: int | None = None
    max_def: int | None = None
    level: int | None = None
    attribute: str | None = None
    card_type: str | None = None

    def is_empty(self) -> bool:
        return all(getattr(self, f.name) is None for f in fields(self))


def filter_predicate(f: Filters) -> Column:
    """The conjunction of the filters that are set, ``TRUE`` if none is."""
    tests = {
        "min_atk": lambda v: F.col("atk") >= v,
        "max_atk": lambda v: F.col("atk") <= v,
        "min_def": lambda v: F.col("def_") >= v,
        "max_def": lambda v: F.col("def_") <= v,
        "level": lambda v: F.col("level") == v,
        "attribute": lambda v: F.col("attribute") == v,
        "card_type": lambda v: F.array_contains("properties", v),
    }
    predicate = F.lit(True)
    for name, test in tests.items():
        value = getattr(f, name)
        if value is not None:
            predicate = predicate & test(F.lit(value))
    return predicate


def filter_items(items: DataFrame, f: Filters) -> DataFrame:
    """Items inside the filters; comparisons with literals reach the scan."""
    return items if f.is_empty() else items.where(filter_predicate(f))


def pair_predicate(q: str = "q", i: str = "i", names: Sequence[str] = QUERY_SCOPE) -> Column:
    """The same conjunction between the columns of two aliased tables."""
    item = {
        "eff_min": lambda v: F.col(f"{i}.atk") >= v,
        "eff_max": lambda v: F.col(f"{i}.atk") <= v,
        "min_def": lambda v: F.col(f"{i}.def_") >= v,
        "max_def": lambda v: F.col(f"{i}.def_") <= v,
        "level": lambda v: F.col(f"{i}.level") == v,
        "attribute": lambda v: F.col(f"{i}.attribute") == v,
        "card_type": lambda v: F.array_contains(F.col(f"{i}.properties"), v),
    }
    predicate = F.lit(True)
    for name in names:
        wanted = F.col(f"{q}.{name}")
        predicate = predicate & (wanted.isNull() | item[name](wanted))
    return predicate


def filter_pairs(queries: DataFrame, items: DataFrame, buckets: int = 32, shards: int = 8) -> DataFrame:
    """``(query_id, item_id)`` for every item inside the scope of every query.

    Never a join of rows: items are written once, in ``buckets`` ranges of ATK,
    and blocks of queries meet them in ``shards`` parts or more, a task each,
    which reads its files one after the other. Chunks of items are in order of
    ATK and list the places of each level, attribute and property, so a query
    looks only at the places its narrowest filter leaves. A task holds a chunk
    and hands on the items of a query as lists, a bounded number of pairs at a
    time; they become rows where they are used.
    """
    from fathomline.operators.blocks import QUERIES_PER_CELL, TASKS_PER_CORE, _blocks, _placed
    from fathomline.operators.pairs import PairFinder, chunks

    asked = cut_lineage(queries.select("query_id", *QUERY_SCOPE))
    held = cut_lineage(items.select("item_id", *ITEM_SCOPE).repartitionByRange(buckets, "atk", "item_id"))
    files = sorted(held.inputFiles())
    blocks = max(1, -(-asked.count() // QUERIES_PER_CELL))
    tasks = TASKS_PER_CORE * items.sparkSession.sparkContext.defaultParallelism
    # Neighbouring ranges go to different parts, so that no part has all that few queries ask for.
    parts = max(1, min(max(shards, -(-tasks // blocks)), len(files)))
    at_once = QUERIES_PER_CELL

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, at_once):
            # The blocks of a task all have its part, wherever their rows came from.
            part = table["cell"][0].as_py() % parts
            finder = PairFinder(table)
            for chunk in chunks(files[part::parts]):
                for ids, found in finder.pairs(chunk):
                    yield pa.RecordBatch.from_arrays([ids, found], names=["query_id", "item_ids"])

    kinds = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        T.StructField("item_ids", T.ArrayType(held.schema["item_id"].dataType)),
    ])
    found = _placed(asked, blocks, parts).mapInArrow(find, kinds)
    return found.select("query_id", F.explode("item_ids").alias("item_id"))


def property_index(items: DataFrame) -> DataFrame:
    """One row per item and property; the table form of an index on the array."""
    return items.select("item_id", F.explode(F.array_distinct(F.array_compact("properties"))).alias("property"))


def items_with_properties(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items that hold any property listed in ``wanted(property)``."""
    hits = property_index(items).join(wanted.select("property").distinct(), "property", "left_semi")
    return items.join(hits.select("item_id").distinct(), "item_id", "left_semi")
