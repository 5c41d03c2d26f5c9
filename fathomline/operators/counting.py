"""How many items lie inside each filter set of a table, counted without a row per pair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.session import cut_lineage

BLOCK_ROWS = 50_000  # points and corners of a block, which one task counts among themselves
HIGHEST = 1 << 62  # stands for a missing value: above all bounds, reached only by a query that sets none


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to and with each row in ``order``.

    Rows are range-sorted and summed within their part; what stands in earlier
    parts of a group is added from sums of the parts. A group of any size is
    many tasks' work. ``order`` is to tell the rows of a group apart; groups and
    order may hold NULL.
    """
    keys = [*group, *order]
    rows = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))
    offsets = parts.select(*group, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    local = rows.withColumn("__here", F.sum(value).over(here)).alias("l")
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, "__part")])
    return local.join(offsets.alias("o"), same).select("l.*", (F.col("__here") + F.col("__before")).alias(name)).drop("__here", "__part")


def _in_block(kind: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row, the sum of ``n`` over earlier rows with the same ``kind`` whose ``b`` is not larger.

    The places before a row are as many dyadic ranges as its number has bits;
    in each the rows are sorted by (kind, b) and summed once.
    """
    total = np.zeros(len(n), np.int64)
    place = np.arange(len(n))
    for bit in range(max(1, int(len(n)).bit_length())):
        node = place >> bit
        # A row asks the range left of it where its number has this bit; the others are in a range that may be asked.
        asks = node & 1 == 1
        key = np.where(asks, node - 1, node)
        order = np.lexsort((asks, b, kind, key))
        held = np.where(asks, 0, n)[order]
        sums = np.cumsum(held)
        new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(kind[order]) != 0))
        base = (sums - held)[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
        total[order] += np.where(asks[order], sums - base, 0)
    return total


def dominated(points: DataFrame, corners: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``corners`` (kind, a, b) with ``total``: the sum of ``n`` over ``points`` (kind, a, b, n) of its kind with no larger a and b.

    An offline sweep: points and corners are sorted by (kind, a, b) into blocks
    of like size. The points before a corner stand in its own block, where
    they are counted in a task, and in earlier blocks: these are as many dyadic
    ranges of blocks as the block's number has bits, and in each of them a
    corner's count is a running total by b. So a point is a row per level, and
    no point meets a corner.
    """
    marked = points.select("kind", "a", "b", "n", F.lit(False).alias("asks")).unionByName(
        corners.select("kind", "a", "b", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asks"))
    )
    keys = ["kind", "a", "b", "asks"]
    blocks = max(1, -(-marked.count() // block_rows))
    sorted_ = marked.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    rows = cut_lineage(sorted_.withColumn("block", F.spark_partition_id()))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(keys, kind="stable", ignore_index=True)
        found = _in_block(pd.factorize(frame["kind"])[0], frame["b"].to_numpy(), frame["n"].to_numpy())
        return frame.assign(total=found).loc[frame["asks"], ["kind", "a", "b", "total"]]

    own = rows.groupBy("block").applyInPandas(count, "kind string, a bigint, b bigint, total bigint")
    if blocks == 1:
        return own
    levels = F.sequence(F.lit(0), F.lit((blocks - 1).bit_length() - 1))
    by_level = rows.withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(block, level)"))
    left = by_level.where((~F.col("asks") & (F.col("node") % 2 == 0)) | (F.col("asks") & (F.col("node") % 2 == 1))).withColumn(
        "node", F.col("node") - F.col("asks").cast("int")
    )
    swept = running_total(left, ["kind", "level", "node"], ["b", "asks", "a"], "n", "total")
    earlier = swept.where("asks").select("kind", "a", "b", "total")
    return own.unionByName(earlier).groupBy("kind", "a", "b").agg(F.sum("total").alias("total"))


def filter_counts(queries: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, n_items)``: how many of ``items`` lie inside the scope of each of ``queries``, none included.

    Level, attribute and property are looked up in postings: an item is counted
    once for each combination of them that queries restrict, of which there are
    eight at most, times its properties. Inside a combination the ranges of ATK
    and DEF are a rectangle, and its count is a sum over its four corners, each
    the number of items no larger in both. Equal points and equal corners are
    one row each. A missing value counts above all bounds, so that only a
    query without a bound there reaches it.
    """
    has = {name: F.col(name).isNotNull() for name in ("level", "attribute", "card_type")}
    asked = queries.withColumn("mask", sum((F.when(has[n], 1 << i).otherwise(0) for i, n in enumerate(has)), F.lit(0)))
    value = {"level": F.col("level").cast("bigint"), "attribute": F.col("attribute"), "card_type": F.col("card_type")}
    kind = F.to_json(F.struct("mask", *[value[n].alias(n) for n in value]))

    def limits(low: str, high: str) -> tuple[Column, Column]:
        free = F.col(low).isNull() & F.col(high).isNull()
        upper = F.when(free, F.lit(HIGHEST)).otherwise(F.least(F.coalesce(F.col(high).cast("bigint"), F.lit(HIGHEST - 1)), F.lit(HIGHEST - 1)))
        return F.col(low).cast("bigint") - 1, upper

    a_low, a_high = limits("eff_min", "eff_max")
    b_low, b_high = limits("min_def", "max_def")
    corner = lambda sign, a, b: F.struct(F.lit(sign).cast("bigint").alias("sign"), a.alias("a"), b.alias("b"))
    # A rectangle that is turned over holds nothing: its corners are left out.
    right = (a_low.isNull() | (a_low < a_high)) & (b_low.isNull() | (b_low < b_high))
    four = F.array(corner(1, a_high, b_high), corner(-1, a_low, b_high), corner(-1, a_high, b_low), corner(1, a_low, b_low))
    named = cut_lineage(asked.select("query_id", "mask", kind.alias("kind"), F.when(right, four).otherwise(F.array()).alias("corners")))
    wanted = named.select("query_id", "kind", F.inline("corners")).where("a is not null and b is not null")
    corners = cut_lineage(wanted.select("kind", "a", "b").distinct())
    masks = [r.mask for r in named.select("mask").distinct().collect()]  # eight at most

    def posting(mask: int) -> DataFrame:
        held = items.select("level", "attribute", F.array_distinct(F.array_compact("properties")).alias("held"), "atk", "def_")
        held = held.select("*", F.explode("held").alias("card_type")) if mask & 4 else held.withColumn("card_type", F.lit(None).cast("string"))
        for i, name in enumerate(("level", "attribute")):
            held = held.where(F.col(name).isNotNull()) if mask & 1 << i else held.withColumn(name, F.lit(None).cast(dict(held.dtypes)[name]))
        return held.select(
            F.to_json(F.struct(F.lit(mask).alias("mask"), *[value[n].alias(n) for n in value])).alias("kind"),
            *[F.coalesce(F.col(c).cast("bigint"), F.lit(HIGHEST)).alias(n) for c, n in (("atk", "a"), ("def_", "b"))],
        )

    none = named.select("query_id", F.lit(0).cast("bigint").alias("n"))
    if not masks:
        return none.withColumnRenamed("n", "n_items")
    points = posting(masks[0])
    for mask in masks[1:]:
        points = points.unionByName(posting(mask))
    points = points.join(corners.select("kind").distinct(), "kind", "left_semi").groupBy("kind", "a", "b").agg(F.count("*").alias("n"))
    totals = dominated(cut_lineage(points), corners, block_rows)
    signed = wanted.join(totals, ["kind", "a", "b"]).select("query_id", (F.col("sign") * F.col("total")).alias("n"))
    return none.unionByName(signed).groupBy("query_id").agg(F.sum("n").alias("n_items"))
