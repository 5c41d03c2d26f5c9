"""Sharding by sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.session import cut_lineage

PER_RANGE = 64  # sampled keys for each range
MAX_RANGES = 4096


def _splitters(rows: DataFrame, ranges: int, total: int) -> list:
    """Keys that cut ``rows`` into about ``ranges`` ranges of equal size.

    A row is drawn once for each step of a grid over sizes that falls into it,
    the grid shifted by a hash of the row: large rows are drawn more often, and
    about ``PER_RANGE`` draws fall into each range. The sample is bounded by
    ``ranges * PER_RANGE`` draws, whatever the table.
    """
    shift = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    draws = F.floor(F.col("size") * F.lit(ranges * PER_RANGE / total) + shift)
    sample = rows.select(F.struct("key", "doc_id", "uid").alias("at"), draws.alias("draws")).where("draws > 0")
    seen = F.sum("draws").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    cuts = sample.select("at", "draws", seen.alias("seen")).where(
        F.floor(F.col("seen") / PER_RANGE) > F.floor((F.col("seen") - F.col("draws")) / PER_RANGE)
    )
    return [r["at"] for r in cuts.orderBy("at").select("at").collect()]


def _range_of(splitters: list) -> Column:
    """Number of splitters at or below a row, by binary search."""
    if not splitters:
        return F.lit(0)
    cuts = F.array(*[
        F.struct(F.lit(s["key"]).cast("bigint").alias("key"), F.lit(s["doc_id"]).cast("bigint").alias("doc_id"),
                 F.lit(s["uid"]).cast("bigint").alias("uid"))
        for s in splitters
    ])
    steps = [1 << i for i in range(len(splitters).bit_length() - 1, -1, -1)]
    at = F.struct(F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))

    def halve(found: Column, step: Column) -> Column:
        fits = found + step <= len(splitters)
        return F.when(fits & (F.get(cuts, found + step - 1) <= at), found + step).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def shard_by_ranges(docs: DataFrame, shards: int = 24, range_rows: int = 100_000) -> DataFrame:
    """Puts ``docs`` (doc_id, text) into ``shards`` shards of nearly equal size in bytes.

    Rows are ordered by a hash of the text, so that equal texts lie together,
    then by doc_id. Size-weighted samples of that key give the splitters of
    more ranges than shards; ranges that turn out to hold over twice their part
    are subdivided by a hash of the row, so that no text that a third of all
    rows share lies in one task. Sizes are summed within ranges and carried
    over from range to range; a row belongs to the shard its middle byte falls
    into. A shard is therefore off the mean by one text at most.

    Defined results: a null text has no bytes and the crc of an empty one;
    a null doc_id is a value like any other; repeated rows are rows of their
    own; an empty table gives none; other columns are not looked at.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, range_id.
    """
    text = F.col("text")
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
    ))
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    ranges = min(max(4 * shards, count // range_rows), MAX_RANGES)
    ranged = rows.withColumn("range_id", _range_of(_splitters(rows, ranges, total)))

    # At most MAX_RANGES rows, and a few more once subdivided: bounded, sent to all tasks.
    parts = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes")).select(
        "range_id", F.ceil(F.col("bytes") / F.lit(2 * total / ranges)).alias("parts")
    )
    pieces = ranged.join(F.broadcast(parts), "range_id").withColumn(
        "sub", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("uid"), F.col("parts"))).otherwise(F.lit(0).cast("bigint"))
    ).drop("parts")
    before = Window.orderBy("range_id", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("range_id", "sub").agg(F.sum("size").alias("bytes")).select(
        "range_id", "sub", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("range_id", "sub").orderBy("key", "doc_id", "uid")
    middle = F.col("start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = cut_lineage(pieces.join(F.broadcast(starts), ["range_id", "sub"]).select(
        "doc_id", "size", "crc", "range_id", "sub", F.row_number().over(within).alias("nth"),
        F.least(F.floor(middle / F.lit(total) * shards), F.lit(shards - 1)).cast("int").alias("shard"),
    ))
    held = placed.groupBy("shard", "range_id", "sub").agg(F.count("*").alias("held"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range_id", "sub").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    return placed.join(F.broadcast(held), ["shard", "range_id", "sub"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nth") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("range_id").cast("int").alias("range_id"),
    )
