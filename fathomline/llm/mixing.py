"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.llm.common import WORD, as_written, join_measured
from fathomline.operators.counting import running_total
from fathomline.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
# Intensity of each weight's sources at the start and at the end of the training.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
INNER = "__mix_"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """Words to take from each source of ``sizes`` (source, source_size).

    Sources in order of code points, null last, take the weights in turn. A
    source at its ceiling stays there, and what is over is shared by weight
    among the rest until none is above. With the sources ordered by ceiling per
    weight, those at their ceiling come first, so one running sum finds them.
    One row per source; no row of a document is touched.
    """
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    base = sizes.withColumns({"weight": weight, "turn": turn}).withColumn("ceiling", F.col("source_size") * max_repeat)
    ordered = Window.orderBy(F.col("ceiling") / F.col("weight"), "turn")
    everything = Window.partitionBy(F.lit(0))
    ready = base.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "taken_before": F.sum("ceiling").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ceiling"),
        "weight_left": F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)),
    })
    full = F.col("ceiling") * F.col("weight_left") <= F.col("weight") * (F.col("budget") - F.col("taken_before"))
    marked = ready.withColumn("full", full)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(F.lit(0.0))).over(everything)
    full_words = F.sum(F.when(F.col("full"), F.col("ceiling")).otherwise(F.lit(0))).over(everything)
    shared = marked.withColumns({"open_weight": open_weight, "full_words": full_words})
    target = F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(
        F.col("weight") * (F.col("budget") - F.col("full_words")) / F.col("open_weight")
    )
    return shared.select("source", "source_size", target.alias("target"), F.col("turn").cast("int").alias("turn"))


def _position(offset: Column, goal: Column, turn: Column, schedule) -> Column:
    """Time in 0..1 at which a source whose intensity runs from a to b has asked for ``offset`` of ``goal`` words.

    The demand is the integral a*t + (b - a)/2 * t*t; this is its inverse.
    """
    pick = lambda side: F.element_at(
        F.array(*[F.lit(float(s[side])) for s in schedule]), (turn % len(schedule) + 1).cast("int")
    )
    a, b = pick(0), pick(1)
    asked = offset / goal * (a + b) / 2
    return F.when(a == b, asked / a).otherwise((F.sqrt(a * a + 2 * (b - a) * asked) - a) / (b - a) + F.lit(0.0))


def mixture(docs: DataFrame, size: Column, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2,
            schedule=SCHEDULE) -> DataFrame:
    """``docs`` with what the mix takes of each document, in columns that begin with ``__mix_``.

    A source's words stand in the order of a hash of the ids. Its target, a
    whole number of words, takes the whole source as often as it fits and then
    the first words of that order, so a source's sum meets its target exactly
    and one document of a source may be cut. Words at offset o of a source's
    demand stand at the time its integrated schedule reaches o.

    Only ids, sizes and hashes are sorted, over ranges of like size, so neither a
    source nor an id that a third of all rows share is one task's work. Rows
    are numbered where they are read, and get their places by these numbers;
    ``docs`` is read twice, and written first if it is not a plain read of files.
    """
    docs = as_written(docs)
    names = {k: f"{INNER}{k}" for k in ("row", "source", "size", "order", "id", "tie", "upto", "at")}
    rows = docs.withColumns({names["row"]: F.monotonically_increasing_id(), names["size"]: size})
    thin = cut_lineage(rows.select(
        names["row"], F.col("source").alias(names["source"]), names["size"], F.col("doc_id").alias(names["id"]),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(names["order"]),
        (F.xxhash64("text") if "text" in docs.columns else F.lit(0)).alias(names["tie"]),
    ))
    words = F.col(names["size"])
    sums = cut_lineage(thin.groupBy(F.col(names["source"]).alias("source")).agg(F.sum(words).alias("source_size")))
    targets = source_targets(sums, weights, share, max_repeat).select(
        F.col("source").alias(f"{INNER}src"), F.col("source_size").alias(f"{INNER}source_size"), F.col("target").alias(f"{INNER}target"),
        F.col("turn").alias(f"{INNER}turn"), F.round("target").cast("bigint").alias(f"{INNER}goal"),
    )
    order = [names[k] for k in ("order", "id", "size", "tie", "row")]
    placed = running_total(thin, [names["source"]], order, names["size"], names["upto"])
    placed = join_measured(placed, targets, F.col(names["source"]).eqNullSafe(F.col(f"{INNER}src")))
    placed = placed.withColumn(names["at"], F.col(names["upto"]) - words).drop(*[names[k] for k in ("source", "order", "id", "tie", "upto", "size")])
    joined = rows.join(placed, names["row"])
    goal, whole = F.col(f"{INNER}goal"), F.col(f"{INNER}source_size")
    placed = joined.withColumn(
        f"{INNER}full", F.when(whole > 0, F.floor(goal / F.greatest(whole, F.lit(1)))).otherwise(F.lit(0)).cast("bigint")
    )
    rest = goal - F.col(f"{INNER}full") * whole - F.col(f"{INNER}at")
    placed = placed.withColumn(f"{INNER}extra", F.greatest(F.lit(0).cast("bigint"), F.least(words, rest)))
    copies = F.when(words > 0, F.col(f"{INNER}full") + (F.col(f"{INNER}extra") > 0).cast("int")).otherwise(F.lit(0))
    placed = placed.withColumn(f"{INNER}copies", copies.cast("int")).withColumn(
        f"{INNER}taken", F.col(f"{INNER}full") * words + F.col(f"{INNER}extra")
    )
    times = F.transform(
        F.sequence(F.lit(0), F.col(f"{INNER}copies") - 1),
        lambda k: _position(k * whole + F.col(f"{INNER}at"), goal, F.col(f"{INNER}turn"), schedule),
    )
    return placed.withColumn(f"{INNER}times", F.when(F.col(f"{INNER}copies") > 0, times).otherwise(F.array().cast("array<double>")))


def mixed_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source), in training order: what the mix takes of it.

    Documents that are not taken have no position and come last. Defined
    results: a null text has no words; a null source is a source of its own;
    null and repeated ids are rows like others; an empty table gives none;
    other columns are not looked at.
    Returns doc_id, size, source_size, target, taken, position.
    """
    thin = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = mixture(thin, F.col("size"), **options).select(
        "doc_id", "size", F.col(f"{INNER}source_size").alias("source_size"), F.col(f"{INNER}target").alias("target"),
        F.col(f"{INNER}taken").alias("taken"), F.get(f"{INNER}times", F.lit(0)).alias("position"),
    )
    # Rows without a position are spread out behind the last one instead of meeting in one range.
    behind = 1 + F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 20)) / (1 << 20)
    return plan.repartitionByRange(F.coalesce("position", behind)).sortWithinPartitions(F.coalesce("position", behind))


def first_words(text: Column, words: Column) -> Column:
    """``text`` up to the end of its ``words``-th word."""
    blanks = r"[\x20\x09-\x0D]+"
    pieces = words + 1 + F.regexp_like(text, F.lit("^" + blanks)).cast("int")
    rest = F.element_at(F.split(text, blanks, pieces.cast("int")), -1)
    return F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(rest)))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, in training order, with the columns of ``docs``.

    A document that is taken twice stands there twice; the one document of a
    source at which its target ends is cut after its last word taken. Edge cases
    as for ``mixed_plan``; documents without words are never taken.
    """
    picked = mixture(docs, word_count(F.col("text")), **options).where(F.col(f"{INNER}copies") > 0)
    names = [f"`{c}`" for c in docs.columns]
    placed = picked.select(
        *names, f"{INNER}size", f"{INNER}extra", f"{INNER}full", F.posexplode(f"{INNER}times").alias(f"{INNER}nth", f"{INNER}time")
    )
    cut = (F.col(f"{INNER}nth") == F.col(f"{INNER}full")) & (F.col(f"{INNER}extra") < F.col(f"{INNER}size"))
    placed = placed.withColumn("text", F.when(cut, first_words(F.col("text"), F.col(f"{INNER}extra"))).otherwise(F.col("text")))
    return placed.repartitionByRange(F.col(f"{INNER}time")).sortWithinPartitions(f"{INNER}time").select(*names)
