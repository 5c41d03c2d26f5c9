"""The prefix trie of conversations, summed up along its Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.llm.common import WORD
from fathomline.session import cut_lineage

LAST_ARCS = 20_000  # a tour of so many arcs is ranked in one task
BUCKET = 4096  # siblings are linked in groups of about so many
PIECE = 4096  # ids in a piece of a hashed list
ROOT = (0, 0)


def _ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, a, b, words): the turns of each conversation numbered from 1.

    Turns are range-sorted, so a conversation of any length spreads over parts
    of like size; places in a part are counted there, and what stands in
    earlier parts is added from counts. Equal turns stand in the order of their
    hashes. ``a`` and ``b`` are two hashes of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    thin = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(F.lit("a"), role, text).alias("a"),
        F.xxhash64(F.lit("b"), text, role).alias("b"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).alias("words"),
        F.monotonically_increasing_id().alias("nth"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("a"), F.col("b"), F.col("nth")]
    dealt = thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = cut_lineage(dealt)
    here = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = rows.withColumn("pos", F.row_number().over(here).cast("bigint"))
    return local.join(offsets, ["conv_id", "part"]).select("conv_id", "part", (F.col("pos") + F.col("offset")).alias("pos"), "a", "b", "words")


def _at(depth: str) -> tuple[Column, Column]:
    """Hashes of a turn in its place; those of a path's turns, combined by xor, are the path's key."""
    return F.xxhash64(depth, "a"), F.xxhash64("b", depth)


def members(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """The paths of all rebuilt conversations.

    A conversation is rebuilt of the first ``head`` turns of ``base``, and of its
    own turns after its first ``head``. The key of a path is an exclusive-or of
    its turns' hashes (twice 64 bits), each hashed with its depth; so it is a
    running aggregate that can be carried over from part to part, and no
    conversation has to be in one place.
    Returns (conv_id, depth, a, b, pa, pb, words), a row per turn with the key of
    its path and of the path before it, and (conv_id, a, b), the whole path of
    each conversation.
    """
    turns = cut_lineage(_ordered_turns(turns))
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    lengths = sizes.groupBy("conv_id").agg(F.sum("n").alias("length"))
    convs = lengths.withColumns({"head": head.cast("bigint"), "base": base.cast("bigint")})
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = cut_lineage(convs.join(of_base, "base", "left").withColumn(
        "kept", F.least("head", F.coalesce("base_length", F.lit(0)))
    ))
    at_a, at_b = _at("depth")
    # A few turns of the base for each conversation.
    most = convs.agg(F.max("kept")).first()[0] or 0
    heads = convs.where("kept > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("bigint"), "kept")).alias("depth")).join(
        turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "a", "b", "words"),
        ["base", "depth"],
    )
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    first = cut_lineage(heads.select("conv_id", "depth", "words", at_a.alias("xa"), at_b.alias("xb")).select(
        "conv_id", "depth", "words", "xa", "xb", F.bit_xor("xa").over(path).alias("a"), F.bit_xor("xb").over(path).alias("b")
    ))
    of_heads = first.groupBy("conv_id").agg(F.bit_xor("xa").alias("ha"), F.bit_xor("xb").alias("hb"))

    known = sizes.join(convs.select("conv_id", "head", (F.col("kept") - F.col("head")).alias("shift")), "conv_id").drop("n")
    own = turns.join(known, ["conv_id", "part"]).where("pos > head").withColumn("depth", F.col("pos") + F.col("shift"))
    own = cut_lineage(own.select("conv_id", "part", "depth", "words", at_a.alias("xa"), at_b.alias("xb")))
    totals = own.groupBy("conv_id", "part").agg(F.bit_xor("xa").alias("ta"), F.bit_xor("xb").alias("tb"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(x: str, h: str) -> Column:
        return F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).bitwiseXOR(F.coalesce(F.col(h), F.lit(0)))

    starts = totals.join(of_heads, "conv_id", "left").select(
        "conv_id", "part", carried("ta", "ha").alias("ca"), carried("tb", "hb").alias("cb")
    )
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    later = own.select("*", F.bit_xor("xa").over(here).alias("sa"), F.bit_xor("xb").over(here).alias("sb")).join(
        starts, ["conv_id", "part"]
    ).select("conv_id", "depth", "words", "xa", "xb", F.col("sa").bitwiseXOR(F.col("ca")).alias("a"), F.col("sb").bitwiseXOR(F.col("cb")).alias("b"))
    paths = first.unionByName(later).select(
        "conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("xa")).alias("pa"), F.col("b").bitwiseXOR(F.col("xb")).alias("pb"), "words"
    )
    ends = convs.select("conv_id", F.lit(ROOT[0]).cast("bigint").alias("ta"), F.lit(ROOT[1]).cast("bigint").alias("tb")).unionByName(
        totals.drop("part")
    ).unionByName(of_heads.toDF("conv_id", "ta", "tb"))
    return paths, ends.groupBy("conv_id").agg(F.bit_xor("ta").alias("a"), F.bit_xor("tb").alias("b"))


def hashed_lists(ends: DataFrame) -> DataFrame:
    """(a, b, digest): SHA-256 of the comma-joined conv_ids of each key, in numerical order.

    Ids are range-sorted and joined to pieces of ``PIECE`` where they stand.
    The pieces of a key then run through one hash, one after the other: the
    digest is sequential by definition, but no list is ever held whole.
    """
    order = ["a", "b", "conv_id"]
    schema = "a bigint, b bigint, first bigint, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(c).to_numpy() for c in order)
            if not len(a):
                continue
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            begins = np.flatnonzero(new)
            run = np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a))))
            begins = np.flatnonzero(run % PIECE == 0)
            texts = conv.astype(str).tolist()
            pieces = [",".join(texts[x:y]) for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(a)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[begins]), pa.array(b[begins]), pa.array(conv[begins]), pa.array(pieces, pa.string())],
                names=["a", "b", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=["a", "b", "digest"])

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, schema)
    sorted_ = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return sorted_.select("a", "b", "ids").mapInArrow(digest, "a bigint, b bigint, digest string")


def tour(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The Euler tour of a tree ``nodes`` (id, parent, weight; parent null at the root) as a linked list.

    Each node has an arc that enters it (2 * id) and one that leaves it
    (2 * id + 1). Children are visited in the order of a hashed bucket, then of
    their id: siblings are linked within buckets of about ``bucket`` rows, and
    the buckets of a parent with each other, so no list of all children is
    sorted in one place.
    Returns (arc, next, steps, leaves, weight): next is null at the end; steps is
    one for each arc, leaves and weight stand at the entering arcs.
    """
    buckets = max(1, nodes.count() // bucket)
    kids = nodes.where("parent is not null").select("id", "parent", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    row = Window.partitionBy("parent", "bucket").orderBy("id")
    linked = kids.select("id", F.lead("id").over(row).alias("sibling")).where("sibling is not null")
    ends = kids.groupBy("parent", "bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    ends = cut_lineage(ends.withColumn("sibling", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket"))))
    first = ends.groupBy("parent").agg(F.min_by("first", "bucket").alias("child"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    entering = nodes.select("id", "weight").join(first.withColumnRenamed("parent", "id"), "id", "left").select(
        enter("id").alias("arc"), F.coalesce(enter("child"), leave("id")).alias("next"),
        F.isnull("child").cast("bigint").alias("leaves"), F.col("weight").cast("bigint").alias("weight"),
    )
    leaving = linked.select(leave("id").alias("arc"), enter("sibling").alias("next")).unionByName(
        ends.select(leave("last").alias("arc"), F.coalesce(enter("sibling"), leave("parent")).alias("next"))
    ).unionByName(nodes.where("parent is null").select(leave("id").alias("arc"), F.lit(None).cast("bigint").alias("next")))
    none = F.lit(0).cast("bigint")
    arcs = entering.unionByName(leaving.select("arc", "next", none.alias("leaves"), none.alias("weight")))
    return arcs.select("arc", "next", F.lit(1).cast("bigint").alias("steps"), "leaves", "weight")


SUMS = ("steps", "leaves", "weight")


def _walked(arcs: DataFrame) -> DataFrame:
    """Sums before each arc of a list of bounded size, followed in one task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        arc, values = held.column("arc").to_numpy(), [held.column(c).to_numpy() for c in SUMS]
        place = {a: i for i, a in enumerate(arc.tolist())}
        after = [place.get(n, -1) for n in held.column("next").to_pylist()]
        head = set(range(len(arc))) - set(after)
        order, at = [], head.pop()
        while at >= 0:
            order.append(at)
            at = after[at]
        sums = [np.cumsum(v[order]) - v[order] for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(arc[order]), *map(pa.array, sums)], names=["arc", *SUMS])

    return arcs.coalesce(1).mapInArrow(walk, "arc bigint, " + ", ".join(f"{c} bigint" for c in SUMS))


def list_ranked(arcs: DataFrame, last_arcs: int = LAST_ARCS) -> DataFrame:
    """(arc, steps, leaves, weight): what stands before each arc of a linked list (arc, next, steps, leaves, weight).

    In each round every arc draws heads or tails. An arc of tails that follows
    one of heads is taken out: its predecessor takes its next and its sums, and
    remembers how far it stood behind. About a quarter goes each round, so all
    rounds together move a few times the list. What is left below ``last_arcs``
    is followed in one task, then the arcs taken out get their places from
    their predecessors, last round first. Arcs and nexts are unique, so no join
    has a hot key.
    """
    left, out, turn = cut_lineage(arcs), [], 0
    while left.count() > last_arcs:
        heads = lambda c, t=turn: F.xxhash64(F.lit(t), c).bitwiseAND(F.lit(1)) == 1
        before = left.where(heads("arc") & ~heads("next")).select(
            F.col("next").alias("arc"), F.col("arc").alias("p"), *[F.col(c).alias(f"p_{c}") for c in SUMS]
        )
        met = cut_lineage(left.where(~heads("arc")).join(before, "arc", "left"))
        out.append(met.where("p is not null").select("arc", "p", *[f"p_{c}" for c in SUMS]))
        left = cut_lineage(
            left.where(heads("arc") & (F.isnull("next") | heads("next")))
            .unionByName(met.where("p is null").select(*left.columns))
            .unionByName(met.where("p is not null").select(
                F.col("p").alias("arc"), "next", *[(F.col(f"p_{c}") + F.col(c)).alias(c) for c in SUMS]
            ))
        )
        turn += 1
    ranked = cut_lineage(_walked(left))
    for removed in reversed(out):
        behind = removed.join(ranked.withColumnRenamed("arc", "p"), "p").select(
            "arc", *[(F.col(c) + F.col(f"p_{c}")).alias(c) for c in SUMS]
        )
        ranked = cut_lineage(ranked.unionByName(behind))
    return ranked


def prefix_trie(turns: DataFrame, head: Column | None = None, base: Column | None = None, last_arcs: int = LAST_ARCS,
                bucket: int = BUCKET) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, turn, role, text), with sums over their subtrees.

    Conversations are rebuilt first (see ``members``): ``head`` and ``base`` look
    at conv_id; left out, conversations are taken as they are. A node is a
    distinct sequence of turns (role, text) that rebuilt conversations start
    with; the root is the empty one. Subtree sums are differences of prefix
    sums at a node's two arcs in the Euler tour, which is ranked as a
    distributed linked list, whatever the trie's depth or fan.

    Defined results: turns are ordered by turn, null first, equal ones by hash; a
    null role or text is empty; rows without a conv_id belong to no
    conversation; repeated rows are turns of their own; an empty table gives no
    nodes; other columns are not looked at. Sequences are told apart by 128 bits.
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and enter and leave, the places of the node's
    arcs in the tour.
    """
    paths, ends = members(turns, F.lit(0) if head is None else head, F.col("conv_id") if base is None else base)
    ends = cut_lineage(ends)
    inner = paths.groupBy("a", "b").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"),
    )
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[F.lit(k).cast("bigint").alias(c) for k, c in zip(ROOT, "ab")], F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs",
        *[F.lit(None).cast("bigint").alias(c) for c in ("pa", "pb")], F.lit(0).alias("words"),
    )
    nodes = cut_lineage(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = cut_lineage(
        nodes.join(above, ["pa", "pb"], "left")
        .select("id", "parent", "parent_conv_id", "a", "b", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("weight"))
    )
    places = list_ranked(tour(tree.select("id", "parent", "weight"), bucket), last_arcs)
    ends_of = lambda odd, to: places.where(F.col("arc") % 2 == odd).select(
        F.shiftright("arc", 1).alias("id"), *[F.col(c).alias(f"{to}_{c}") for c in SUMS]
    )
    fan = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    spans = ends_of(0, "in").join(ends_of(1, "out"), "id").join(fan, "id", "left")
    return tree.join(spans, "id").join(hashed_lists(ends), ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        (F.col("out_leaves") - F.col("in_leaves")).alias("n_leaves"), (F.col("out_weight") - F.col("in_weight")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("in_steps").alias("enter"), F.col("out_steps").alias("leave"),
    )
