"""The prefix trie against dictionaries of sequences."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, a string, part string"


def rule():
    return F.crc32(F.col("conv_id").cast("string")) % 4, F.col("conv_id") - F.col("conv_id") % 20


def brute(rows, rebuilt=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        paths[c] = [*turns.get(c - c % 20, [])[:h], *mine[h:]]
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = {}
    for node, held in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = {x[:len(x) - 1] for x in members if x}
        out[held[0], len(node)] = (
            members[node[:-1]][0] if node else None, len(held), sum(len(x) == len(node) + 1 for x in below),
            sum(x not in kids for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x),
            hashlib.sha256(",".join(str(c) for c in held if len(paths[c]) == len(node)).encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    # The tour visits every arc once, and a node's subtree lies between its arcs.
    assert sorted(x for r in rows for x in (r.enter, r.leave)) == list(range(2 * len(rows)))
    return got


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    out = [(c, t, ("user", "assistant", None)[t % 3], f"say {x} again") for c in range(70) for t, x in enumerate(draw.integers(0, 2, c % 7))]
    out += [(c, 0, "system", "one hot turn that all of these share") for c in range(100, 160)]
    out += [(200, t, "user", "on  and\ton") for t in range(300)]
    out += [(300, None, "user", "first"), (300, 5, None, None), (300, 5, "x", ""), (301, 0, "user", "first"), (301, 0, "user", "first")]
    out += [(None, 0, "user", "nobody's"), (None, None, None, None), (400, 0, "a", "bc"), (401, 0, "ab", "c"), (1 << 40, 3, "user", "x " * 5000)]
    return out


@pytest.fixture(scope="module")
def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


# Equal turns of one conversation stand in the order of their hashes; such pairs differ in place only.
def test_rebuilt(turns, rows):
    got, want = found(trie.prefix_trie(turns.where("conv_id is null or conv_id != 300"), *rule(), last_arcs=50, bucket=7)), brute(
        [r for r in rows if r[0] != 300]
    )
    assert got == want


def test_as_they_are_and_in_one_task(turns, rows):
    some = [r for r in rows if r[0] is not None and (r[0] < 30 or r[0] > 399)]
    assert found(trie.prefix_trie(turns.where("conv_id < 30 or conv_id > 399"))) == brute(some, rebuilt=False)


def test_ties_are_defined(spark, turns):
    at = trie.prefix_trie(turns.where("conv_id = 300"))
    again = trie.prefix_trie(turns.where("conv_id = 300").repartition(3))
    assert found(at) == found(again) and len(found(at)) == 4


def test_nothing(turns):
    assert trie.prefix_trie(turns.where("false"), *rule()).count() == 0
    assert trie.prefix_trie(turns.where("conv_id is null"), *rule()).count() == 0


def test_long_lists_of_ids_are_hashed_piecewise(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    ids = [(7, -1, c) for c in range(-20, 100)] + [(7, 0, 5), (-7, 9, 12)]
    got = trie.hashed_lists(spark.createDataFrame(ids, "a bigint, b bigint, conv_id bigint").repartition(4)).collect()
    want = {(7, -1): range(-20, 100), (7, 0): [5], (-7, 9): [12]}
    assert {(r.a, r.b): r.digest for r in got} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


def test_plan_moves_no_text(turns, plan):
    assert "Cartesian" not in plan(trie.prefix_trie(turns.where("conv_id < 9"), *rule()))
