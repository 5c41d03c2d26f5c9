"""Counts of items inside filter sets against a loop over all pairs."""

import random

import numpy as np
import pytest

from fathomline.operators.counting import _in_block, dominated, filter_counts, running_total

ITEMS = "item_id bigint, atk int, def_ int, level int, attribute string, properties array<string>"
QUERIES = "query_id bigint, eff_min bigint, eff_max bigint, min_def bigint, max_def bigint, level bigint, attribute string, card_type string"


def test_places_before():
    draw = np.random.default_rng(3)
    for size in (0, 1, 2, 3, 7, 64, 65, 300):
        kind, b, n = np.sort(draw.integers(0, 3, size)), draw.integers(0, 20, size), draw.integers(0, 4, size)
        want = [sum(n[j] for j in range(i) if kind[j] == kind[i] and b[j] <= b[i]) for i in range(size)]
        assert _in_block(kind, b, n).tolist() == want


def test_running_total(spark):
    rows = [("hot" if i % 3 else "x", i, i % 7) for i in range(500)]
    got = running_total(spark.createDataFrame(rows, "g string, o int, v int").repartition(4), ["g"], ["o"], "v", "t").collect()
    assert all(r.t == sum(v for g, o, v in rows if g == r.g and o <= r.o) for r in got) and len(got) == 500


@pytest.mark.parametrize("block_rows", (5, 100_000))
def test_counts(spark, block_rows):
    r = random.Random(block_rows)
    maybe = lambda value, share=0.3: None if r.random() < share else value
    # A third of the items share their point, their attribute and their property.
    items = [(i, 7, 7, 1, "dark", ["hot", None, "hot"]) for i in range(60)] + [
        (i, maybe(r.randint(0, 20)), maybe(r.randint(0, 20)), maybe(r.randint(1, 3)), maybe(r.choice(["dark", "fire"])),
         maybe(r.sample(["hot", "p", "q", None], 2))) for i in range(60, 180)
    ]
    queries = [
        (i, maybe(r.randint(-2, 22), 0.5), maybe(r.randint(-2, 22), 0.5), maybe(r.randint(-2, 22), 0.5), maybe(r.randint(-2, 22), 0.5),
         maybe(r.randint(1, 4), 0.6), maybe(r.choice(["dark", "fire", "none"]), 0.6), maybe(r.choice(["hot", "p", "z"]), 0.6))
        for i in range(120)
    ] + [(900, *[None] * 7), (901, None, 1 << 62, -(1 << 62), None, None, None, None), (902, 9, 3, None, None, None, None, None)]

    def inside(q, i):
        _, lo, hi, dlo, dhi, level, attribute, card = q
        _, atk, def_, at, of, held = i
        return ((lo is None or (atk is not None and atk >= lo)) and (hi is None or (atk is not None and atk <= hi))
                and (dlo is None or (def_ is not None and def_ >= dlo)) and (dhi is None or (def_ is not None and def_ <= dhi))
                and (level is None or at == level) and (attribute is None or of == attribute) and (card is None or card in (held or [])))

    got = filter_counts(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(items, ITEMS), block_rows).collect()
    assert {r.query_id: r.n_items for r in got} == {q[0]: sum(inside(q, i) for i in items) for q in queries} and len(got) == len(queries)


def test_nothing(spark):
    items, queries = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, *[None] * 7), (2, 1, *[None] * 6)], QUERIES)
    assert {tuple(r) for r in filter_counts(queries, items).collect()} == {(1, 0), (2, 0)}
    assert filter_counts(queries.where("false"), items).count() == 0


def test_no_row_per_pair(spark, plan):
    points = spark.range(50).selectExpr("'k' as kind", "id as a", "id as b", "1L as n")
    text = plan(dominated(points, points.select("kind", "a", "b"), 10))
    assert "Cartesian" not in text and "NestedLoop" not in text
