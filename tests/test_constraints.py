"""Bounds in queries that are made up of a frame, a phrase and a number."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import constraints as c

FRAMES = ("{}", "knights {}", "give me a wizard {} please")
DRAW = random.Random(17)
BIG = 2**63 - 1


def number():
    return DRAW.choice((0, 7, 1234, DRAW.randint(1, 10**7)))


def made(phrases, behind):
    """(text, number) of each phrase with a number before or after it, in each frame."""
    for phrase, frame in itertools.product(phrases, FRAMES):
        n = number()
        yield frame.format(f"{n} {phrase}" if behind else f"{phrase} {n}"), n


LOWER = [*made(c.MIN_PHRASES, False), *made(c.MIN_SIGNS, False), *made(c.MIN_SUFFIXES, True)]
UPPER = [*made(c.MAX_PHRASES + c.MAX_PHRASES_NOT_NEGATED, False), *made(c.MAX_SIGNS, False), *made(c.MAX_SUFFIXES, True)]
EQUAL = [*made(("exactly",), False), *made(c.KEYWORDS, True), *made(("ataque igual a", "atk equals"), False)]
RANGES = [
    (frame.format(f"{opener} {a} {joint} {b}"), min(a, b), max(a, b))
    for opener, joint in (("between", "and"), ("entre", "e"), ("between", "to"), ("entre", "até"))
    for frame in FRAMES for a, b in [(number(), number())]
]
VAGUE = [(f"{word} {number()} atk", None) for word in c.VAGUE_WORDS]
FREE = [(text, None) for text in ("", "an old tower", f"tower {number()}", "tower 3.5 atk", "rank 4-6 towers", "atk none")]
LONG = "9" * 20


@pytest.fixture(scope="module")
def bounds(spark):
    texts = {row[0] for row in LOWER + UPPER + EQUAL + RANGES + VAGUE + FREE}
    texts |= {f"over {LONG}", f"between 5 and {LONG}", f"under {LONG} atk", f"{LONG} or more"}
    table = spark.createDataFrame([(t,) for t in sorted(texts)], "query string")
    return {r.query: (r.ext_min, r.ext_max, r.ext_text) for r in c.extract_constraints(table).collect()}


def test_lower_bounds(bounds):
    assert {t: bounds[t][:2] for t, _ in LOWER} == {t: (n, None) for t, n in LOWER}


def test_upper_bounds(bounds):
    assert {t: bounds[t][:2] for t, _ in UPPER} == {t: (None, n) for t, n in UPPER}


def test_equality(bounds):
    assert {t: bounds[t][:2] for t, _ in EQUAL} == {t: (n, n) for t, n in EQUAL}


def test_ranges_in_either_order(bounds):
    assert {t: bounds[t][:2] for t, _, _ in RANGES} == {t: (a, b) for t, a, b in RANGES}


def test_text_without_a_bound_stays(bounds):
    assert {t: bounds[t] for t, _ in VAGUE + FREE} == {t: (None, None, t) for t, _ in VAGUE + FREE}


def test_long_numbers_keep_their_bound(bounds):
    assert bounds[f"over {LONG}"][:2] == (BIG, None) and bounds[f"between 5 and {LONG}"][:2] == (5, BIG)
    assert bounds[f"under {LONG} atk"][:2] == (None, BIG) and bounds[f"{LONG} or more"][:2] == (BIG, None)


def test_the_phrase_is_cut_out(spark):
    cases = {"tall   towers over 12 atk": "tall towers", "over 12 atk": "over 12 atk", "TORRES ACIMA DE 12": "TORRES",
             "🗼 under 9\tatk 🗼": "🗼 🗼", "p 3+ q 4+": "p q 4+"}
    table = spark.createDataFrame([(t,) for t in cases] + [(None,)], "query string")
    assert {r.query: r.ext_text for r in c.extract_constraints(table).collect()} == cases | {None: None}


def test_merged_bounds_are_the_tighter_ones(spark):
    values = (None, 3, 8, 8, 20)
    rows = list(itertools.product(values, values))
    got = spark.createDataFrame(rows, "a int, b int").select(
        "a", "b", c.merge_lower(F.col("a"), F.col("b")).alias("low"), c.merge_upper(F.col("a"), F.col("b")).alias("high")).collect()
    for r in got:
        given = [v for v in (r.a, r.b) if v is not None]
        assert (r.low, r.high) == (max(given, default=None), min(given, default=None))


def test_prepared_queries(spark):
    rows = [(1, "towers over 70 atk", None), (2, "towers over 70 atk", 95), (3, "towers under 20 atk", 33)]
    got = {r.query_id: r for r in c.prepare_queries(spark.createDataFrame(rows, "query_id bigint, query string, min_atk bigint")).collect()}
    assert {i: (r.eff_min, r.eff_max, r.contradictory) for i, r in got.items()} == {
        1: (70, None, False), 2: (95, None, False), 3: (33, 20, True)}


def test_other_field(spark):
    spec = c.ConstraintSpec(keywords=("wings", "span"), equality_keywords=("wings", "span"))
    row = c.extract_constraints(spark.createDataFrame([("bat 41 wings",)], "query string"), spec=spec).first()
    assert (row.ext_min, row.ext_max, row.ext_text) == (41, 41, "bat")


def test_filter_on_result_keeps_the_expression_small(spark, plan):
    prepared = c.prepare_queries(spark.range(3).selectExpr("id AS query_id", "concat('over ', id) AS query"))
    filtered = prepared.where("eff_min > 1 AND search_text IS NOT NULL")
    assert filtered.count() == 1
    assert plan(filtered).count("exactly") < 60


def test_the_stronger_kind_decides_then_the_first_place(spark):
    cases = {
        "atk 9 towers > 4": ("op_min", 4, None), "under 8 towers over 6": ("comp_min", 6, None),
        "over 6 towers between 2 and 4": ("range", 2, 4), "< 3 over 2": ("op_max", None, 3),
        "8 atk exactly 5": ("eq", 8, 8), "no over 6": (None, None, None), "no less than 6": ("comp_min", 6, None),
        "not less than 6 atk": ("comp_min", 6, None), "no more than 6": ("comp_max", None, 6),
        "those that attack 2 times": (None, None, None), "2 attack": ("eq", 2, 2), "-6 atk": (None, None, None),
        "over 6.": (None, None, None), "6 or more atk": ("comp_min", 6, None), "6-9 attacks": ("range", 6, 9),
        "6 attacks": (None, None, None),
    }
    table = spark.createDataFrame([(t,) for t in cases], "query string")
    assert {r.query: (r.ext_tier, r.ext_min, r.ext_max) for r in c.extract_constraints(table).collect()} == cases
