import hashlib

import pytest
from pyspark.sql import functions as F

from fathomline.functions.scoring import clamp_limit, lexical_coverage, pool_size, rrf_score
from fathomline.functions.text import build_content, clean_int, collapse_spaces, content_hash, render_list
from fathomline.functions.trigram import trgm_distance, trgm_similarity, trigrams
from fathomline.functions.vectors import check_dims, cosine_distance, l2_normalize


def value(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text,expected",
    [("2200", 2200), (" 2200 ", 2200), ("-5", -5), ("+5", 5), ("1_000", 1000), ("12.7", None), ("abc", None),
     ("", None), (None, None), ("1__0", None), ("99999999999", None), ("0", 0)],
)
def test_clean_int(spark, text, expected):
    assert value(spark, "t string", (text,), clean_int(F.col("t"))) == expected


@pytest.mark.parametrize(
    "items", [["Dragon", "Effect"], [], ["it's"], ['say "it\'s"'], ['"'], ["a\\b", "x\ny"], ["ção", None]]
)
def test_render_list_is_python_repr(spark, items):
    assert value(spark, "l array<string>", (items,), render_list(F.col("l"))) == repr(items)


def test_render_null_list(spark):
    assert value(spark, "l array<string>", (None,), render_list(F.col("l"))) is None


SCHEMA = "name string, attribute string, level int, atk int, def_ int, properties array<string>, effect string"


@pytest.mark.parametrize(
    "row,expected",
    [
        (("A", "fire", 4, 0, 10, ["Dragon", "Effect"], "Burn."),
         "Name: A | Attribute: fire | Level: 4 | ATK: 0 | DEF: 10 | PROPERTIES: ['Dragon', 'Effect'] | Description: Burn."),
        ((None, "", None, None, None, None, ""), "Name: None"),
        (("B", None, None, None, None, [], None), "Name: B | PROPERTIES: []"),
    ],
)
def test_build_content(spark, row, expected):
    assert value(spark, SCHEMA, row, build_content(*[F.col(c) for c in SCHEMA.replace(",", "").split()[::2]])) == expected


def test_hash(spark):
    assert value(spark, "t string", ("ação",), content_hash(F.col("t"))) == hashlib.sha256("ação".encode()).hexdigest()


def test_collapse(spark):
    assert value(spark, "t string", (" a \t\n b c\x1cd ",), collapse_spaces(F.col("t"))) == "a b c d"


def test_trigrams_follow_the_public_definition(spark):
    found = value(spark, "t string", ("Cat, c-3",), trigrams(F.col("t")))
    assert sorted(found) == sorted(["  c", " ca", "cat", "at ", " c ", "  3", " 3 "])
    assert value(spark, "a string, b string", ("word", "two words"), F.round(trgm_similarity(F.col("a"), F.col("b")), 6)) == 0.363636
    assert value(spark, "a string, b string", ("", "..."), trgm_distance(F.col("a"), F.col("b"))) == 1.0
    assert value(spark, "a string, b string", ("", None), trgm_similarity(F.col("a"), F.col("b"))) is None


def test_cosine(spark):
    schema = "a array<float>, b array<float>"
    both = cosine_distance(F.col("a"), F.col("b"))
    assert value(spark, schema, ([1.0, 0.0], [0.0, 2.0]), both) == pytest.approx(1.0)
    assert value(spark, schema, ([1.0, 1.0], [2.0, 2.0]), both) == pytest.approx(0.0)
    assert value(spark, schema, ([0.0, 0.0], [2.0, 2.0]), both) is None
    assert value(spark, schema, (None, [2.0, 2.0]), both) is None


def test_normalize_and_dims(spark):
    assert value(spark, "a array<float>", ([3.0, 4.0],), l2_normalize(F.col("a"))) == pytest.approx([0.6, 0.8])
    assert value(spark, "a array<float>", ([0.0, 0.0],), l2_normalize(F.col("a"))) == [0.0, 0.0]
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "a array<float>")
    assert check_dims(df, "a", 2).count() == 1


def test_scores(spark):
    schema = "v int, l int"
    assert value(spark, schema, (1, None), rrf_score(F.col("v"), F.col("l"))) == 1 / 61 + 1 / 1000060
    for given, top, pool in ((None, 30, 60), (0, 1, 40), (50, 50, 100), (99, 50, 100), (20, 20, 40)):
        clamped = clamp_limit(F.col("v"))
        assert value(spark, schema, (given, None), clamped) == top
        assert value(spark, schema, (given, None), pool_size(clamped)) == pool
    assert value(spark, "q string, c string", ("cat", None), lexical_coverage(F.col("q"), F.col("c"))) == 0.0
    assert value(spark, "q string, c string", ("cat", "a Cat!"), lexical_coverage(F.col("q"), F.col("c"))) == 1.0
