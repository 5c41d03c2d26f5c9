"""A pair scorer: its features by hand, and held-out pairs."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from fathomline.operators.learned import FEATURES, PAIR_PARTS, PairModel, fit_pair_model, pair_features
from fathomline.operators.rerank import rerank, with_asked, with_held

PAIRS = "search_text string, content string, label int"


def test_features(spark):
    rows = [("Blue cat", "the blue dog"), ("", ""), (None, "x"), ("a b c", None), ("same old", "same old")]
    got = spark.createDataFrame(rows, "q string, c string").select("q", "c", pair_features(F.col("q"), F.col("c")).alias("f")).collect()
    for r in got:
        assert len(r.f) == len(FEATURES) and all(0 <= x <= 1 for x in r.f)
    q, c = set(brute.grams("Blue cat")), set(brute.grams("the blue dog"))
    assert got[0].f[:5] == pytest.approx([len(q & c) / len(q), len(q & c) / len(c), 0.5, 0.5, 0])
    assert got[4].f[:5] == [1.0] * 5 and got[1].f[:5] == [0.0] * 5


def test_held_out_pairs(spark):
    r = random.Random(2)
    names = [f"{a} {b}" for a in ("red", "blue", "small", "old") for b in ("ring", "gear", "bolt", "cat")]
    pairs = [(f"{q} wanted", f"Name: {c}", int(q == c)) for q in names for c in names for _ in range(2)]
    r.shuffle(pairs)
    # A third of the pairs are the same one, some are not judged.
    pairs += [("red ring wanted", "Name: red ring", 1)] * 300 + [("x", "y", None)] * 5
    model = fit_pair_model(spark.createDataFrame(pairs[::2], PAIRS))
    scored = spark.createDataFrame(pairs[1::2], PAIRS).withColumn("p", model(F.col("search_text"), F.col("content"))).where("label is not null").collect()
    assert min(x.p for x in scored if x.label) > max(x.p for x in scored if not x.label)
    again = fit_pair_model(spark.createDataFrame(pairs[::2], PAIRS).repartition(7), max_pairs=200)
    assert len(again.weights) == len(FEATURES)
    candidates = spark.createDataFrame([(1, i, i, "old cat wanted", f"Name: {n}") for i, n in enumerate(names)], "query_id int, item_id int, rrf_rank int, search_text string, content string")
    assert rerank(candidates, 1, model).first().content == "Name: old cat"


def test_one_kind_of_label(spark):
    for rows, low, high in (([], 0.4, 0.6), ([("a", "b", 1)], 0.9, 1.0), ([("a", "b", 0)], 0.0, 0.1), ([("a", "b", None)], 0.4, 0.6)):
        model = fit_pair_model(spark.createDataFrame(rows, PAIRS))
        assert isinstance(model, PairModel)
        assert low <= spark.range(1).select(model(F.lit("a"), F.lit("b"))).first()[0] <= high


def test_learns_from_every_pair(spark, monkeypatch):
    """The fit sees each judged pair, and the parts that were made beforehand give the same model."""
    from pyspark.ml.classification import LogisticRegression

    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    asked = F.when(F.col("id") % 3 == 0, F.lit("red ring wanted")).otherwise(F.concat(F.lit("blue cat "), F.col("id").cast("string")))
    label = F.when(F.col("id") < 60_000, (F.col("id") % 3 == 0).cast("int"))
    pairs = spark.range(60_010).select(asked.alias("search_text"), F.lit("Name: red ring").alias("content"), label.alias("label"))
    model = fit_pair_model(pairs)
    parts = fit_pair_model(with_held(with_asked(pairs, PAIR_PARTS), PAIR_PARTS))
    assert seen == [60_000, 60_000]
    assert (*parts.weights, parts.intercept) == pytest.approx((*model.weights, model.intercept), rel=1e-4, abs=1e-6)
