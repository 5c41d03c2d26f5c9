"""The fitted encoder against a dense decomposition of the same matrix."""

import numpy as np
import pytest

from fathomline.operators import fitted
from fathomline.operators.encode import embed
from fathomline.operators.fitted import FittedEncoder, fit_encoder, trigram_counts, weighted_rows
from fathomline.session import cut_lineage

FEATURES = 128
WORDS = "red blue green dragon wizard stone golden knight of the sea fire ancient machine spirit".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    return [" ".join(rng.choice(WORDS, 1 + i % 6)) for i in range(300)] + ["", "  ", "red", "red", "Žluťoučký kůň"]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t) for i, t in enumerate([*texts, None])]
    return spark.createDataFrame(rows, "id int, text string").repartition(5)


def dense(texts):
    """The matrix in one piece, from words split in Python."""
    padded = ["  " + "   ".join(t.lower().split()) + " " if t.split() else "" for t in texts]
    counts = [trigram_counts(p, FEATURES) for p in padded]
    held = np.zeros(FEATURES)
    for slots, _ in counts:
        held[slots] += 1
    rarity = np.log((1 + len(texts)) / (1 + held)) + 1
    return rarity, weighted_rows([c[0] for c in counts], [c[1] for c in counts], rarity)


def test_fit_is_the_truncated_decomposition(table, texts):
    rarity, matrix = dense(texts)
    _, strengths, right = np.linalg.svd(matrix, full_matrices=False)
    encoder = fit_encoder(table, "text", 8, features=FEATURES, oversample=40, iterations=6)
    assert np.allclose(encoder.rarity, rarity)
    assert np.allclose(encoder.strengths, strengths[:8], rtol=1e-6)
    assert np.allclose(np.abs((encoder.directions * right[:8].T).sum(axis=0)), 1, atol=1e-5)


def test_vectors_are_projections(spark, table, texts, tmp_path):
    _, matrix = dense(texts)
    encoder = fit_encoder(table, "text", 8, features=FEATURES)
    encoder.save(spark, str(tmp_path / "model"))
    again = FittedEncoder.read(spark, str(tmp_path / "model"))
    assert np.array_equal(again.directions, encoder.directions) and np.array_equal(again.rarity, encoder.rarity)
    got = {r.id: r.embedding for r in embed(table, "text", again).collect()}
    assert got[len(texts)] is None and not any(got[300]) and not any(got[301])
    want = matrix @ encoder.directions
    want = np.divide(want, np.linalg.norm(want, axis=1, keepdims=True), out=np.zeros_like(want), where=matrix.any(axis=1)[:, None])
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-5)


def test_few_and_no_texts(spark):
    one = spark.createDataFrame([("red dragon",), ("red dragon",)], "text string")
    encoder = fit_encoder(one, "text", 4, features=64)
    assert encoder.strengths[0] == pytest.approx(2**0.5) and not encoder.directions[:, 1:].any()
    none = fit_encoder(one.where("false"), "text", 4, features=64)
    assert none.dims == 4 and not none.load()(["  red "]).any()
    with pytest.raises(ValueError, match="dims"):
        fit_encoder(one, "text", 65, features=64)


def test_a_table_of_one_split_is_counted_by_all_cores(spark, table, monkeypatch):
    counted = []
    monkeypatch.setattr(fitted, "cut_lineage", lambda df: counted.append(df.rdd.getNumPartitions()) or cut_lineage(df))
    fit_encoder(table.coalesce(1), "text", 4, features=64)
    assert counted[0] >= spark.sparkContext.defaultParallelism
