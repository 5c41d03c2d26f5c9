import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from fathomline.operators.encode import HashedTrigramEncoder, embed, embed_many, hashed_counts
from fathomline.operators.rerank import model_scorer, rerank


def fragile():
    class Fragile:
        """Fails on whole batches and on one text."""

        def prepare(self, text):
            return text

        def load(self):
            def encode(texts):
                if len(texts) > 1 or texts[0] == "bad":
                    raise RuntimeError("no " + texts[0])
                return [[float(len(texts[0])), 1.0]]

            return encode

    return Fragile()


def test_hashed_encoder(spark):
    df = spark.createDataFrame([("Blue cat",), ("blue CAT!",), ("",), (None,), ("ação",)], "t string")
    got = {r.t: r.embedding for r in embed(df, "t", HashedTrigramEncoder(16)).collect()}
    assert got[None] is None and got[""] == [0.0] * 16
    assert got["Blue cat"] == got["blue CAT!"]
    assert np.linalg.norm(got["ação"]) == pytest.approx(1, abs=1e-6)
    counts = np.zeros(16)
    for g in brute.grams("ação"):
        counts[(ord(g[0]) * 961 + ord(g[1]) * 31 + ord(g[2])) % 16] += 1
    assert got["ação"] == pytest.approx(list(counts / np.linalg.norm(counts)), abs=1e-6)


def test_row_by_row_after_a_failed_batch(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("ccc",), (None,)], "t string").coalesce(1)
    got = {r.t: (r.embedding, r.problem) for r in embed(df, "t", fragile(), error_col="problem").collect()}
    assert got["a"] == ([1.0, 1.0], None) and got["ccc"] == ([3.0, 1.0], None) and got[None] == (None, None)
    assert got["bad"] == (None, "RuntimeError: no bad")
    with pytest.raises(Exception, match="no a"):
        embed(df, "t", fragile(), on_error="fail").collect()


def test_two_vectors(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    row = embed_many(df, "t", {"embedding": None, "embedding_local": HashedTrigramEncoder(8)}).first()
    assert row.embedding is None and len(row.embedding_local) == 8


CANDIDATES = "query_id int, item_id int, rrf_rank int, search_text string, content string"


def test_rerank(spark):
    df = spark.createDataFrame(
        [(1, 10, 1, "blue cat", None), (1, 11, 2, "blue cat", "a dog"), (1, 12, 3, "blue cat", "the BLUE cat"),
         (1, 13, 4, "blue cat", "cat blue"), (2, 10, 1, "dog", "cat")], CANDIDATES,
    )
    got = [(r.query_id, r["rank"], r.item_id, r.rerank_score) for r in rerank(df, 3).orderBy("query_id", "rank").collect()]
    # Equal scores stay in their fused order.
    assert got == [(1, 1, 12, 1.0), (1, 2, 13, 1.0), (1, 3, 10, 0.0), (2, 1, 10, 0.0)]


def test_rerank_with_a_model(spark):
    def load():
        return lambda pairs: [float(len(q) - len(c)) for q, c in pairs]

    df = spark.createDataFrame([(1, 1, 1, "abc", "ab"), (1, 2, 2, "abc", None), (1, 3, 3, "abc", "")], CANDIDATES)
    got = [(r.item_id, r.rerank_score) for r in rerank(df, F.lit(2), model_scorer(load)).orderBy("rank").collect()]
    assert got == [(2, 3.0), (3, 3.0)]


def test_many_texts_are_counted_together():
    texts = [" ", "", "  a ", "  ab ", "  b a ", "  x" * 70_000, "  ab ", "é", "  a " * 40_000]
    together = HashedTrigramEncoder(16).load()(texts)
    assert len(together) == len(texts)
    for text, row in zip(texts, together):
        assert (row == hashed_counts([text], 16)[0]).all()
    assert (together[3] == together[6]).all() and not together[0].any() and not together[1].any()
