"""Coded lists against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import blocks
from fathomline.operators.codes import CodeRanker, code_build, coded_topk
from fathomline.operators.ivf import ivf_build, ivf_topk, recall_at_k
from fathomline.operators.nearest import vector_topk

DIMS, K = 16, 5


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((12, DIMS))
    near = lambda i: (groups[i % 12] + 0.4 * rng.standard_normal(DIMS)).astype("float32").tolist()
    items = [(i, near(i), i % 40) for i in range(900)] + [(900, None, 1), (901, [0.0] * DIMS, 1), (902, near(1), None)]
    # Every fourth query leaves 22 items, spread over the groups.
    queries = [(q, near(q), 7 if q % 4 == 0 else None) for q in range(40)] + [(40, None, None), (41, [0.0] * DIMS, None)]
    idf = spark.createDataFrame(items, "item_id bigint, embedding array<float>, level int")
    qdf = spark.createDataFrame(queries, "query_id bigint, query_vec array<float>, level bigint")
    root = tmp_path_factory.mktemp("lists")
    index = ivf_build(idf, 12, str(root / "lists"))
    return idf, qdf, code_build(index, str(root / "codes"), parts=8)


def rows(df):
    return sorted((r.query_id, r.vec_rank, r.item_id, r.distance) for r in df.collect())


def test_recall_and_steps(world):
    idf, qdf, coded = world
    found, read = coded_topk(qdf, coded, K, nprobe=2, checked=4)
    truth = vector_topk(qdf, idf, K)
    hits = recall_at_k(found, truth).collect()
    assert len(hits) == 40 and 0.9 <= sum(h.hits for h in hits) / sum(h.expected for h in hits) <= 1
    looked = {r.query_id: r.lists_read for r in read.collect()}
    plain = [n for q, n in looked.items() if q % 4]
    assert set(looked) == set(range(40)) and max(plain) < 12 and np.mean(plain) < 4
    # A filter that few items pass opens more lists, and still fills the list.
    assert max(n for q, n in looked.items() if q % 4 == 0) > 2
    assert all(h.expected == K for h in hits) and len(rows(found)) == 40 * K


def test_all_lists_and_a_wide_check_are_exact(world):
    idf, qdf, coded = world
    found, read = coded_topk(qdf, coded, K, nprobe=12, checked=200)
    assert rows(found) == rows(vector_topk(qdf, idf, K))
    assert {r.lists_read for r in read.collect()} == {12}


def test_every_item_is_coded(world):
    _, _, coded = world
    assert coded.codes.count() == 901 and {len(r.code) for r in coded.codes.select("code").collect()} == {8}
    with pytest.raises(ValueError, match="parts"):
        code_build(coded.index, "unused", parts=5)


def test_lists_are_read_in_place_and_a_query_hands_on_its_best_once(world, monkeypatch, plan):
    idf, qdf, coded = world
    monkeypatch.setattr(blocks, "QUERIES_PER_CELL", 1)
    monkeypatch.setattr(blocks, "ITEMS_PER_CELL", 37)
    held = qdf.where("query_id < 40").select("query_id", F.lit(K).alias("k"), "query_vec", "level", F.expr("sequence(0L, 11L)").alias("lists"))
    fields = {"item_id": "item_id", "code": "code", "level": "level"}
    found = blocks.listed_topk(held, coded.codes, fields, [CodeRanker(coded.books, coded.index.centers)], 40)
    # Blocks of one query leave one task to each: k rows, not k rows of each of the twelve lists.
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {K}
    text = plan(ivf_topk(qdf, coded.index, K, nprobe=2, exact=False))
    assert "MapInArrow" in text and "CoGroups" not in text


def test_estimates_are_distances_to_the_coded_items(world):
    _, qdf, coded = world
    query = np.array(qdf.where("query_id = 1").first().query_vec, dtype=float)
    query /= np.linalg.norm(query)
    want = []
    for r in coded.codes.collect():
        words = np.concatenate([book[c] for book, c in zip(coded.books, r.code)])
        off = query - coded.index.centers[r.list_id] - words
        want.append((round(float(off @ off) / 2, 6), r.item_id))
    one = qdf.where("query_id = 1").select("query_id", F.lit(30).alias("k"), "query_vec", F.expr("sequence(0L, 11L)").alias("lists"))
    fields = {"item_id": "item_id", "code": "code"}
    found = blocks.listed_topk(one, coded.codes, fields, [CodeRanker(coded.books, coded.index.centers)], 1).collect()
    got = sorted((r.distance, r.item_id) for r in found)[:30]
    assert [i for _, i in got] == [i for _, i in sorted(want)[:30]]
    assert np.allclose([d for d, _ in got], [d for d, _ in sorted(want)[:30]], atol=2e-6)
