"""Pairs inside filters: no join of rows, odd rows, several blocks and chunks."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from fathomline.operators import pairs as found
from fathomline.operators.filters import filter_pairs
from test_topk import ITEMS, QUERIES, make_items, make_queries


def odd(rows, key, seed):
    """Some rows twice, some without an id, one whose id another has."""
    r = random.Random(seed)
    return rows + r.sample(rows, 10) + [row | {key: None} for row in r.sample(rows, 5)] + [rows[0] | {key: rows[1][key]}]


def test_pairs_of_odd_rows_without_a_join(spark, plan):
    items, queries = odd(make_items(200, 5), "item_id", 1), odd(make_queries(60, 6), "query_id", 2)
    queries += [dict.fromkeys(queries[0]) | {"query_id": 1, "eff_max": 300}, dict.fromkeys(queries[0]) | {"query_id": 2, "min_def": 900, "max_def": 100}]
    idf, qdf = spark.createDataFrame(items, ITEMS), spark.createDataFrame(queries, QUERIES)
    pairs = filter_pairs(qdf, idf, buckets=3)
    want = Counter((q["query_id"], i["item_id"]) for q in queries for i in items if brute.in_scope(q, i))
    assert Counter((r.query_id, r.item_id) for r in pairs.collect()) == want
    # Rows of both sides that meet in a join are formed before filters rule most of them out.
    assert "Join" not in plan(pairs)
    assert filter_pairs(qdf, idf.where("false")).count() == filter_pairs(qdf.where("false"), idf).count() == 0
    bare = idf.withColumns({c: F.lit(None).cast(t) for c, t in (("atk", "int"), ("def_", "int"), ("level", "int"), ("attribute", "string"), ("properties", "array<string>"))})
    free = [q for q in queries if all(q.get(c) is None for c in ("eff_min", "eff_max", "min_def", "max_def", "level", "attribute", "card_type"))]
    assert filter_pairs(qdf, bare).count() == len(free) * len(items)


@pytest.mark.parametrize("most", [7, 1000])
def test_chunks_and_lists(tmp_path, monkeypatch, most):
    monkeypatch.setattr(found, "CHUNK_ITEMS", most)
    monkeypatch.setattr(found, "PAIRS_AT_ONCE", most)
    items, queries = make_items(100, 7), make_queries(30, 8)
    kinds = {"item_id": pa.int64(), "level": pa.int32(), "atk": pa.int32(), "def_": pa.int32(), "attribute": pa.string(), "properties": pa.list_(pa.string())}
    for n in range(4):
        pq.write_table(pa.table({c: pa.array([i[c] for i in items[n::4]], t) for c, t in kinds.items()}), tmp_path / f"{n}.parquet")
    asked = {c: pa.int64() for c in ("query_id", "eff_min", "eff_max", "min_def", "max_def", "level")} | {"attribute": pa.string(), "card_type": pa.string()}
    finder = found.PairFinder(pa.table({c: pa.array([q.get(c) for q in queries], t) for c, t in asked.items()}))
    made = list(found.chunks([str(tmp_path / f"{n}.parquet") for n in range(4)]))
    assert sum(c.rows for c in made) == len(items) and all(c.rows <= most for c in made) and len(made) == (16 if most == 7 else 1)
    got = Counter()
    for chunk in made:
        for ids, lists in finder.pairs(chunk):
            assert len(lists.values) < most + chunk.rows
            got.update((q, i) for q, some in zip(ids.to_pylist(), lists.to_pylist()) for i in some)
    assert got == Counter((q["query_id"], i["item_id"]) for q in queries for i in items if brute.in_scope(q, i))
