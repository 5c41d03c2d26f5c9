import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from fathomline.operators import blocks
from fathomline.operators.filters import QUERY_SCOPE, Filters, filter_items, filter_pairs, items_with_properties
from fathomline.operators.fusion import fused_candidates, materialize, rrf_fuse
from fathomline.operators.ivf import ivf_build, ivf_topk, recall_at_k
from fathomline.operators.lexical import lexical_topk, trigram_index, trigram_topk
from fathomline.operators.nearest import knn_join, nearest_items, vector_topk

ITEMS = (
    "item_id bigint, name string, level int, atk int, def_ int, attribute string, properties array<string>, "
    "embedding array<float>"
)
QUERIES = (
    "query_id bigint, search_text string, query_vec array<float>, eff_min bigint, eff_max bigint, min_def bigint, "
    "max_def bigint, level bigint, attribute string, card_type string, k int"
)
WORDS = ["dragon", "dragao", "white", "night", "knight", "eyes", "blue", "stone", "ação"]


def make_items(n=300, seed=1):
    r = random.Random(seed)
    # A third of the items share one name and one vector.
    hot = [1.0, 0.5, 0.25, 0.0]
    out = []
    for i in range(n):
        same = i % 3 == 0
        vector = hot if same else [float(r.randint(-3, 3)) for _ in range(4)]
        out.append({
            "item_id": i,
            "name": "white dragon" if same else (" ".join(r.sample(WORDS, 2)) if i % 11 else None),
            "level": r.choice([None, 1, 2, 3]),
            "atk": r.choice([None, *range(0, 1000, 50)]),
            "def_": r.choice([None, *range(0, 1000, 50)]),
            "attribute": r.choice([None, "fire", "Fire", "dark"]),
            "properties": r.choice([None, [], ["a"], ["a", "b"], ["b", "b"]]),
            "embedding": None if i % 7 == 1 else ([0.0] * 4 if i % 13 == 2 else vector),
        })
    return out


def make_queries(n=40, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        q = {
            "query_id": 1000 + i,
            "search_text": r.choice([" ".join(r.sample(WORDS, 2)), "white dragon", "zzz", "", None]),
            "query_vec": r.choice([[1.0, 0.5, 0.25, 0.0], [float(r.randint(-3, 3)) for _ in range(4)], [0.0] * 4, None]),
            "k": r.choice([1, 3, 10, 400]),
        }
        for name, values in (
            ("eff_min", [200, 2000]), ("eff_max", [700, -1]), ("min_def", [100]), ("max_def", [800]), ("level", [2]),
            ("attribute", ["fire", "none"]), ("card_type", ["b", "zz"]),
        ):
            q[name] = r.choice(values) if r.random() < 0.2 else None
        out.append(q)
    return out


@pytest.fixture(scope="module")
def world(spark):
    items, queries = make_items(), make_queries()
    columns = [c.split()[0] for c in ITEMS.split(", ")]
    idf = spark.createDataFrame([tuple(i[c] for c in columns) for i in items], ITEMS)
    columns = [c.split()[0] for c in QUERIES.split(", ")]
    qdf = spark.createDataFrame([tuple(q[c] for c in columns) for q in queries], QUERIES)
    return items, queries, idf.repartition(5), qdf


def lists(df, rank):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r[rank])):
        out[r.query_id].append((r.item_id, r.distance))
        assert r[rank] == len(out[r.query_id])
    return dict(out)


def expected(queries, each):
    return {q["query_id"]: found for q in queries if (found := each(q))}


@pytest.mark.parametrize("grid", [False, True])
def test_vector_topk(world, grid, monkeypatch):
    items, queries, idf, qdf = world
    monkeypatch.setattr(blocks, "ITEMS_PER_CELL", 37)
    monkeypatch.setattr(blocks, "QUERIES_PER_CELL", 9)
    got = lists(vector_topk(qdf, idf, "k", force_grid=grid), "vec_rank")
    assert got == expected(queries, lambda q: brute.vector_list(q, items, q["k"]))


@pytest.mark.parametrize("grid", [False, True])
def test_lexical_topk(world, grid, monkeypatch):
    items, queries, idf, qdf = world
    monkeypatch.setattr(blocks, "ITEMS_PER_CELL", 50)
    got = lists(lexical_topk(qdf, idf, "k", force_grid=grid), "lex_rank")
    assert got == expected(queries, lambda q: brute.lexical_list(q, items, q["k"]))


@pytest.mark.parametrize("max_postings", [0, 60, 120, 10_000])
def test_trigram_index_gives_the_same_lists(world, max_postings):
    items, queries, idf, qdf = world
    got = lists(trigram_topk(qdf, idf, 10, max_postings=max_postings), "lex_rank")
    assert got == expected(queries, lambda q: brute.lexical_list(q, items, 10))


@pytest.mark.parametrize("threshold", [0.1, 0.5, 1.0])
def test_trigram_index_thresholds(world, threshold):
    items, queries, idf, qdf = world
    got = lists(trigram_topk(qdf, idf, 10, trigram_index(idf), threshold=threshold), "lex_rank")
    assert got == expected(queries, lambda q: brute.lexical_list(q, items, 10, threshold))


@pytest.mark.parametrize("mode", ["left", "outer"])
def test_one_pass_fusion(world, mode):
    items, queries, idf, qdf = world
    fused, _ = fused_candidates(qdf, idf, "k", mode=mode)
    got = defaultdict(list)
    for r in sorted(fused.collect(), key=lambda r: (r.query_id, r.rrf_rank)):
        got[r.query_id].append(r.item_id)
    assert dict(got) == expected(queries, lambda q: brute.fused(q, items, q["k"], mode))


@pytest.mark.parametrize("mode", ["left", "outer"])
def test_fusion_of_two_lists(world, mode):
    items, queries, idf, qdf = world
    fused = rrf_fuse(vector_topk(qdf, idf, 10), lexical_topk(qdf, idf, 10), 10, mode=mode)
    got = defaultdict(list)
    for r in sorted(fused.collect(), key=lambda r: (r.query_id, r.rrf_rank)):
        got[r.query_id].append(r.item_id)
    assert dict(got) == expected(queries, lambda q: brute.fused(q, items, 10, mode))


def test_fusion_mode_is_checked(world):
    with pytest.raises(ValueError):
        rrf_fuse(None, None, 1, mode="inner")


@pytest.mark.parametrize("nprobe", [1, 3, 6])
def test_ivf_is_exact(world, nprobe, tmp_path, monkeypatch):
    items, queries, idf, qdf = world
    monkeypatch.setattr(blocks, "ITEMS_PER_CELL", 20)
    index = ivf_build(idf, 6, str(tmp_path / "lists"))
    got = lists(ivf_topk(qdf, index, 10, nprobe=nprobe), "vec_rank")
    assert got == expected(queries, lambda q: brute.vector_list(q, items, 10))


def test_ivf_recall(world, tmp_path):
    _, _, idf, qdf = world
    bare = qdf.select("query_id", "query_vec")
    index = ivf_build(idf, 6, str(tmp_path / "lists"))
    truth = knn_join(bare, idf, 10)
    full = recall_at_k(ivf_topk(bare, index, 10, nprobe=6, exact=False), truth)
    assert {r.recall for r in full.collect()} == {1.0}
    part = recall_at_k(ivf_topk(bare, index, 10, nprobe=1, exact=False), truth)
    assert all(0 <= r.recall <= 1 and r.expected == 10 for r in part.collect())


def test_single_query(world):
    items, _, idf, _ = world
    got = [(r.item_id, r.distance) for r in nearest_items(idf, [1.0, 2.0, 0.0, 1.0], 5, Filters(min_atk=100)).collect()]
    assert got == brute.vector_list({"query_vec": [1.0, 2.0, 0.0, 1.0], "eff_min": 100}, items, 5)


def test_unequal_dimensions_are_refused(world):
    _, _, idf, qdf = world
    short = qdf.select("query_id", F.array(F.lit(1.0).cast("float")).alias("query_vec"))
    with pytest.raises(Exception, match="unequal length"):
        knn_join(short, idf, 3).collect()


def test_no_queries_and_no_items(world):
    _, _, idf, qdf = world
    assert vector_topk(qdf.where("false"), idf, 5).count() == 0
    assert vector_topk(qdf, idf.where("false"), 5).count() == 0
    assert vector_topk(qdf, idf.where("false"), 5, force_grid=True).count() == 0


def test_ranks_are_cut_before_the_shuffle(world, plan):
    _, _, idf, qdf = world
    for grid in (False, True):
        text = plan(vector_topk(qdf, idf, "k", force_grid=grid))
        assert text.count("WindowGroupLimit") >= 2
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_block_of_queries_hands_on_its_best_once(world, monkeypatch):
    """Rows between the tasks grow with the queries alone, not with queries times cells of items."""
    _, queries, idf, qdf = world
    monkeypatch.setattr(blocks, "ITEMS_PER_CELL", 2)
    monkeypatch.setattr(blocks, "QUERIES_PER_CELL", 1)
    monkeypatch.setattr(blocks, "TASKS_PER_CORE", 1)
    handed = []
    keep = blocks.keep_best
    monkeypatch.setattr(blocks, "keep_best", lambda partial, k: handed.append(partial) or keep(partial, k))
    many = qdf.where("query_vec is not null").withColumn("k", F.lit(3))
    vector_topk(many, idf, 3, force_grid=True)
    assert handed[0].count() <= 3 * many.count()


def test_only_what_can_be_nearer_is_put_in_order(monkeypatch):
    """Items come in order of their ids: once a query has its rows, equally similar names are not looked at."""
    import pyarrow as pa

    offered = []
    take = blocks._Best.take
    monkeypatch.setattr(blocks._Best, "take", lambda self, q, i, d: offered.append(len(q)) or take(self, q, i, d))
    queries = pa.table({"query_id": [1, 2], "k": [5, 5], "query_grams": ["  a\t a ", "  a\t a "]})
    scorer = blocks.BlockScorer(queries, [blocks.TrigramRanker()])
    n = 50_000
    scorer.add(pa.table({"item_id": range(n), "item_text": ["a"] * n, "item_grams": ["  a\t a "] * n}))
    assert scorer.result()["item_id"].to_pylist() == [0, 1, 2, 3, 4] * 2
    assert sum(offered) <= 2 * blocks.FIRST_CHUNK


def test_what_all_queries_demand_reaches_the_scan(world, plan, tmp_path):
    _, _, idf, qdf = world
    idf.write.parquet(str(tmp_path / "items"))
    stored = idf.sparkSession.read.parquet(str(tmp_path / "items"))
    bounded = qdf.withColumn("eff_min", F.lit(300).cast("bigint")).select("query_id", "query_vec", "k", "eff_min")
    text = plan(vector_topk(bounded, stored, "k"))
    assert "GreaterThanOrEqual(atk,300)" in text
    scan = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "embedding" in scan and "properties" not in scan and "name" not in scan


@pytest.mark.parametrize("shards", [1, 8])
def test_filter_pairs(world, shards, plan):
    items, queries, idf, qdf = world
    pairs = filter_pairs(qdf, idf, shards=shards)
    got = sorted((r.query_id, r.item_id) for r in pairs.collect())
    assert got == sorted((q["query_id"], i["item_id"]) for q in queries for i in items if brute.in_scope(q, i))
    assert "CartesianProduct" not in plan(pairs) and "NestedLoop" not in plan(pairs)


def test_large_sides_are_not_sent_to_the_driver(world, plan, tmp_path):
    """Postings, keys and texts outgrow their files, whose size Spark goes by."""
    _, _, idf, qdf = world
    idf.write.parquet(str(tmp_path / "items"))
    stored = idf.sparkSession.read.parquet(str(tmp_path / "items"))
    assert "BroadcastExchange" not in plan(filter_pairs(qdf, stored))
    assert "BroadcastExchange" not in plan(materialize(qdf.select("query_id", F.col("query_id").alias("item_id")), stored, ["name"]))
    text = plan(trigram_topk(qdf, stored, 10, max_postings=60))
    assert "embedding" not in text and text.count("SortMergeJoin") >= 3


def test_filter_items(world, plan, tmp_path):
    items, _, idf, _ = world
    wanted = Filters(min_atk=100, max_atk=800, min_def=100, max_def=900, level=2, attribute="fire", card_type="a")
    names = dict(min_atk="eff_min", max_atk="eff_max")
    query = {names.get(k, k): v for k, v in vars(wanted).items()}
    assert {r.item_id for r in filter_items(idf, wanted).collect()} == {
        i["item_id"] for i in items if brute.in_scope(query, i)
    }
    assert filter_items(idf, Filters()).count() == len(items)
    idf.write.parquet(str(tmp_path / "items"))
    text = plan(filter_items(idf.sparkSession.read.parquet(str(tmp_path / "items")), wanted).select("item_id"))
    assert "EqualTo(attribute,fire)" in text and "GreaterThanOrEqual(atk,100)" in text


def test_property_semijoin(world):
    items, _, idf, _ = world
    wanted = idf.sparkSession.createDataFrame([("b",), ("b",)], "property string")
    got = sorted(r.item_id for r in items_with_properties(idf, wanted).collect())
    assert got == sorted(i["item_id"] for i in items if "b" in (i["properties"] or []))


def test_materialize(world):
    _, _, idf, qdf = world
    ids = idf.select("item_id").where("item_id < 5")
    for rows in (5, None, 10**9):
        assert materialize(ids, idf, ["name"], rows).count() == 5


def test_scope_names_are_complete():
    assert set(QUERY_SCOPE) <= {c.split()[0] for c in QUERIES.split(", ")}
