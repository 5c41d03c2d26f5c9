"""Second scoring: what belongs to a query or an item alone is computed once, and gives the same scores."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from fathomline.checks import queries as checks
from fathomline.functions.scoring import lexical_coverage
from fathomline.functions.trigram import trigrams
from fathomline.operators import blocks
from fathomline.operators.learned import PAIR_PARTS, PairModel
from fathomline.operators.rerank import CoverageScorer, rerank, with_held
from fathomline.plans.search import context_prompts, hybrid_search, search_report

WORDS = ["blue", "Dragon", "ação", "x", "ab", "a?b", "ß", "日本語", "𠀀𠀁𠀂", "𐐀z", "--", "", "\n"]
ITEMS = (
    "item_id bigint, name string, content string, level int, atk int, def_ int, attribute string, "
    "properties array<string>, embedding array<float>"
)
QUERIES = "query_id bigint, query string, query_vec array<float>, limit int"


def text(r):
    return None if r.random() < 0.05 else "".join(r.choice(WORDS) + r.choice([" ", "  ", "-", ""]) for _ in range(r.randint(0, 6)))


def tables(spark, n_items=60, n_queries=20):
    r = random.Random(7)
    items = [
        (i, f"{r.choice(WORDS[:5])} ring", f"Name: {r.choice(WORDS[:8])} ring {i % 9}", i % 3, i, i, "fire", ["a"], [r.random(), r.random(), 1.0])
        for i in range(n_items)
    ]
    asked = [(100 + i, f"{r.choice(WORDS[:5])} ring", [r.random(), r.random(), 1.0], 9) for i in range(n_queries)]
    return spark.createDataFrame(asked, QUERIES), spark.createDataFrame(items, ITEMS)


class Counting(CoverageScorer):
    """Counts the rows its parts are computed of."""

    def __init__(self, spark):
        self.queries, self.contents = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def once(self, queries, contents):
        """Whether parts are of rows, not of the 60 candidates of each query; an expression may name its text a few times."""
        return queries <= self.queries.value <= 4 * queries and contents <= self.contents.value <= 4 * contents

    def __call__(self, query, content):
        return self.score(self.asked(query), self.held(content))

    def asked(self, query):
        return super().asked(counted(query, self.queries))

    def held(self, content):
        return super().held(counted(content, self.contents))


def counted(value, rows):
    @F.pandas_udf("string")
    def count(part):
        rows.add(len(part))
        return part

    return count.asNondeterministic()(value)


def test_parts_are_computed_once(spark):
    queries, items = tables(spark)
    scorer = Counting(spark)
    got = hybrid_search(queries, items, limit=30, scorer=scorer).collect()
    assert len(got) == 20 * 30
    assert scorer.once(20, 60)
    want = hybrid_search(queries, items, limit=30).collect()
    assert sorted(got) == sorted(want) and got[0].asDict().keys().isdisjoint({"__asked", "__held"})


@pytest.mark.parametrize("make", [lambda q, i, s: search_report(q, i, scorer=s), lambda q, i, s: search_report(q, i, "cli", scorer=s),
                                  lambda q, i, s: context_prompts(q, i, scorer=s)])
def test_reports_compute_parts_once(spark, make):
    queries, items = tables(spark)
    scorer = Counting(spark)
    got = make(queries, items, scorer).collect()
    assert len(got) == 20 and scorer.once(20, 60)
    # A scorer of two columns, without parts.
    plain = make(queries, items, lambda query, content: lexical_coverage(query, content)).collect()
    assert sorted(got) == sorted(plain)


def test_coverage_of_odd_texts(spark):
    r = random.Random(3)
    pairs = spark.createDataFrame([(i, text(r), text(r)) for i in range(600)], "i int, q string, c string")
    held = trigrams(F.coalesce("c", F.lit("")))
    by_sets = F.when(F.size(trigrams(F.col("q"))) == 0, 0.0).otherwise(F.size(F.array_intersect(trigrams(F.col("q")), held)) / F.size(trigrams(F.col("q"))))
    rows = pairs.select("q", "c", by_sets.alias("want"), lexical_coverage(F.col("q"), F.col("c")).alias("got")).collect()
    assert all(x.want == x.got for x in rows) and len({x.got for x in rows}) > 10
    x = spark.createDataFrame([("Blue cat", "the blue dog")], "q string, c string").select(lexical_coverage(F.col("q"), F.col("c"))).first()[0]
    assert x == len(brute.grams("Blue cat") & brute.grams("the blue dog")) / len(brute.grams("Blue cat"))


def test_learned_parts(spark):
    r = random.Random(4)
    pairs = spark.createDataFrame([(i % 50, i, i, text(r), text(r)) for i in range(400)], "query_id int, item_id int, rrf_rank int, search_text string, content string")
    model = PairModel((0.5, -1.0, 2.0, 0.25, 1.5, -0.5), 0.1)
    plain = rerank(pairs, 3, model).collect()
    parts = with_held(pairs, PAIR_PARTS).withColumn("__asked", PAIR_PARTS.asked(F.col("search_text")))
    assert sorted(map(str, rerank(parts, 3, model).collect())) == sorted(map(str, plain))


def test_blocks_fill_all_cores(spark, monkeypatch):
    """One block more than cores would leave all cores but one idle for a whole pass."""
    monkeypatch.setattr(blocks, "QUERIES_PER_CELL", 1)
    made = []
    place = blocks._placed
    monkeypatch.setattr(blocks, "_placed", lambda queries, n, shards: made.append(n) or place(queries, n, shards))
    queries, items = tables(spark)
    cores = spark.sparkContext.defaultParallelism
    ranked = blocks.blocked_topk(
        queries.limit(cores + 1).select("query_id", F.lit(3).alias("k"), "query_vec"),
        items.select("item_id", F.col("embedding").alias("item_vec")), [blocks.CosineRanker()], force_grid=True,
    )
    assert made == [2 * cores] and ranked.rows.count() == 3 * (cores + 1)


def test_queries_are_prepared_once(spark, monkeypatch):
    """Measured, placed and joined queries are read from files, not joined and parsed for each use."""
    queries, items = tables(spark)
    monkeypatch.setattr(checks, "queries_view", lambda spark, sf: queries)
    assert checks.prepared_with_pool(spark, "").inputFiles()
