import hashlib

import pytest
from pyspark.sql import functions as F

from fathomline.operators import merge
from fathomline.sources.index_table import (
    FILTERED, IndexStore, existing_hashes, union_versions, upgrade_schema, write_clustered, write_index,
)

INDEX = "item_key bigint, name string, level int, content_hash string, embedding array<float>"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(
        [(1, "one", 1, "h1", [1.0]), (2, "two", 2, None, [2.0]), (3, "three", None, "h3", None)], INDEX
    )


@pytest.mark.parametrize("small", [True, False, None])
def test_upsert(spark, index, small):
    changes = spark.createDataFrame(
        [(2, None, 9, "n2", None), (3, "drei", 3, "n3", [3.0]), (4, "four", None, "n4", None)], INDEX
    )
    merged = merge.merge_upsert(index, changes, keep_if_null=["embedding"], small=small)
    assert merged.columns == index.columns
    assert rows(merged) == rows(spark.createDataFrame(
        [(1, "one", 1, "h1", [1.0]), (2, None, 9, "n2", [2.0]), (3, "drei", 3, "n3", [3.0]),
         (4, "four", None, "n4", None)], INDEX,
    ))
    assert rows(merge.merge_upsert(merged, changes, keep_if_null=["embedding"], small=small)) == rows(merged)
    assert rows(merge.merge_upsert(index, changes.where("false"), small=small, keep_if_null=[])) == rows(index)


def test_small_changes_do_not_shuffle_the_index(spark, index, plan, tmp_path):
    index.write.parquet(str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    changes = stored.where("item_key = 2")
    assert "Exchange hashpartitioning" not in plan(merge.merge_upsert(stored, changes, keep_if_null=["embedding"]))


def test_delete(spark, index):
    gone = spark.createDataFrame([(2,), (2,), (8,)], "item_key bigint")
    assert [r.item_key for r in merge.merge_delete(index, gone).orderBy("item_key").collect()] == [1, 3]
    assert rows(merge.missing_tombstones(index, gone)) == [(8,)]


def test_changed_rows(spark, index):
    source = spark.createDataFrame(
        [(1, "h1"), (2, "h2"), (3, "x"), (5, "h1"), (None, "h1")], "item_key bigint, content_hash string"
    )
    got = {(r.item_key, r.content_hash) for r in merge.changed_rows(source, index).collect()}
    assert got == {(2, "h2"), (3, "x"), (5, "h1"), (None, "h1")}
    again = spark.createDataFrame([(1, "h1"), (3, "h3")], "item_key bigint, content_hash string")
    assert merge.changed_rows(again, index).count() == 0
    stale = merge.changed_rows(again, index, require_vectors=["embedding"])
    assert [r.item_key for r in stale.collect()] == [3]


def test_latest_per_key(spark, plan):
    df = spark.createDataFrame(
        [(1, 5, "a"), (1, 7, "a"), (1, 7, "b"), (2, None, "z"), (2, 1, "y")], "item_key int, modified_at int, path string"
    )
    assert rows(merge.latest_per_key(df)) == [(1, 7, "b"), (2, 1, "y")]
    assert plan(merge.latest_per_key(df)).count("WindowGroupLimit") >= 2


def test_snapshot_diff(spark, index):
    listing = spark.createDataFrame([(1, "h1"), (2, "h2"), (9, "h9")], "item_key bigint, content_hash string")
    assert rows(merge.snapshot_diff(listing, index)) == [
        (1, "unchanged"), (2, "update"), (3, "delete"), (9, "insert")
    ]


def test_check_keys_and_count(spark, index):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "item_key int")
    assert rows(merge.check_keys(df)) == [(1, 2), (None, 1)]
    assert merge.check_keys(index).count() == 0
    assert merge.index_count(index).first().total == 3


def test_stats(spark, index):
    source = spark.createDataFrame([(1, "h1"), (2, "h2"), (None, "q")], "item_key bigint, content_hash string")
    bad = spark.createDataFrame([("p", "{")], "path string, bad_record string")
    stats = merge.ingest_stats(source, merge.changed_rows(source, index), bad)
    assert dict(rows(stats)) == {"ingested": 1, "skipped": 1, "rejected": 1, "quarantined": 1, "failed": 0}


def test_schema_versions(spark, index):
    old = spark.createDataFrame([(7, "seven")], "item_key int, name string")
    both = upgrade_schema(union_versions(index, old))
    assert both.count() == 4 and both.where("item_key = 7").first().content_hash is None
    assert dict(both.dtypes)["item_key"] == "bigint" and dict(both.dtypes)["embedding_local"] == "array<float>"


def test_two_column_scan(spark, index, plan, tmp_path):
    index.write.parquet(str(tmp_path / "i"))
    text = plan(existing_hashes(spark.read.parquet(str(tmp_path / "i"))))
    assert "ReadSchema: struct<item_key:bigint,content_hash:string>" in text


def test_store_versions(spark, index, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    assert store.publish(index, batch_id=0)
    before = store.read()
    assert store.publish(index.where("false"), batch_id=0) is None
    store.publish(index.where("item_key = 1"), batch_id=1)
    assert store.read().count() == 1 and before.count() == 3
    assert store.published(1) and not store.published(2)
    # A version that was not finished is not seen.
    (tmp_path / "store" / "full-00000009-batch9").mkdir()
    assert store.read().count() == 1


@pytest.mark.parametrize("compact_after", [0, 2, 16])
def test_store_changes(spark, tmp_path, compact_after):
    """Batches of changes agree with a dictionary, whenever a full snapshot is written."""
    import random

    r = random.Random(compact_after)
    store = IndexStore(spark, str(tmp_path / "store"), compact_after)
    want = {}
    for batch in range(5):
        fresh = [
            (k, r.choice([None, f"n{batch}"]), batch, f"h{batch}", r.choice([None, [float(batch)]]))
            for k in r.sample(range(12), 5)
        ]
        gone = [(k,) for k in r.sample(range(12), 2)]
        upserts = upgrade_schema(spark.createDataFrame(fresh, INDEX))
        deletes = spark.createDataFrame(gone, "item_key bigint")
        assert store.apply(upserts, deletes, batch)
        assert store.apply(upserts, deletes, batch) is None
        for (k,) in gone:
            want.pop(k, None)
        for row in fresh:
            old = want.get(row[0])
            want[row[0]] = (*row[:4], row[4] if row[4] is not None or old is None else old[4])
        got = store.read().select("item_key", "name", "level", "content_hash", "embedding")
        assert rows(got) == rows(spark.createDataFrame(list(want.values()), INDEX))
    kinds = {v.full for v in store.versions()}
    assert kinds == {0: {True}, 2: {True, False}, 16: {False}}[compact_after]


def test_sorted_index_skips_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("item_key"), (F.col("id") * 7 % 1000).cast("int").alias("atk"))
    path = str(tmp_path / "sorted")
    write_index(df, path, ["atk", "item_key"], files=4)
    stored = spark.read.parquet(path)
    spans = stored.groupBy(F.input_file_name().alias("f")).agg(F.min("atk").alias("lo"), F.max("atk").alias("hi")).collect()
    ordered = sorted((r.lo, r.hi) for r in spans)
    assert len(ordered) == 4 and all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def rows_scanned(df):
    """What the scan hands on: the rows of the row groups that were not skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith("Scan"):
        plan = plan.children().head() if plan.children().size() else plan.executedPlan()
    return plan.metrics().apply("numOutputRows").value()


def test_every_filter_skips_row_groups(spark, tmp_path):
    """A clustered snapshot: each of the four columns alone leaves out most rows, NULLs and frequent values included."""
    df = spark.range(40_000).select(
        F.col("id").alias("item_key"), F.pmod(F.xxhash64("id"), F.lit(4000)).cast("int").alias("atk"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000)).cast("int").alias("def_"),
        F.when(F.col("id") % 3 > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(12))).cast("int").alias("level"),
        F.element_at(F.array(*map(F.lit, ["dark", "dark", "dark", "earth", "fire", "light", "water", "wind", None])),
                     (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(9)) + 1).cast("int")).alias("english_attribute"),
    )
    store = IndexStore(spark, str(tmp_path / "store"), cluster_by=FILTERED, files=256)
    store.publish(df)
    stored = store.read()
    assert stored.count() == 40_000
    for rule in ("atk between 1000 and 1010", "def_ >= 2990", "level = 7", "english_attribute = 'fire'"):
        held = stored.where(rule)
        assert sorted(r[0] for r in held.select("item_key").collect()) == sorted(r[0] for r in df.where(rule).select("item_key").collect())
        assert rows_scanned(held) < 20_000, rule
    plain = IndexStore(spark, str(tmp_path / "plain"))
    plain.publish(df)
    assert rows_scanned(plain.read().where("atk between 1000 and 1010")) == 40_000


def test_layout_of_nothing_and_of_one_value(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("item_key"), F.lit(5).alias("atk"), F.lit(None).cast("int").alias("level"))
    write_clustered(df, str(tmp_path / "one"), ["atk", "level"])
    assert spark.read.parquet(str(tmp_path / "one")).count() == 50
    write_clustered(df.where("false"), str(tmp_path / "none"), ["atk", "level"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_upsert_property(spark):
    """Random merges agree with a dictionary."""
    import random

    r = random.Random(3)
    make = lambda keys: [
        (k, r.choice([None, "n"]), r.choice([None, k]), hashlib.md5(str(k).encode()).hexdigest(),
         r.choice([None, [float(r.randint(0, 9))]])) for k in keys
    ]
    stored, changed = make(r.sample(range(60), 30)), make(r.sample(range(60), 25))
    want = {row[0]: row for row in stored}
    for row in changed:
        old = want.get(row[0])
        want[row[0]] = (*row[:4], row[4] if row[4] is not None or old is None else old[4])
    for small in (True, False):
        got = merge.merge_upsert(
            spark.createDataFrame(stored, INDEX), spark.createDataFrame(changed, INDEX), keep_if_null=["embedding"],
            small=small,
        )
        assert rows(got) == rows(spark.createDataFrame(list(want.values()), INDEX))
