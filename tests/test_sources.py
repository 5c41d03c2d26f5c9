import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fathomline.operators.encode import HashedTrigramEncoder
from fathomline.plans.digests import reconcile_digests
from fathomline.plans.ingest import ingest, reconcile
from fathomline.plans.search import as_items, hybrid_search, search_report
from fathomline.sources.index_table import IndexStore
from fathomline.sources.items import list_files, listing, read_bodies, read_items, split_bad_records, to_index_rows
from fathomline.sources.paths import key_from_path, path_is_item, within_size

ENCODERS = {"embedding": None, "embedding_local": HashedTrigramEncoder(32)}


def put(folder, name, body):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False))
    return path


def full(key, **more):
    return {"id": key, "type": "monster", "name": f"Item {key}", "englishAttribute": "dark", "effectText": "Does it.",
            "level": 4, "atk": 1000 + key, "def": 500, "properties": ["Dragon", "Effect"], **more}


@pytest.fixture()
def folder(tmp_path):
    d = str(tmp_path / "items")
    os.makedirs(d)
    put(d, "1.json", full(1))
    put(d, "2.json", full(2, atk=0, effectText="", level=None))
    put(d, "3.json", {"id": 3, "name": "Spell", "englishAttribute": "spell", "effectText": "Draw."})
    return d


def keyed(df):
    return {r.item_key: r for r in df.collect()}


def test_read(spark, folder):
    put(folder, ".hidden.json", full(90))
    put(folder, "notes.txt", full(91))
    put(folder, "sub/92.json", full(92))
    put(folder, "4.json", "{not valid")
    put(folder, "5.json", "[1]")
    put(folder, "6.json", full(6, atk="2200", **{"def": 12.7}, level="abc", properties=[]))
    put(folder, "7.json", full(7, atk="12.7", **{"def": True}, level=-3.9, properties=["it's"]))
    put(folder, "8.json", {"id": 8})
    put(folder, "9.json", {"name": "no key"})
    good, bad = split_bad_records(read_items(spark, folder))
    rows = keyed(to_index_rows(good))
    assert set(rows) == {1, 2, 3, 6, 7, 8, None}
    assert {os.path.basename(r.path) for r in bad.collect()} == {"4.json", "5.json"}
    assert rows[1].content == (
        "Name: Item 1 | Attribute: dark | Level: 4 | ATK: 1001 | DEF: 500 | PROPERTIES: ['Dragon', 'Effect']"
        " | Description: Does it."
    )
    assert rows[2].content == "Name: Item 2 | Attribute: dark | ATK: 0 | DEF: 500 | PROPERTIES: ['Dragon', 'Effect']"
    assert rows[3].content == "Name: Spell | Attribute: spell | Description: Draw."
    assert (rows[6].atk, rows[6].def_, rows[6].level) == (2200, 12, None) and "PROPERTIES: []" in rows[6].content
    assert (rows[7].atk, rows[7].def_, rows[7].level) == (None, 1, -3) and '["it\'s"]' in rows[7].content
    assert rows[8].content == "Name: None"
    with pytest.raises(Exception, match="unreadable document"):
        split_bad_records(read_items(spark, folder), "fail")[0].collect()


def test_empty_directory(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    store = IndexStore(spark, str(tmp_path / "store"))
    result = ingest(spark, str(tmp_path / "none"), store, ENCODERS)
    assert {r.status: r.n for r in result.stats.collect()} == dict(ingested=0, skipped=0, rejected=0, quarantined=0, failed=0)
    assert result.version is None and store.read().count() == 0


def test_size_guard(spark, folder):
    at_limit = json.dumps(full(10, effectText=""))
    put(folder, "10.json", at_limit + " " * (51200 - len(at_limit)))
    put(folder, "11.json", json.dumps(full(11)) + " " * 51200)
    assert set(keyed(read_items(spark, folder, max_bytes=51200))) == {1, 2, 3, 10}
    assert set(keyed(read_items(spark, folder))) == {1, 2, 3, 10, 11}
    df = spark.createDataFrame([("é" * 5,), ("e" * 10,), ("e" * 11,)], "t string")
    assert df.where(within_size(F.col("t"), 10)).count() == 2


def test_paths(spark):
    names = ["/w/1.json", "/w/.2.json", "/w/x.JSON", "/w/a.json.txt", "/w/abc.json", "12.json", "/w/1_0.json", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: (r.ok, r.k) for r in df.select("p", path_is_item(F.col("p")).alias("ok"), key_from_path(F.col("p")).alias("k")).collect()}
    assert got["/w/1.json"] == (True, 1) and got["12.json"] == (True, 12) and got["/w/1_0.json"] == (True, 10)
    assert got["/w/.2.json"][0] is False and got["/w/x.JSON"] == (False, None) and got["/w/a.json.txt"] == (False, None)
    assert got["/w/abc.json"] == (True, None) and got[None] == (False, None)


def stats(result):
    return {r.status: r.n for r in result.stats.collect()}


def test_incremental_ingest(spark, folder, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    put(folder, "bad.json", "{")
    put(folder, "nokey.json", {"name": "x"})
    first = ingest(spark, folder, store, ENCODERS)
    assert stats(first) == dict(ingested=3, skipped=0, rejected=1, quarantined=1, failed=0)
    before = keyed(store.read())
    assert len(before) == 3 and len(before[1].embedding_local) == 32 and before[1].embedding is None

    again = ingest(spark, folder, store, ENCODERS)
    assert stats(again) == dict(ingested=0, skipped=3, rejected=1, quarantined=1, failed=0) and again.version is None

    put(folder, "1.json", full(1, atk=9))
    put(folder, "4.json", full(4))
    third = ingest(spark, folder, store, ENCODERS)
    assert stats(third) == dict(ingested=2, skipped=2, rejected=1, quarantined=1, failed=0)
    after = keyed(store.read())
    assert after[1].atk == 9 and after[1].content_hash != before[1].content_hash and after[2] == before[2]
    assert set(after) == {1, 2, 3, 4}

    # A second encoder switched on later is filled in only on request.
    both = {"embedding": HashedTrigramEncoder(16), "embedding_local": HashedTrigramEncoder(32)}
    assert stats(ingest(spark, folder, store, both))["ingested"] == 0
    assert stats(ingest(spark, folder, store, both, require_vectors=["embedding"]))["ingested"] == 4
    assert all(len(r.embedding) == 16 for r in store.read().collect())
    # Switched off again, an edit keeps the stored vector.
    put(folder, "4.json", full(4, atk=1))
    ingest(spark, folder, store, ENCODERS)
    assert len(keyed(store.read())[4].embedding) == 16


def test_failed_rows_are_taken_up_again(spark, folder, tmp_path):
    class Picky:
        def __init__(self, word):
            self.word = word

        def prepare(self, text):
            return text

        def load(self):
            def encode(texts):
                if any(self.word in t for t in texts):
                    raise RuntimeError("refused")
                return [[1.0, 2.0] for _ in texts]

            return encode

    store = IndexStore(spark, str(tmp_path / "store"))
    first = ingest(spark, folder, store, {"embedding_local": Picky("Spell")})
    assert stats(first) == dict(ingested=2, skipped=0, rejected=0, quarantined=0, failed=1)
    assert [(r.item_key, r.embed_error) for r in first.failed.collect()] == [(3, "RuntimeError: refused")]
    assert set(keyed(store.read())) == {1, 2}
    second = ingest(spark, folder, store, {"embedding_local": Picky("nothing")})
    assert stats(second) == dict(ingested=1, skipped=2, rejected=0, quarantined=0, failed=0)
    assert set(keyed(store.read())) == {1, 2, 3}


def test_last_write_of_a_key_wins(spark, folder, tmp_path):
    put(folder, "a.json", full(50, name="older"))
    put(folder, "b.json", full(50, name="newer"))
    os.utime(os.path.join(folder, "a.json"), (1, 1_000_000))
    os.utime(os.path.join(folder, "b.json"), (1, 2_000_000))
    store = IndexStore(spark, str(tmp_path / "store"))
    ingest(spark, folder, store, ENCODERS)
    assert keyed(store.read())[50].name == "newer" and store.read().count() == 4


def test_reconcile(spark, folder, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    ingest(spark, folder, store, ENCODERS)
    os.remove(os.path.join(folder, "2.json"))
    put(folder, "3.json", {"id": 3, "name": "Changed"})
    put(folder, "5.json", full(5))
    reconcile(spark, folder, store, ENCODERS)
    rows = keyed(store.read())
    assert set(rows) == {1, 3, 5} and rows[3].name == "Changed"
    versions = os.listdir(tmp_path / "store")
    reconcile(spark, folder, store, ENCODERS)
    assert os.listdir(tmp_path / "store") == versions


def test_search_over_the_ingested_index(spark, folder, tmp_path):
    for key, name in ((20, "Blue Eyes Dragon"), (21, "Red Eyes Dragon"), (22, "Stone Wall")):
        put(folder, f"{key}.json", full(key, name=name, atk=key * 100))
    store = IndexStore(spark, str(tmp_path / "store"))
    ingest(spark, folder, store, ENCODERS)
    items = as_items(store.read(), "embedding_local")
    queries = spark.createDataFrame(
        [(1, "blue eyes dragon", 2, None), (2, "eyes dragon more than 2100 ATK", 5, None), (3, "dragon", 5, 99999)],
        "query_id bigint, query string, limit int, min_atk bigint",
    )
    found = hybrid_search(queries, items, None, HashedTrigramEncoder(32))
    got = [(r.query_id, r["rank"], r.item_id) for r in found.orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 1, 20) and len([g for g in got if g[0] == 1]) == 2
    assert [g for g in got if g[0] == 2] == [(2, 1, 21), (2, 2, 22)]
    report = {r.query_id: r.report for r in search_report(queries, items, encoder=HashedTrigramEncoder(32)).collect()}
    assert report[1].startswith("Top 2 results for: blue eyes dragon\n\n1. Blue Eyes Dragon\n   Name: Blue Eyes Dragon |")
    assert report[3] == "No cards found matching your query."


def test_vectors_of_another_length_fail(spark, tmp_path):
    files, store = str(tmp_path / "items"), IndexStore(spark, str(tmp_path / "store"))
    put(files, "1.json", full(1))
    ingest(spark, files, store, {"embedding_local": HashedTrigramEncoder(8)})
    put(files, "2.json", full(2))
    result = ingest(spark, files, store, {"embedding_local": HashedTrigramEncoder(16)})
    assert [(r.item_key, r.embed_error) for r in result.failed.collect()] == [(2, "embedding_local: 16 dimensions, not 8")]
    assert [r.item_key for r in store.read().collect()] == [1]
    ingest(spark, files, store, {"embedding_local": HashedTrigramEncoder(8)})
    assert sorted(r.item_key for r in store.read().collect()) == [1, 2]


def test_the_skip_join_moves_no_contents(spark, tmp_path, plan):
    files = str(tmp_path / "items")
    for i in range(4):
        put(files, f"{i}.json", full(i))
    from fathomline.plans.ingest import mark_documents

    marked = mark_documents(read_items(spark, files), IndexStore(spark, str(tmp_path / "none")).read())
    assert {r.status for r in marked.collect()} == {"changed"}
    text = plan(marked)
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_reconcile_by_digests_opens_what_differs(spark, folder, tmp_path):
    store, manifest = IndexStore(spark, str(tmp_path / "store")), str(tmp_path / "manifest")

    def run():
        done = reconcile_digests(spark, folder, store, ENCODERS, manifest, buckets=4)
        return sorted(os.path.basename(r.path) for r in done.opened.collect()), done

    for key in range(10, 30):
        put(folder, f"{key}.json", full(key))
    put(folder, "40.json", "{not valid")
    store.publish(spark.createDataFrame([(40, "kept"), (41, "dropped")], "item_key bigint, name string"))
    opened, done = run()
    assert len(opened) == 24 and [r.item_key for r in done.dropped.collect()] == [41]
    assert set(keyed(store.read())) == {1, 2, 3, 40, *range(10, 30)}
    # Nothing differs: nothing is opened or written.
    opened, done = run()
    assert opened == [] and done.version is None
    # A file changed, one gone, one new, and one row lost from the index.
    put(folder, "12.json", full(12, name="Changed name"))
    os.remove(os.path.join(folder, "13.json"))
    put(folder, "99.json", full(99))
    store.apply(store.read().where("false"), spark.createDataFrame([(14,), (1,)], "item_key bigint"))
    opened, done = run()
    assert opened == ["1.json", "12.json", "14.json", "99.json"]
    rows = keyed(store.read())
    assert set(rows) == {1, 2, 3, 40, 99, *range(10, 30)} - {13} and rows[12].name == "Changed name"
    assert rows[14].embedding_local is not None
    assert run()[0] == []


def test_reconcile_by_digests_emptied_and_shared_keys(spark, folder, tmp_path):
    store, manifest = IndexStore(spark, str(tmp_path / "store")), str(tmp_path / "manifest")
    put(folder, "a.json", full(50, name="older"))
    put(folder, "b.json", full(50, name="newer"))
    os.utime(os.path.join(folder, "a.json"), (1, 1_000_000))
    os.utime(os.path.join(folder, "b.json"), (1, 2_000_000))
    reconcile_digests(spark, folder, store, ENCODERS, manifest, buckets=2)
    assert keyed(store.read())[50].name == "newer"
    # Two files for one key: the bucket differs each time, nothing is opened for it.
    assert reconcile_digests(spark, folder, store, ENCODERS, manifest, buckets=2).opened.isEmpty()
    os.remove(os.path.join(folder, "b.json"))
    done = reconcile_digests(spark, folder, store, ENCODERS, manifest, buckets=2)
    assert [os.path.basename(r.path) for r in done.opened.collect()] == ["a.json"]
    assert keyed(store.read())[50].name == "older"
    for name in os.listdir(folder):
        os.remove(os.path.join(folder, name))
    reconcile_digests(spark, folder, store, ENCODERS, manifest, buckets=2)
    assert store.read().count() == 0
    assert reconcile_digests(spark, folder, store, ENCODERS, manifest, buckets=2).version is None


def test_files_are_listed_without_opening_and_read_by_all_cores(spark, tmp_path, plan):
    folder = str(tmp_path / "items")
    paths = [put(folder, f"{n}.json", full(n)) for n in range(40)]
    for name in (".7.json", "_8.json", "9.txt", "below/10.json"):
        put(os.path.dirname(f"{folder}/{name}"), os.path.basename(name), full(99))
    listed = list_files(spark, folder)
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    assert sorted(listed.collect()) == sorted(binary.select("path", "modificationTime", "length").collect())
    assert listed.count() == len(paths)
    # A part for each few files would be as many tasks as the directory grows by.
    assert read_items(spark, folder).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert "binaryFile" not in plan(read_items(spark, folder)) + plan(listing(spark, folder))


def test_files_of_any_bytes(spark, tmp_path):
    folder = str(tmp_path / "items")
    put(folder, "1.json", full(1))
    with open(f"{folder}/2.json", "wb") as f:
        f.write(b'{"id": 2, "name": "\xff"')
    good, bad = split_bad_records(read_items(spark, folder))
    assert [r.item_key for r in good.collect()] == [1] and bad.count() == 1
    bodies = read_bodies(list_files(spark, folder)).select("path", "problem", F.col("body").isNull().alias("none"))
    assert sorted((r.path[-6:], r.problem, r.none) for r in bodies.collect()) == [("1.json", None, False), ("2.json", "not UTF-8", True)]


def test_names_are_looked_up_by_all_cores(spark, tmp_path, plan):
    """One task reads the names; times and sizes are looked up where the names are dealt to."""
    folder = str(tmp_path / "files")
    for i in range(30):
        put(folder, f"{i}.json", full(i))
    os.symlink(folder + "/missing", folder + "/40.json")
    os.makedirs(folder + "/50.json")
    listed = list_files(spark, folder)
    assert "RoundRobinPartitioning" in plan(listed)
    assert {(os.path.basename(r.path), r.n_bytes) for r in listed.collect()} == {(f"{i}.json", len(json.dumps(full(i)))) for i in range(30)}


def test_key_of_a_long_path(spark):
    """The key takes one pass over the name: no pattern is tried again from each of its places."""
    paths = ["/w/" + "a" * 100_000 + "/12.json", "/w/" + "b" * 100_000, "/w/ +1_2 .json", "7.json", "/w/7.json.json", "/w/.json", "/w/1__2.json", "/7.json\n", None]
    began = time.time()
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(key_from_path(F.col("path")).alias("k")).collect()
    assert [r.k for r in rows] == [12, None, 12, 7, None, None, None, None, None]
    assert time.time() - began < 15
