import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fathomline.operators.encode import HashedTrigramEncoder
from fathomline.operators.events import ignored_moves, normalize_events
from fathomline.schemas import CHANGE_SCHEMA
from fathomline.sources.changelog import read_change_log
from fathomline.sources.index_table import IndexStore
from fathomline.plans.ingest import ingest
from fathomline.streaming.watch import apply_changes, debounce_batch, debounce_stream, open_failures, read_failures, watch
from test_sources import full, put

ENCODERS = {"embedding_local": HashedTrigramEncoder(8)}
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(ms):
    return START + timedelta(milliseconds=ms)


CASES = [
    (("moved", "/w/4101.json", "/w/archive/4101.json", False), ("upsert", "/w/archive/4101.json", "created")),
    (("moved", "/incoming/4104.json", "/w/4104.json", False), ("upsert", "/w/4104.json", "created")),
    (("moved", "/w/4007.json", "/w/4008.json", False), ("upsert", "/w/4008.json", "created")),
    (("moved", "/w/4007.json", "/w/4008.bak", False), None),
    (("deleted", "/w/4105.json", None, False), ("delete", "/w/4105.json", None)),
    (("created", "/w/1.json", None, False), ("upsert", "/w/1.json", "created")),
    (("modified", "/w/1.json", None, None), ("upsert", "/w/1.json", "modified")),
    (("moved", "/w/dir.json", "/w/other.json", True), None),
    (("moved", "/w/notes.txt", "/w/notes2.txt", False), None),
    (("deleted", "/w/.4105.json", None, False), None),
    (("opened", "/w/1.json", None, False), None),
]


@pytest.mark.parametrize("event,expected", CASES)
def test_normalize(spark, event, expected):
    got = normalize_events(spark.createDataFrame([(*event, START)], CHANGE_SCHEMA)).collect()
    assert [tuple(r)[:3] for r in got] == ([expected] if expected else [])


def test_moves_out_delete_nothing(spark):
    events = spark.createDataFrame([("moved", f"/w/{n}.json", f"/gone/{n}", False, START) for n in range(100)], CHANGE_SCHEMA)
    assert normalize_events(events).count() == 0
    assert ignored_moves(events).count() == 100


def write_log(folder, name, events):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for kind, src, dest, ms in events:
            f.write(json.dumps({"event_type": kind, "src_path": src, "dest_path": dest, "is_directory": False,
                                "ts": at(ms).isoformat()}) + "\n")


def test_debounce_across_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    write_log(log, "a.json", [("created", "/w/1.json", None, 300), ("created", "/w/1.json", None, 0)])
    changes = normalize_events(read_change_log(spark, log))
    kept = debounce_stream(changes)

    def run():
        q = (
            kept.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination()

    run()
    write_log(log, "b.json", [("created", "/w/1.json", None, ms) for ms in (600, 1050, 1100)]
              + [("modified", "/w/1.json", None, 700)])
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select("debounce_type", F.unix_millis("ts").alias("ms")).collect()
    base = int(START.timestamp() * 1000)
    assert sorted((r.debounce_type, r.ms - base) for r in got) == [
        ("created", 0), ("created", 600), ("created", 1100), ("modified", 700)
    ]


def test_watch(spark, tmp_path):
    files, log = str(tmp_path / "items"), str(tmp_path / "log")
    one = put(files, "1.json", full(1))
    two = put(files, "2.json", full(2))
    bad = put(files, "3.json", "{not valid")
    big = put(files, "4.json", json.dumps(full(4)) + " " * 51200)
    store = IndexStore(spark, str(tmp_path / "store"))
    write_log(log, "a.json", [("created", p, None, i) for i, p in enumerate([one, two, bad, big, files + "/gone.json"])])
    seen = []

    def run():
        stream = watch(read_change_log(spark, log), store, ENCODERS, str(tmp_path / "cp"),
                       on_batch=lambda n, version: seen.append((n, version)))
        stream.trigger(availableNow=True).start().awaitTermination()

    def keys():
        return {r.item_key: r.name for r in store.read().collect()}

    run()
    assert keys() == {1: "Item 1", 2: "Item 2"}
    put(files, "2.json", full(2, name="edited"))
    five = put(files, "5.json", full(5))
    six = put(files, "6.json", full(6))
    write_log(log, "b.json", [
        ("modified", two, None, 5000), ("deleted", one, None, 5001), ("moved", "/elsewhere/5.json", five, 5002),
        ("created", six, None, 5003), ("deleted", six, None, 5004), ("deleted", files + "/77.json", None, 5005),
        ("deleted", files + "/abc.json", None, 5006), ("moved", two, "/archive/2", 5007),
    ])
    run()
    assert keys() == {2: "edited", 5: "Item 5"}
    versions = os.listdir(tmp_path / "store")
    run()
    assert sorted(os.listdir(tmp_path / "store")) == sorted(versions)
    assert len({n for n, _ in seen}) == len(seen)


def test_late_events_are_applied(spark, tmp_path):
    files, log = str(tmp_path / "items"), str(tmp_path / "log")
    store = IndexStore(spark, str(tmp_path / "store"))
    for n, second in enumerate((0, 60, 61, 30, 62), 1):
        write_log(log, f"{n}.json", [("created", put(files, f"{n}.json", full(n)), None, 1000 * second)])
        watch(read_change_log(spark, log), store, ENCODERS, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.item_key for r in store.read().collect()) == [1, 2, 3, 4, 5]


def test_failures_are_listed_and_encoders_tried_again(spark, tmp_path):
    files, log, switch = str(tmp_path / "items"), str(tmp_path / "log"), tmp_path / "up"
    where = str(switch)

    class Sometimes(HashedTrigramEncoder):
        def load(self):
            encode = HashedTrigramEncoder.load(self)

            def sometimes(texts):
                if any("item 2" in " ".join(t.split()).lower() for t in texts) and not os.path.exists(where):
                    raise RuntimeError("down")
                return encode(texts)

            return sometimes

    store = IndexStore(spark, str(tmp_path / "store"))
    paths = [put(files, "1.json", full(1)), put(files, "2.json", full(2)), put(files, "3.json", "{not valid"),
             put(files, "4.json", json.dumps(full(4)) + " " * 51200), files + "/gone.json", put(files, "5.json", {"name": "x"})]

    def run(name, wanted):
        write_log(log, name, [("created", p, None, i) for i, p in enumerate(wanted)])
        stream = watch(read_change_log(spark, log), store, {"embedding_local": Sometimes(8)}, str(tmp_path / "cp"))
        stream.trigger(availableNow=True).start().awaitTermination()
        listed = {(os.path.basename(r.path), r.reason) for r in read_failures(spark, store).collect()}
        return listed, {os.path.basename(r.path) for r in open_failures(spark, store, 1 << 40).collect()}

    listed = {
        ("2.json", "encoder"), ("3.json", "unreadable"), ("4.json", "too large"), ("gone.json", "missing"), ("5.json", "no key")}
    assert run("a.json", paths) == (listed, {"2.json"})
    assert [r.item_key for r in store.read().collect()] == [1]
    assert run("b.json", [put(files, "6.json", full(6))]) == (listed, {"2.json"})
    switch.write_text("")
    assert run("c.json", [put(files, "7.json", full(7))]) == (listed, set())
    assert sorted(r.item_key for r in store.read().collect()) == [1, 2, 6, 7]


def test_no_batch_is_lost_after_or_between_ingests(spark, tmp_path):
    """Jobs and streams number their batches apart: each stream batch counts, whatever was written before or between."""
    files, log = str(tmp_path / "items"), str(tmp_path / "log")
    store = IndexStore(spark, str(tmp_path / "store"))
    put(files, "1.json", full(1))
    ingest(spark, files, store, ENCODERS)
    for n, checkpoint in enumerate(("cp", "cp", "other", "cp"), 2):
        write_log(log, f"{n}.json", [("created", put(files, f"{n}.json", full(n)), None, n)])
        watch(read_change_log(spark, log), store, ENCODERS, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.item_key for r in store.read().collect()) == [*range(1, n + 1)]
        put(files, "1.json", full(1, name=f"edit {n}"))
        ingest(spark, files, store, ENCODERS)
    assert {r.item_key: r.name for r in store.read().collect()}[1] == "edit 5"
    changes = spark.createDataFrame([("delete", files + "/3.json", START)], "op string, path string, ts timestamp")
    assert apply_changes(spark, changes, store, ENCODERS, 0)
    assert apply_changes(spark, changes, store, ENCODERS, 0) is None
    assert sorted(r.item_key for r in store.read().collect()) == [1, 2, 4, 5]


def test_state_outlives_the_window(spark):
    events = spark.createDataFrame([("created", "/w/1.json", None, False, START)], CHANGE_SCHEMA)
    with pytest.raises(ValueError):
        debounce_stream(normalize_events(events), window_ms=20_000, ttl_ms=10_000)


def test_batches_are_debounced_by_a_table(spark, tmp_path):
    folder, schema = str(tmp_path / "held"), "op string, path string, debounce_type string, ts timestamp"

    def kept(batch_id, now_ms, *events):
        rows = [(op, f"/w/{n}.json", kind, None if ms is None else at(ms)) for op, n, kind, ms in events]
        got = debounce_batch(spark.createDataFrame(rows, schema), folder, batch_id, 500, 10_000, now_ms).collect()
        return sorted((r.op, r.path[3], r.ts and int((r.ts.replace(tzinfo=timezone.utc) - START).total_seconds() * 1000)) for r in got)

    first = [("upsert", 1, "created", ms) for ms in (300, 0, 0, 1200)] + [("upsert", 1, "modified", 200), ("upsert", 2, "created", 0)]
    assert kept(0, 0, *first) == [("upsert", "1", 0), ("upsert", "1", 200), ("upsert", "1", 1200), ("upsert", "2", 0)]
    second = [("upsert", 1, "created", 1500), ("upsert", 1, "created", 1700), ("delete", 1, None, 1500), ("upsert", 3, "created", 5)]
    want = [("delete", "1", 1500), ("upsert", "1", 1700), ("upsert", "3", 5)]
    assert kept(1, 5000, *second) == want
    # Repeated, the batch starts from what the one before it left.
    assert kept(1, 5000, *second) == want
    # What batch 0 kept last has expired by now, what batch 1 kept has not.
    assert kept(2, 11_000, ("upsert", 9, "created", 0)) == [("upsert", "9", 0)]
    assert kept(3, 11_000, ("upsert", 2, "created", 1), ("upsert", 1, "created", 1701)) == [("upsert", "2", 1)]
    assert kept(4, 11_000, ("upsert", 4, "created", None)) == [("upsert", "4", None)]
    assert sorted(n for n in os.listdir(folder) if n.startswith("batch=")) == ["batch=3", "batch=4"]


def test_watch_keeps_no_state_key_by_key(spark, tmp_path):
    log, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    one = put(str(tmp_path / "items"), "1.json", full(1))
    write_log(log, "a.json", [("created", one, None, 0), ("created", one, None, 100)])
    store = IndexStore(spark, str(tmp_path / "store"))
    watch(read_change_log(spark, log), store, ENCODERS, cp).trigger(availableNow=True).start().awaitTermination()
    assert [r.item_key for r in store.read().collect()] == [1]
    assert "state" not in os.listdir(cp) and spark.read.parquet(f"{cp}/held").count() == 1
