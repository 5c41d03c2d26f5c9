"""A directory followed by listings: differences, restarts, listings that were not finished."""

import os
import tracemalloc

import pytest

from fathomline.operators.encode import HashedTrigramEncoder
from fathomline.sources.directory_stream import DirectoryReader, ListingWriter, changes_between, read_directory_changes, read_listing
from fathomline.sources.index_table import IndexStore
from fathomline.streaming.watch import watch
from test_sources import full, put


def test_differences():
    before, after = {"a": (5, 1), "b": (5, 1), "c": (5, 1), "e": (9, 1)}, {"b": (6, 1), "c": (5, 2), "d": (3, 1), "e": (9, 1)}
    assert sorted(changes_between(before, after, 50)) == [
        ("created", "d", 3), ("deleted", "a", 50), ("modified", "b", 6), ("modified", "c", 6)
    ]
    assert list(changes_between({}, {}, 1)) == []


@pytest.fixture()
def reader(tmp_path):
    return DirectoryReader({"path": str(tmp_path / "files"), "state": str(tmp_path / "state"), "buckets": "3"})


def events(reader, start, end):
    return sorted((r["event_type"], os.path.basename(r["src_path"])) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist())


def test_listings(reader, tmp_path):
    first = reader.latestOffset()
    assert events(reader, reader.initialOffset(), first) == []
    for i in range(9):
        put(str(tmp_path / "files"), f"{i}.json", full(i))
    os.makedirs(tmp_path / "files" / "nested")
    second = reader.latestOffset()
    assert reader.latestOffset() == second  # nothing changed: the same listing
    assert events(reader, first, second) == [("created", f"{i}.json") for i in range(9)]
    os.remove(tmp_path / "files" / "3.json")
    put(str(tmp_path / "files"), "4.json", full(4, name="edited"))
    # A listing that was not finished is not seen, and a new reader goes on where the last one was.
    os.makedirs(tmp_path / "state" / "broken")
    third = DirectoryReader({"path": str(tmp_path / "files"), "state": str(tmp_path / "state"), "buckets": "3"}).latestOffset()
    assert third["listing"] == second["listing"] + 1
    assert events(reader, second, third) == [("deleted", "3.json"), ("modified", "4.json")]
    reader.commit(third)
    assert events(reader, third, third) == []
    assert sorted(os.listdir(tmp_path / "state")) == sorted(["broken", third["folder"], f"listing-{third['listing']:012d}"])


def test_directory_into_index(spark, tmp_path):
    files, store = str(tmp_path / "files"), IndexStore(spark, str(tmp_path / "store"))

    def follow():
        stream = watch(read_directory_changes(spark, files, str(tmp_path / "listings"), 4), store,
                       {"embedding_local": HashedTrigramEncoder(8)}, str(tmp_path / "cp"), window_ms=None)
        stream.trigger(availableNow=True).start().awaitTermination()
        return {r.item_key: r.name for r in store.read().collect()}

    for i in (1, 2, 3):
        put(files, f"{i}.json", full(i))
    put(files, ".4.json", full(4))
    put(files, "notes.txt", "x")
    assert follow() == {1: "Item 1", 2: "Item 2", 3: "Item 3"}
    put(files, "2.json", full(2, name="edited"))
    os.remove(files + "/1.json")
    assert follow() == {2: "edited", 3: "Item 3"}
    assert follow() == {2: "edited", 3: "Item 3"}


def test_a_listing_is_not_held(tmp_path):
    """What a listing holds does not grow with the directory, and files that were met in another order are the same listing."""
    files, state = str(tmp_path / "files"), str(tmp_path / "state")
    os.makedirs(files)
    for i in range(30_000):
        os.close(os.open(f"{files}/{i}.json", os.O_CREAT | os.O_WRONLY))
    reader = DirectoryReader({"path": files, "state": state, "buckets": "4"})
    tracemalloc.start()
    first = reader.latestOffset()
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 150 bytes a file are less than its line.
    assert held < 30_000 * 150
    assert len(events(reader, reader.initialOffset(), first)) == 30_000
    met = list(reader._files())
    reader._files = lambda: reversed(met)
    assert reader.latestOffset() == first
    assert sorted(os.listdir(state)) == sorted([first["folder"], f"listing-{first['listing']:012d}"])
    reader._files = lambda: met[1:]
    second = reader.latestOffset()
    assert events(reader, first, second) == [("deleted", os.path.basename(met[0][0]))]


def test_lines_are_written_as_they_come(tmp_path):
    listing = ListingWriter(str(tmp_path / "state"), 2, most=3)
    for i in range(8):
        listing.add(f"/f/{i}\u2028.json", i, 1)
        assert listing.held < 3
    folder = tmp_path / "state" / listing.keep()
    assert read_listing(str(folder / "0")) | read_listing(str(folder / "1")) == {f"/f/{i}\u2028.json": (i, 1) for i in range(8)}
