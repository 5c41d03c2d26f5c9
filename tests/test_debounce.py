import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest

from fathomline.operators.debounce import Tables, debounce

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def table(spark, events):
    rows = [(n, key, START + timedelta(microseconds=us)) for n, (key, us) in enumerate(events)]
    return spark.createDataFrame(rows, "id bigint, key string, ts timestamp").repartition(3)


def walk(events, window):
    last, kept = {}, []
    for us, n, key in sorted((us, n, key) for n, (key, us) in enumerate(events)):
        if key not in last or us - last[key] >= window:
            last[key] = us
            kept.append(n)
    return sorted(kept)


def run(spark, events, window, stretch, fan=64):
    return sorted(r.id for r in debounce(table(spark, events), ["key"], "ts", window, "id", stretch, fan).collect())


def test_fixture(spark):
    events = [("a", ms * 1000) for ms in (0, 300, 600, 1050, 1100)]
    assert run(spark, events, 500_000, 1024) == [0, 2, 4]


@pytest.mark.parametrize("stretch", [1, 2, 3, 50])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_walk(spark, stretch, seed):
    r = random.Random(seed)
    # One key holds a third of the events, close together; others have long gaps.
    events = [("hot", r.randint(0, 4000)) for _ in range(500)]
    events += [(r.choice("abc"), r.choice([r.randint(-500, 500), r.randint(0, 10**6)])) for _ in range(700)]
    events += [(None, r.randint(0, 300)) for _ in range(20)]
    r.shuffle(events)
    for window, fan in ((1, 64), (7, 7), (40, 2), (1000, 3)):
        assert run(spark, events, window, stretch, fan) == walk(events, window)


def test_batches_that_cut_a_stretch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(5)
        events = [(r.choice("xy"), r.randint(0, 2000)) for _ in range(400)]
        assert run(spark, events, 11, 20) == walk(events, 11)
        assert run(spark, events, 11, 1000) == walk(events, 11)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert run(spark, [("a", 0)], 5, 4) == [0]
    assert debounce(table(spark, [("a", 0)]).where("false"), ["key"], "ts", 5, "id").count() == 0


def test_tables_compose():
    """Composed tables say the same as the tables one after the other, whatever comes before."""
    r = random.Random(9)
    for _ in range(200):
        window, span = r.choice((3, 10, 25)), 50
        times = sorted({r.randint(0, 399) for _ in range(r.choice((2, 8, 120)))})
        rows = []
        for part in range(8):
            mine = [t for t in times if t // span == part]
            for at, t in enumerate(mine):
                last = t
                for later in mine[at:]:
                    last = later if later >= last + window else last
                rows.append(("k", 0, part, t, last))
        held = Tables(pd.DataFrame(rows, columns=["__key", "__node", "__part", "entry", "leave"]), window)
        at, leaves = held.composed(np.array([0]))
        for before in range(-2 * window, 0):
            last = np.array([before])
            for _, tables in held.nodes():
                for part in tables:
                    last = held.after(last, part)
            met = np.searchsorted(held.entry[at], before + window)
            assert last[0] == (leaves[met] if met < len(at) else before)


def test_one_key_in_many_tasks(spark):
    """All events on one key: nodes of it are composed in tasks of their own, and none holds the key."""
    events = [("hot", 7 * i) for i in range(4000)]
    assert run(spark, events, 20, 2, 4) == walk(events, 20)
