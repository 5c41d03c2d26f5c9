"""Fill-in-middle against the pattern itself, plain slicing and an exact round trip."""

import hashlib
import re

import numpy as np
import pytest

from fathomline.llm import fill_middle

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")
TEXTS = [
    "", None, "abc", "  ", "a b\nc\x00d", "Ünïcode wörds 𝒳𝒴 and ASCII", "x<P>y", "<S>", "<M", "<<S", "P>", "a" * 5000, "é" * 3000,
    " ".join(f"word{i}, ünd {i * i}!" for i in range(30000)), "line\r\n" * 50, "K ſ K", "İI",
]


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_examples(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id " * 9), (7, "same id"), (7, "same id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, output string")
    got = fill_middle.fill_in_middle(docs.repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0], r[5])
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", (0, 1, 2, 8, 9, 100, 4097))
def test_every_rank_is_found(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    ends = np.concatenate([[0], np.cumsum(widths)])
    units = fill_middle.SkipList(ends[:-1], int(ends[-1]))
    assert [units.chars_before(r) for r in range(n + 1)] == ends.tolist()


def test_descents_are_short():
    units = fill_middle.SkipList(np.arange(200_000), 200_000)
    assert len(units.lanes) >= 6
    # Each lane above has about a quarter of the links, and a descent follows a few of each.
    assert all(len(up[0]) < 0.4 * len(low[0]) for low, up in zip(units.lanes, units.lanes[1:-1]))
    assert units.chars_before(123_456) == 123_456
