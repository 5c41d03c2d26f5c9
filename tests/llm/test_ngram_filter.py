"""Scores under the filter against exact counts, on both of its ways to the texts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ngram_filter as lm

SCHEMA = "doc_id bigint, text string, held boolean, score double, tokens string"


def brute(rows, approximate=True):
    """Rows of (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), with counts as exact as levels are."""
    token_rows = [(i, zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    ones, twos, docs = Counter(), Counter(), 0
    for _, held, words in token_rows:
        if not held:
            docs += 1
            ones.update(words)
            twos.update(zip([b" ", *words], words))
    total, known = sum(ones.values()), len(ones)
    fans = Counter(a for a, _ in twos)
    near = lambda c: float(lm.VALUES[lm.level_of(np.array([c]))[0]]) if approximate else c
    out = []
    for i, held, words in token_rows:
        base = [(ones[w] + 0.5) / (total + 0.5 * (known + 1)) for w in words]
        score = 0.0
        for v, w, p in zip([b" ", *words], words, base):
            c = docs if v == b" " else ones[v]
            t = max(near(fans[v]), 1) if c else 1
            score += math.log10((min(near(twos[v, w]), c, ones[w]) + t * p) / (c + t))
        out.append((i, held, len(words), sum(ones[w] > 0 for w in words), total, sum(map(math.log10, base)), score))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(8)
    out = [(i, " ".join(f"W{int(x)}" for x in 3000 * draw.random(draw.integers(1, 200)) ** 3)) for i in range(300)]
    out += [(i + 1000, out[i][1]) for i in range(60)]
    out += [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "the " * 40000), (2004, "the The tHE\x0bthé ÜBER über \x1c x"), (2004, "the end"), (None, "no id"), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, True, 1.0, "x") for r in rows], SCHEMA).repartition(5)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def key(r):
    return r[0] is None, r[0] or 0, r[2], r[5]


@pytest.mark.parametrize("bound", (lm.BROADCAST_BYTES, 0))
@pytest.mark.parametrize("sizes", ((4_000_000, 500_000, 1_000_000), (20_000, 700, 3_000)))
def test_scores(docs, rows, monkeypatch, bound, sizes):
    for name, value in zip(("SLICE_BYTES", "SHARD_WORDS", "SHARD_TOKENS"), sizes):
        monkeypatch.setattr(lm, name, value)
    # So many bits that false positives do not count.
    got = sorted(map(tuple, lm.score_texts(docs, held_out(), bound, 48).collect()), key=key)
    # A level stands for counts up to a fifth away, which is up to 0.1 of a logarithm a token.
    for approximate, slack in ((True, 0.02), (False, 0.1)):
        for a, b in zip(got, sorted(brute(rows, approximate), key=key), strict=True):
            assert a[:5] == b[:5]
            assert a[5] == pytest.approx(b[5], rel=1e-9)
            # Frequent words split over shards are counted in several parts, each with a level of its own.
            assert a[6] == pytest.approx(b[6], abs=slack * b[2] + 0.3)


def test_false_positives_are_few(docs, rows):
    got = sorted(map(tuple, lm.score_texts(docs, held_out()).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert all(a[6] > b[6] - 0.01 * abs(b[6]) for a, b in zip(got, want, strict=True))
    assert sum(a[6] - b[6] for a, b in zip(got, want)) < 0.02 * sum(b[2] for b in want)


def test_both_ways_agree(docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5_000)
    monkeypatch.setattr(lm, "SLICE_BYTES", 30_000)
    sent, asked = (sorted(map(tuple, lm.score_texts(docs, held_out(), b).collect()), key=repr) for b in (1 << 30, 0))
    assert [r[:6] for r in sent] == [r[:6] for r in asked]
    assert [r[6] for r in sent] == pytest.approx([r[6] for r in asked], rel=1e-12)


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = lm.score_texts(docs, held_out()).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (scores[0] - scores[1]) / scores[2] > 0.1


def test_nothing_and_nothing_learned(docs):
    assert lm.score_texts(docs.where("false"), held_out()).count() == 0
    rows = lm.score_texts(docs.where("doc_id < 20"), F.lit(True)).collect()
    assert len(rows) == 20 and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 and r.held_out for r in rows)


def test_levels():
    counts = np.unique(np.concatenate([np.arange(1, 3000), 2 ** np.arange(40)]))
    values = lm.VALUES[lm.level_of(counts)]
    assert (np.abs(values - counts) <= 0.35 * counts).all()
    assert (values[:3] == counts[:3]).all() and lm.VALUES[0] == 0


def test_filter_reads_no_count_too_low():
    draw = np.random.default_rng(1)
    items = np.unique(draw.integers(0, 1 << 63, 200_000, dtype=np.uint64))
    counts = np.maximum(draw.zipf(1.7, len(items)) % 100_000, 1)
    blocks = lm.filled(items, counts)
    at = lambda x: lm.probed(blocks, np.zeros(len(x), np.int64), np.full(len(x), len(blocks)), x)
    found, want = at(items), lm.level_of(counts)
    assert (found >= want).all() and (found > want).mean() < 0.01
    assert (at(draw.integers(0, 1 << 63, 100_000, dtype=np.uint64)) > 0).mean() < 0.01


def test_frequent_words_are_split():
    high = np.arange(10, dtype=np.uint64)
    sharding = lm.Sharding.of(100, 10_000, high, np.array([5000, 100, 99, *[1] * 7]))
    assert sharding.n_parts(np.array([0, 1, 2, 3, 77], np.uint64)).tolist() == [51, 2, 1, 1, 1]
