"""Each operator against brute force on small tables with nulls, ties, copies, empty and long texts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import mixing, packing, pivot_search, sharding, simhash, subspace_join, suffix_dedup, toxicity, warc
from fathomline.llm.common import merge_labels
from fathomline.llm.components import components
from fathomline.llm.license_scan import bands_for, scan_licenses, window_length
from fathomline.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, source string, shard string, range_id int, __mix_odd int"


def words(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in draw.integers(0, 4000, n))


PASSAGE = words(99, 60)
ROWS = [
    (1, words(1, 300), "a"), (2, words(1, 300), "a"), (3, words(1, 299) + " other", "b"), (4, words(4, 40) + " " + PASSAGE, None),
    (5, PASSAGE + "\n" + words(5, 30), "b"), (6, "", "c"), (7, None, "c"), (8, "  one\ttwo  ", "a"), (9, words(9, 12000), "a"),
    (None, words(10, 80), "b"), (11, words(11, 80), None), (11, words(11, 80), None), (12, "Ünïcode  wörds <|endoftext|> x", "d"),
    (13, "line " * 400, "a"), (14, words(14, 49), "a"), (15, words(14, 49), "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_words(text):
    return (text or "").encode().lower().split()


def test_shards(docs, none):
    got = sharding.shard_by_ranges(docs, shards=4).collect()
    assert Counter(r.size for r in got) == Counter(len((t or "").encode()) + 8 for _, t, _ in ROWS)
    assert {(r.doc_id, r.text_crc32) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t, _ in ROWS}
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for shard in {r.shard for r in got}:
        mine = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 4) <= largest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sharding.shard_by_ranges(none).count() == 0


def test_a_text_all_rows_share_is_split(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    held = sharding.shard_by_ranges(copies, shards=6).groupBy("shard").count().collect()
    assert len(held) == 6 and max(r[1] for r in held) - min(r[1] for r in held) <= 2


def water_fill(sizes, weights, total):
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    while open_:
        left = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: weights[s] * left / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixture(docs, none):
    got = mixing.mixed_plan(docs).collect()
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len(by_words(text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = water_fill(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in want.values()}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        taken[round(r.target, 6)] += r.taken
    assert all(abs(t - k) <= 1 for t, k in taken.items() if t > 0)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed_plan(docs).collect()), key=repr)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    assert sum(len(by_words(r.text)) for r in mix.collect()) == sum(r.taken for r in got)
    assert mixing.mixed_plan(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_licenses(spark, none):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"{words(1, 50)} {line} {words(2, 50)}"), (2, line), (3, "Licensed under the Apache"), (4, None), (5, ""),
            (6, f"{line} {words(3, 30)} {line}"), (6, "Released under the MIT License."), (None, line), (7, words(7, 3000) + " " + line)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {
        (i, "apache-2.0-line") for i in (1, 2, 6, None, 7)} | {(6, "mit-line")}
    assert all(r.containment == 1 for r in got)
    assert scan_licenses(none).count() == 0 and scan_licenses(none, {}).count() == 0


def test_bands_make_a_miss_unlikely():
    for n in range(5, 200):
        alike = (n - 4) / (window_length(n) - 4)
        assert (1 - 0.8 * alike) ** bands_for(n) <= 1e-6


def test_warc(spark, tmp_path):
    long = "x" * 1500
    rows = [(1, "http://a", long), (2, "http://b\r\nc", long), (3, None, long), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (None, "u", long), (8, "ü", "é" * 5000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string")
    got = {r.page_id: r for r in warc.archived_pages(pages, str(tmp_path / "w")).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        i: ("revisit", 3) if i in (1, 2, None) else ("response", None) for i, _, _ in rows}
    assert {i: r.payload_bytes for i, r in got.items()} == {i: len((h or "").encode()) for i, _, h in rows}
    head = warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("warc_type = 'response' and payload_length > 2000")
    assert [(r.record_id, r.payload) for r in head.collect()] == [("urn:page:8", None)]
    empty = warc.archived_pages(pages.where("false"), str(tmp_path / "none"))
    assert empty.count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(tmp_path, spark, packed):
    import gzip

    records = [warc.record({"warc_type": k, "record_id": f"urn:page:{i}", "payload": bytes([65 + i]) * n, "payload_length": n})
               for i, (k, n) in enumerate([("response", 70_000), ("metadata", 0), ("response", 3)])]
    name = "a.warc.gz" if packed else "a.warc"
    (tmp_path / name).write_bytes(b"".join(gzip.compress(r) if packed else r for r in records))
    got = warc.read_warc(spark, str(tmp_path)).where("warc_type = 'response'").collect()
    assert [len(r.payload) for r in got] == [70_000, 3]


def test_packing_keeps_the_units_it_knows(monkeypatch):
    monkeypatch.setattr(packing, "UNITS", 4)
    encoder, asked = packing.Encoder(vocabulary()), []
    encode = packing.Encoder.ids_whole
    monkeypatch.setattr(packing.Encoder, "ids_whole", lambda self, texts: asked.extend(texts) or encode(self, texts))
    encoder.fast = None
    import pyarrow as pa

    first, second = "a b c", "a b d e c d"
    for text in (first, second, second):
        ids, bounds = encoder.encode(pa.array([text, None]))
        assert ids.tolist() == encode(encoder, [text])[0] and bounds.tolist() == [0, len(ids), len(ids)]
    assert asked == ["a", " b", " c", "", " d", " e", " d", " e"]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(vocabulary())
    got = packing.pack_documents(docs, vocabulary(), with_ids=True).collect()
    ids = {}
    for doc_id, text, _ in ROWS:
        ids.setdefault(doc_id, known.encode(text or "", add_special_tokens=False).ids + [0])
    for r in got:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(piece.tobytes()) == r.ids_crc32
        assert np.frombuffer(r.ids, "<u2").tolist() == piece.tolist()
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _, _ in ROWS)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert packing.pack_documents(none, vocabulary()).count() == 0


def test_units_encode_as_whole_texts():
    import pyarrow as pa

    encoder = packing.Encoder(vocabulary())
    texts = ["a b", " a", "a  b", "a \n b", "it's 12 x9  y", "", "é ñ\tz ", "\n\nA", "a<|endoftext|> b", "x  y", None]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == encoder.ids_whole([text or ""])[0]


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    cells = np.stack([g.ravel() for g in np.meshgrid(side, side, side)], axis=1)
    keys = packing.hilbert_key(cells, bits=4)
    assert sorted(keys) == list(range(16**3))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_forward_backward_is_enumeration():
    import itertools

    draw = np.random.default_rng(3)
    moves, begin, bounds = np.exp(draw.normal(size=(2, 2))), 0.7, np.array([0, 1, 5, 8])
    e = draw.normal(size=8)
    logits = toxicity.forward_backward(e, bounds, begin, moves)[2]
    for a, b in zip(bounds, bounds[1:]):
        mass = np.zeros((b - a, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(begin * states[0] + sum(e[a + i] * s for i, s in enumerate(states)))
            weight *= np.prod([moves[x, y] for x, y in zip(states, states[1:])])
            for i, s in enumerate(states):
                mass[i, s] += weight
        assert np.allclose(logits[a:b], np.log(mass[:, 1] / mass[:, 0]))


def test_toxicity_finds_stems_and_spans(spark, docs, none):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(600):
        text = words(1000 + i, int(draw.integers(5, 60))).split()
        toxic = i % 5 == 0
        if toxic:
            text[int(draw.integers(0, len(text)))] = "vilest" + "abcdefgh"[int(draw.integers(0, 8))] + "!"
        rows.append((i, " ".join(text), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(frame, frame.where("doc_id < 450").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score_documents(frame, model).collect()}
    held = [r for r in rows if r[0] >= 450]
    assert np.mean([(got[i].score >= 0.3) == bool(t) for i, _, t in held]) > 0.97
    for i, text, toxic in held:
        for span in got[i].spans:
            assert text[span.begin:span.end].startswith("vilest")
    kept = toxicity.score_documents(docs, model, keep=0.3)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.score_documents(none, model).count() == 0
    blank = toxicity.learn(frame, frame.where("false").select("doc_id", "toxic"))
    assert {r.score < 0.3 for r in toxicity.score_documents(docs, blank).collect()} == {True}


def fingerprint(text):
    w = by_words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    got = simhash.simhash_groups(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{fingerprint(t):016x}") for i, t, _ in ROWS)
    groups = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert groups[2] == 1 and groups[7] == 6 and groups[15] == 14 and groups[11] == 11 and groups[9] == 9
    assert simhash.simhash_groups(none).count() == 0


def test_links_of_fingerprints(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    prints = [b for b in base] + [b ^ np.uint64(sum(1 << int(x) for x in draw.choice(64, k, replace=False)))
                                  for b in base for k in (1, 2, 3, 4, 5)]
    prints = np.unique(np.array(prints, np.uint64))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = merge_labels(*np.nonzero(near), len(prints))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint bigint")
    for rows in (50_000, 7):  # one tree per block, and shards split into parts
        roots = {r.node: r.root for r in components(simhash.near_links(frame, tree_rows=rows)).collect()}
        found = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
        assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def brute_passages(rows):
    first, seen, out = {}, {}, set()
    for doc_id, text in sorted((i, t) for i, t, _ in rows if i is not None and t is not None):
        w = by_words(text)
        if text in seen:
            if len(w) >= 50 and seen[text] != doc_id:
                out.add((doc_id, 0, len(w), seen[text], 0))
            continue
        seen[text] = doc_id
        runs = {}
        for p in range(len(w) - 49):
            key = tuple(w[p:p + 50])
            if key in first:
                runs.setdefault((first[key][0], p - first[key][1]), []).append(p)
            else:
                first[key] = (doc_id, p)
        for (other, shift), places in runs.items():
            for run in np.split(np.array(places), np.flatnonzero(np.diff(places) != 1) + 1):
                out.add((doc_id, int(run[0]), len(run) + 49, other, int(run[0]) - shift))
    return out


def test_passages(docs, none):
    found = suffix_dedup.repeated_passages(docs)
    assert {tuple(r) for r in found.collect()} == brute_passages(ROWS)
    left = suffix_dedup.without_repeats(docs, found)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == docs.columns and 2 not in texts and texts[4] == ROWS[3][1] and texts[1] == ROWS[0][1]
    assert by_words(texts[5]) == by_words(words(5, 30)) and texts[3] == "other" and texts[6] == "" and texts[7] is None
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_cut_words():
    assert suffix_dedup.cut_words(" a b  c\nd e", [(1, 2)]) == " a d e"
    assert suffix_dedup.cut_words("a b", [(0, 2)]) == "" and suffix_dedup.cut_words("a b c", [(1, 2)]) == "a"


def vectors(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(60, 24))
    rows = [v for v in base] + [v + draw.normal(size=24) * s for v in base[:20] for s in (0.01, 0.05, 0.25, 0.3)] + [base[0] * 2, base[0]]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None]), (None, data[1][1]), (904, []), (905, [1.0, 2.0])]
    return data, odd, spark.createDataFrame([(*r, 1, "x") for r in data + odd], "vec_id bigint, embedding array<float>, block int, root string")


def test_near_vectors(spark):
    data, odd, frame = vectors(spark)
    x = np.array([v for _, v in data] + [data[1][1]])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    label = merge_labels(*np.nonzero(near), len(x))
    for leaf in (8192, 16):
        got = {r.vec_id: r for r in subspace_join.near_vectors(frame, leaf_rows=leaf).collect()}
        for i in range(len(data)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
        assert got[None].component_id == label[1] and not got[None].kept
        for i in (900, 901, 902, 903, 904, 905):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert subspace_join.near_vectors(frame.where("false")).count() == 0


def test_topk(spark):
    data, odd, frame = vectors(spark)
    whole = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in data} | {
        901: np.zeros(24, np.int64), 904: np.zeros(24, np.int64), 905: np.array([1024, 2048] + [0] * 22)}
    want = set()
    for q in (i for i in whole if i % 10 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    got = pivot_search.pivot_topk(frame, F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert pivot_search.pivot_topk(frame.where("false"), F.lit(True)).count() == 0


def test_addresses_come_back_unchanged(spark, tmp_path):
    urls = [" http://a b ", "u\n1", "u%0A1", "u\r\nWARC-Type: x", "", None, "http://x/%20y", "\u3000wide\u3000", "tab\tin", "ü%", "  "]
    pages = spark.createDataFrame([(i, u, f"page {i}", "x") for i, u in enumerate(urls)] + [(3, "again", "page 3", "y"), (None, "n", "z", "w")],
                                  "page_id bigint, url string, html string, payload string")
    got = sorted((r.url for r in warc.archived_pages(pages, str(tmp_path / "w")).collect()), key=repr)
    assert got == sorted([*urls, "again", "n"], key=repr)


def test_records_without_a_length(spark, tmp_path):
    blocks = [b"one\r\n\r\nmore", b"", b"x" * 3000]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: %d\r\n\r\n" % i + x + b"\r\n\r\n" for i, x in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(data)
    got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {str(i): x for i, x in enumerate(blocks)}


def test_labels_of_hot_and_missing_ids_stay_bounded(spark):
    """A third of the documents share the id of one label, a third have none: a task learns from one text for each id."""
    docs = spark.createDataFrame(
        [(1, f"vile {i}") for i in range(300)] + [(None, "vile")] * 300 + [(i, "vile words" if i % 2 else "fine words") for i in range(2, 40)],
        "doc_id bigint, text string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 0), (None, 1), (5, None), (7, 0)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect() if r.doc_id}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_mix_of_rows_that_share_an_id(spark):
    """A third of the rows without an id, a third with one: what each source gives is what its target says."""
    rows = [(None, words(i, 5), "a") for i in range(60)] + [(4, words(i, 7), None) for i in range(60)] + [(i, words(i, 3), "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    taken = Counter()
    for r in mixing.mixed_plan(docs).collect():
        taken[r.source_size, round(r.target)] += r.taken
    assert all(n == target for (_, target), n in taken.items()) and len(taken) == 3
    got = Counter(r.source for r in mixing.mixed_documents(docs).collect() for _ in by_words(r.text))
    assert sorted(got.values()) == sorted(taken.values())


def test_whole_licences_and_short_lines(spark):
    from fathomline.llm.license_scan import NOTICES, SHORT_NOTICES

    rows = [(1, "x " * 30 + NOTICES["mit"] + " y" * 40), (2, NOTICES["isc"].lower()), (3, "end. All rights reserved."), (4, None), (5, "")]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), NOTICES | SHORT_NOTICES).collect()}
    assert got == {(1, "mit"), (1, "mit-grant"), (2, "isc"), (2, "isc-grant"), (3, "all-rights-reserved-line")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 5), (200, 201), (7, 7), (300, 300), (201, 200)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(100, 1), (201, 200)}


def test_word_rule():
    assert re.findall(mixing.WORD, "a\x1cb \x0bc d") == ["a\x1cb", "c d"]
