"""The pipeline's stages judge rows, not ids."""

import corpus_pipeline
from fathomline.llm.common import ROW, numbered

SCHEMA = "doc_id bigint, text string, source string"


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_numbers_are_in_order_of_ids(spark):
    rows = [(i % 7 if i % 3 else None, words("t", i % 5), "a") for i in range(200)]
    got = numbered(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len({r[ROW] for r in got}) == 200
    ids = [r.doc_id for r in sorted(got, key=lambda r: r[ROW])]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    once = numbered(spark.createDataFrame([(5, "a", "b"), (3, None, "b")], SCHEMA)).collect()
    assert {(r.doc_id, r[ROW]) for r in once} == {(5, 5), (3, 3)}


def test_near_copies_of_rows_that_share_an_id(spark):
    a, b, x, y = (words(n, 60) for n in "abxy")
    rows = [(11, a), (11, b), (20, b.upper()), (3, x + " "), (5, x), (5, y), (11, b), (None, b), (None, words("z", 60))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(11, a), (11, b), (3, x + " "), (5, y), (None, words("z", 60))], key=repr
    )


def test_passages_of_rows_that_share_an_id(spark):
    p, x, z, m, n = (words(k, 60) for k in "pxzmn")
    rows = [(5, f"{p} {x}"), (11, f"{p} {m}"), (11, z), (11, f"{z} {n}"), (None, f"{m} q"), (None, p), (None, "r"), (12, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    left = corpus_pipeline.without_repeated_passages(spark, docs, "")
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    # Of two rows with one id either may count as the first.
    first = [(11, z), (11, n)] if (11, z) in got else [(11, f"{z} {n}")]
    assert sorted(got, key=repr) == sorted([(5, f"{p} {x}"), (11, m), *first, (None, "q"), (None, "r"), (12, None)], key=repr)
