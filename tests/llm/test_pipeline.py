"""The pipeline's stages against what brute force makes of each stage's own input."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import mixing, queries, simhash, suffix_dedup
from fathomline.llm.common import merge_labels
from test_operators import brute_passages, by_words, fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage makes of the one before."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        out.append((docs, spark.read.parquet(str(folder / name))))
        docs = out[-1][1]
    return out


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:4])


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    kept = {r[0] for r in after.select("doc_id").collect()}
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r[0] for r in before.select("doc_id").collect()} - toxic
    assert kept <= {r[0] for r in before.select("doc_id").collect()}
    assert len(clean - kept) <= 0.05 * len(clean)


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1][0].collect())
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    label = merge_labels(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.RADIUS), len(rows))
    assert sorted(r.doc_id for r in stages[1][1].collect()) == [rows[i][0] for i in range(len(rows)) if label[i] == i]


def test_repeated_words_go(stages):
    rows = [(r.doc_id, r.text, None) for r in stages[2][0].collect()]
    gone = {}
    for doc_id, start, n, _, _ in brute_passages(rows):
        gone.setdefault(doc_id, []).append((start, n))
    want = {i: suffix_dedup.cut_words(t, gone[i]) if i in gone else t for i, t, _ in rows}
    assert {r.doc_id: r.text for r in stages[2][1].collect()} == {i: t for i, t in want.items() if t or i not in gone}


def test_the_mix_is_what_was_planned(stages):
    plan = {r.doc_id: r.taken for r in mixing.mixed_plan(stages[3][0]).collect()}
    held = dict.fromkeys(plan, 0)
    for r in stages[3][1].collect():
        held[r.doc_id] += len(by_words(r.text))
    assert held == plan


def test_all_tokens_are_packed(stages):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.vocabulary())
    want = sum(len(known.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4][0].collect())
    assert sum(r.length for r in stages[4][1].collect()) == want


def test_rows_without_ids_and_repeated_rows(spark):
    text = "a b c d e f"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "quite another text it is"), (None, None), (3, None), (None, text)]
    docs = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "doc_id bigint, text string, fingerprint string, component_id int, __row string")
    kept = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    # Rows without an id come last, so exact copies of them go; each row is judged by its own text.
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, text), (3, None)]
    assert [r.text for r in kept.collect() if not r.doc_id] == ["quite another text it is"]


def test_no_stage_needs_rows(spark, tmp_path):
    """Empty tables with extra columns, one stage after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false").withColumn("score", F.lit(1)).withColumn("size", F.lit("x"))
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_columns_that_clash_stay(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumns(
        {c: F.lit(c) for c in ("score", "size", "__row", "fingerprint", "target", "start_word", "spans")}
    )
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert docs.where("score != 'score' or size != 'size' or spans != 'spans'").count() == 0
    assert corpus_pipeline.packed(spark, docs, SF).count() > 0


def test_run_needs_nothing_else(spark, tmp_path):
    shutil.copy(f"{SF}/documents.parquet", tmp_path / "documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
