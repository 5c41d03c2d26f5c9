"""Notices of under five words."""

import re

from fathomline.llm.license_scan import NOTICES, SHORT_NOTICES, bands_for, scan_licenses, window_length


def test_short_notices(spark):
    rows = [(1, "a b All rights\nreserved. c, all RIGHTS reserved"), (2, "all rights are reserved"), (3, "all rights"), (4, None),
            (None, "(All rights reserved.)"), (6, "Released under the MIT License. All rights reserved."), (7, "ends with foo"), (7, "foo")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in scan_licenses(docs, NOTICES | SHORT_NOTICES | {"foo": "Foo!", "none": "..."}).collect()}
    line = "all-rights-reserved-line"
    assert got == {(1, line, 1.0, 2, 2), (None, line, 1.0, 0, 1), (6, line, 1.0, 5, 1), (6, "mit-line", 1.0, 0, 1), (7, "foo", 1.0, 0, 2)}


def test_short_line_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in docs.collect() if " all rights reserved " in " " + re.sub(r"[\W_]+", " ", (r.text or "").lower()) + " "}
    got = {r.doc_id for r in scan_licenses(docs, NOTICES | SHORT_NOTICES).where("license = 'all-rights-reserved-line'").collect()}
    assert got == want and len(want) >= 7


def test_a_window_that_just_holds_enough_is_not_missed():
    for n in range(5, 400):
        notice, window = n - 4, window_length(n) - 4
        assert (1 - 0.8 * notice / (window + 0.2 * notice)) ** bands_for(n) <= 1e-6
