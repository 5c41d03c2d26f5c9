"""License scans: MinHash over overlapping windows retrieves notices, exact containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.functions.binding import let

SHINGLE = 5
CONTAINMENT = 0.8
EMPTY = ("doc_id", "'' license", "0D containment", "0 word_start", "0L n_windows")
MISS = 1e-6  # highest probability that a window holding 0.8 of a notice is not retrieved

# Notices looked for by default: the customary one-line and header forms. Fixed values.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "all-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
}

# Lines of under five words: each is one shingle and is matched whole.
SHORT_NOTICES = {"all-rights-reserved-line": "All rights reserved."}


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """A hash of each run of ``SHINGLE`` words."""
    at = lambda i, k: F.element_at(words, i + k)
    return F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)])
    )).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")
    )).otherwise(F.array().cast("array<string>"))


def bands_for(length: int, miss: float = MISS) -> int:
    """Bands of one row so that a window holding 0.8 of a notice of ``length`` words is missed with at most ``miss``.

    Of T shingles of the notice and W of the window, 0.8 T are in both and
    W + 0.2 T in either: the similarity is 0.8 T / (W + 0.2 T) at least.
    """
    held, window = length - SHINGLE + 1, window_length(length) - SHINGLE + 1
    alike = CONTAINMENT * held / (window + (1 - CONTAINMENT) * held)
    return math.ceil(math.log(miss) / math.log(1 - alike))


def window_step(length: int) -> int:
    return -(-length // 4)


def window_length(length: int) -> int:
    """Windows of this length, ``window_step`` apart, hold every run of ``length`` words whole."""
    return length + window_step(length) - 1


def _band(shingles: Column, band: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band)))


def templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """(license, length, step, span, bands, shingle hashes and texts) of the notices of at least five words."""
    pairs = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in notices.items()])
    rows = spark.range(1).select(F.inline(pairs)).withColumn("words", words_of(F.col("notice")))
    rows = rows.withColumn("length", F.size("words")).where(F.col("length") >= SHINGLE)
    lengths = [r[0] for r in rows.select("length").distinct().collect()] or [SHINGLE]
    settings = F.array(*[
        F.struct(F.lit(n).alias("length"), F.lit(window_step(n)).alias("step"), F.lit(window_length(n)).alias("span"),
                 F.lit(bands_for(n)).alias("bands")) for n in lengths
    ])
    return rows.join(F.broadcast(spark.range(1).select(F.inline(settings))), "length").select(
        "license", "length", "step", "span", "bands", F.array_distinct(shingle_hashes(F.col("words"))).alias("hashes"),
        F.array_distinct(shingle_texts(F.col("words"))).alias("shingles"),
    )


def _scan_short(docs: DataFrame, notices: dict[str, str]) -> DataFrame:
    """As ``scan_licenses``, for notices of one to four words: each is a single shingle, and its windows are the places it stands at."""
    pairs = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in notices.items()])
    known = docs.sparkSession.range(1).select(F.inline(pairs)).withColumn("words", words_of(F.col("notice"))).where(
        F.size("words").between(1, SHINGLE - 1)
    ).select("license", "words").collect()
    if not known:
        return docs.selectExpr(*EMPTY).where("false")
    begins = sorted({r.words[0] for r in known})

    def spots(words: Column) -> Column:
        at = F.transform(words, lambda w, i: F.when(w.isin(begins), F.struct(
            i.alias("at"), F.slice(words, i + 1, F.lit(SHINGLE - 1)).alias("run")
        )))
        return F.filter(at, lambda s: s.isNotNull())

    hits = docs.select("doc_id", F.explode_outer(let(words_of(F.col("text")), spots)).alias("hit")).where("hit is not null")
    held = F.array(*[
        F.when(F.slice("hit.run", 1, len(r.words)) == F.array(*map(F.lit, r.words)), F.lit(r.license)) for r in known
    ])
    found = hits.select("doc_id", "hit.at", F.explode(F.array_compact(held)).alias("license"))
    return found.groupBy("doc_id", "license").agg(
        F.lit(1.0).alias("containment"), F.min("at").cast("int").alias("word_start"), F.countDistinct("at").alias("n_windows")
    )


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """The notices that ``docs`` (doc_id, text) hold: one row per document and notice.

    A text is seen through windows a little longer than the notice, a quarter
    of its length apart. A window retrieves a notice if the smallest hash of its
    shingles under some band's permutation is the notice's. Such a smallest hash
    belongs to one shingle of the notice, so only windows that hold one of these
    shingles are looked at; the outcome is that of comparing all windows. A
    retrieved notice counts if the window holds at least 0.8 of its distinct
    five-word shingles, compared as text.

    ``notices`` is a bounded parameter and is sent to every task. All else is
    one pass over the texts; only the few rows found are shuffled.

    Defined results: null, empty and short texts hold nothing; rows with the
    same doc_id, null included, count as one document; a notice of under five
    words is one shingle and has to stand whole, one without words is not looked
    for; other columns are not looked at. Short notices take a pass of their own.
    Returns doc_id, license, containment (best window), word_start (first such window), n_windows.
    """
    notices = NOTICES if notices is None else notices
    if not notices:
        return docs.selectExpr(*EMPTY).where("false")
    return _scan_long(docs, notices).unionByName(_scan_short(docs, notices))


def _scan_long(docs: DataFrame, notices: dict[str, str]) -> DataFrame:
    """``scan_licenses`` for notices of at least five words."""
    known = templates(docs.sparkSession, notices)
    # (shingle hash, notice, band): a few rows per notice.
    stars = known.select("*", F.explode(F.sequence(F.lit(1), F.col("bands"))).alias("band")).withColumn(
        "star", F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.col("band")).alias("least"), h.alias("hash"))))
    ).select("license", "length", "step", "span", "shingles", "band", F.col("star.hash").alias("hash"), F.col("star.least").alias("least"))
    listed = [r[0] for r in stars.select("hash").distinct().collect()]
    if not listed:
        return docs.selectExpr(*EMPTY).where("false")
    reach = max(r[0] for r in known.select("span").distinct().collect())

    # Each hit keeps only the words and hashes that a window around it can hold.
    def hit(words: Column, hashes: Column, spot: Column) -> Column:
        base = F.greatest(spot["at"] - reach, F.lit(0))
        keep = lambda c: F.slice(c, base + 1, F.lit(2 * reach + SHINGLE))
        return F.struct(spot["at"].alias("at"), spot["hash"].alias("hash"), base.alias("base"),
                        keep(words).alias("words"), keep(hashes).alias("hashes"))

    def hits_in(words: Column, hashes: Column) -> Column:
        spots = F.transform(hashes, lambda h, i: F.when(h.isin(listed), F.struct(i.alias("at"), h.alias("hash"))))
        return F.transform(F.filter(spots, lambda s: s.isNotNull()), lambda s: hit(words, hashes, s))

    hits = let(words_of(F.col("text")), lambda w: let(shingle_hashes(w), lambda h: hits_in(w, h)))
    # Outer, so that no filter on the hits is derived that would compute them twice.
    found = docs.select("doc_id", F.explode_outer(hits).alias("hit")).where("hit is not null").select(
        "doc_id", "hit.*"
    ).join(F.broadcast(stars), "hash")
    first = F.greatest(F.ceil((F.col("at") + SHINGLE - F.col("span")) / F.col("step")), F.lit(0)).cast("int")
    last = F.floor(F.col("at") / F.col("step")).cast("int")
    windows = found.select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias("k")).withColumn(
        "start", F.col("k") * F.col("step")
    ).withColumn("offset", F.col("start") - F.col("base"))
    shingles = lambda c, less: F.slice(c, F.col("offset") + 1, F.col("span") - less)
    retrieved = windows.where(
        _band(shingles("hashes", SHINGLE - 1), F.col("band")) == F.col("least")
    ).withColumn("window_words", shingles("words", 0)).dropDuplicates(["doc_id", "license", "start", "window_words"])
    held = F.size(F.array_intersect(shingle_texts(F.col("window_words")), "shingles")) / F.size("shingles")
    matched = retrieved.select("doc_id", "license", "start", held.alias("held")).where(F.col("held") >= CONTAINMENT)
    best = F.max(F.struct(F.col("held"), (-F.col("start")).alias("back")))
    return matched.groupBy("doc_id", "license").agg(best.alias("best"), F.countDistinct("start").alias("n_windows")).select(
        "doc_id", "license", F.col("best.held").alias("containment"), (-F.col("best.back")).cast("int").alias("word_start"), "n_windows"
    )
