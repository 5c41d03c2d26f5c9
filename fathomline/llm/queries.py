"""The registered queries of this folder and their SQL: each runs one operator over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm.common import table
from fathomline.llm.fill_middle import fill_in_middle
from fathomline.llm.license_scan import NOTICES, SHORT_NOTICES, scan_licenses
from fathomline.llm.mixing import mixed_plan
from fathomline.llm.ngram_filter import score_texts
from fathomline.llm.packing import pack_documents
from fathomline.llm.pivot_search import pivot_topk
from fathomline.llm.prefix_trie import prefix_trie
from fathomline.llm.sharding import shard_by_ranges
from fathomline.llm.simhash import simhash_groups
from fathomline.llm.subspace_join import near_vectors
from fathomline.llm.suffix_dedup import repeated_passages
from fathomline.llm.toxicity import THRESHOLD, learn, score_documents
from fathomline.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"


def registered(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


def vocabulary() -> str:
    """The place of the tokenizer's file, which is installed with its package on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learned from the labels outside the held-out fold."""
    return learn(docs, table(spark, sf_dir, "labels").where(f"not ({HELD_OUT})"))


@registered
def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@registered
def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@registered
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@registered
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@registered
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"),
        # Where the offending words begin and end, in characters.
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",").alias("spans"),
    )


@registered
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@registered
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_ranges(table(spark, sf_dir, "documents"))


@registered
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), NOTICES | SHORT_NOTICES)


@registered
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@registered
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_plan(table(spark, sf_dir, "documents"))


@registered
def op11_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score_texts(table(spark, sf_dir, "documents"), held_out)


@registered
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string")) % 4
    nodes = prefix_trie(table(spark, sf_dir, "conversations"), head, F.col("conv_id") - F.col("conv_id") % 20)
    return nodes.drop("enter", "leave")


@registered
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode("restored", "UTF-8"), 256).alias("restored_sha256"),
    )


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_BLANKS = r"[^\x20\x09-\x0D]+"
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (NOTICES | SHORT_NOTICES).items())
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
# The checksum's low bits, a bit at a time: each digit is mixed in, then shifted out eight times.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({0}, ''),
    lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""

ORACLES: dict[str, str] = {
    "op1_pivot_topk": f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND {_SOUND}
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_warc_roundtrip": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
            FROM pages
        )
        SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= 1000 AND page_id < kept THEN kept END AS refers_to, url
        FROM p""",
    "op3_repeated_passages": f"""
        WITH w AS (
            SELECT doc_id, text, regexp_extract_all({_LOWER}, '{_BLANKS}') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_doc
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), h AS (
            SELECT doc_id, unnest(list_transform(generate_series(0, len(ws) - 50),
                lambda i: {{'place': i, 'hash': md5(array_to_string(list_slice(ws, i + 1, i + 50), ' '))}})) AS x
            FROM w WHERE first_doc = doc_id AND len(ws) >= 50
        ), f AS (
            SELECT doc_id, x.place AS place, min((doc_id, x.place)) OVER (PARTITION BY x.hash) AS first FROM h
        ), g AS (
            SELECT doc_id, place, first[1] AS first_doc_id, place - first[2] AS shift FROM f WHERE (doc_id, place) > first
        ), r AS (
            SELECT *, place - row_number() OVER (PARTITION BY doc_id, first_doc_id, shift ORDER BY place) AS run FROM g
        )
        SELECT doc_id, min(place) AS start_word, count(*) + 49 AS n_words, first_doc_id, min(place) - shift AS first_start_word
        FROM r GROUP BY doc_id, first_doc_id, shift, run
        UNION ALL
        SELECT doc_id, CAST(0 AS BIGINT), CAST(len(ws) AS BIGINT), first_doc, CAST(0 AS BIGINT)
        FROM w WHERE first_doc < doc_id AND len(ws) >= 50""",
    "op4_near_vectors": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
        ), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
        FROM c LEFT JOIN n ON c.vec_id = n.vec_id""",
    "op8_licenses": f"""
        WITH t0 AS (SELECT license, {_WORDS.format('notice')} AS ws FROM (VALUES {_NOTICES}) AS n(license, notice)),
        t AS (
            SELECT license, CAST(ceil(len(ws) / 4) AS INTEGER) AS step, len(ws) + CAST(ceil(len(ws) / 4) AS INTEGER) - 1 AS span,
                   list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS s
            FROM t0 WHERE len(ws) >= 5
        ), ts AS (SELECT license, step, span, len(s) AS n, unnest(s) AS shingle FROM t),
        d0 AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
        d AS (
            SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - 4),
                lambda i: {{'place': i - 1, 'shingle': array_to_string(list_slice(ws, i, i + 4), ' ')}})) AS x
            FROM d0 WHERE len(ws) >= 5
        ), hits AS (
            SELECT doc_id, license, step, n, shingle, x.place AS place,
                   unnest(generate_series(greatest(CAST(ceil((x.place + 5 - span) / step) AS BIGINT), 0), x.place // step)) AS k
            FROM d JOIN ts ON d.x.shingle = ts.shingle
        ), held AS (
            SELECT doc_id, license, k * step AS start, count(DISTINCT shingle) / min(n) AS held
            FROM hits GROUP BY doc_id, license, k, step
        )
        SELECT doc_id, license, max(held) AS containment, CAST(-max((held, -start))[2] AS INTEGER) AS word_start, count(*) AS n_windows
        FROM held WHERE held >= 0.8 GROUP BY doc_id, license
        UNION ALL
        SELECT doc_id, license, CAST(1 AS DOUBLE), CAST(min(place) AS INTEGER), count(DISTINCT place)
        FROM (
            SELECT doc_id, d0.ws, t0.license, t0.ws AS line, unnest(generate_series(0, len(d0.ws) - len(t0.ws))) AS place
            FROM d0 JOIN t0 ON len(t0.ws) < 5 AND list_contains(d0.ws, t0.ws[1])
        ) WHERE ws[place + 1:place + len(line)] = line GROUP BY doc_id, license""",
    "op10_mixture": f"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_BLANKS}')), 0) AS BIGINT) AS size FROM documents
        ), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        s1 AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn, source_size * 2 AS ceiling FROM s0
        ), s2 AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST(turn % 3 + 1 AS INTEGER)] AS weight FROM s1),
        s3 AS (
            SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
                   sum(ceiling) OVER (ORDER BY ceiling / weight, turn ROWS UNBOUNDED PRECEDING) - ceiling AS taken_before,
                   sum(weight) OVER (ORDER BY ceiling / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
            FROM s2
        ), s4 AS (SELECT *, ceiling * weight_left <= weight * (budget - taken_before) AS is_full FROM s3),
        s5 AS (
            SELECT source, source_size, turn, CASE WHEN is_full THEN CAST(ceiling AS DOUBLE) ELSE
                weight * (budget - CAST(sum(CASE WHEN is_full THEN ceiling ELSE 0 END) OVER () AS DOUBLE))
                / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target
            FROM s4
        ), p AS (
            SELECT d.*, source_size, target, turn, CAST(round(target) AS BIGINT) AS goal,
                   CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                       ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS begins
            FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
        ), q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p),
        k AS (SELECT *, greatest(0, least(size, goal - whole * source_size - begins)) AS extra FROM q),
        z AS (
            SELECT *, whole * size + extra AS taken, begins / goal AS asked,
                   [1.5::DOUBLE, 1.0, 0.5][CAST(turn % 3 + 1 AS INTEGER)] AS a, [0.5::DOUBLE, 1.0, 1.5][CAST(turn % 3 + 1 AS INTEGER)] AS b
            FROM k
        )
        SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN
            CASE WHEN a = b THEN asked * (a + b) / 2 / a ELSE (sqrt(a * a + 2 * (b - a) * (asked * (a + b) / 2)) - a) / (b - a) + 0.0 END
            END AS position
        FROM z""",
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                   {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {_CRC32.format('CAST(conv_id AS VARCHAR)')} % 4 AS h
            FROM t GROUP BY conv_id
        ), m AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS kept FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (
            SELECT m.conv_id, pos AS depth, said FROM m JOIN t ON t.conv_id = m.base AND pos <= h
            UNION ALL SELECT m.conv_id, pos - h + kept, said FROM m JOIN t ON t.conv_id = m.conv_id AND pos > h
        ), l AS (SELECT conv_id, list(said ORDER BY depth) AS path FROM r GROUP BY conv_id),
        s AS (SELECT m.conv_id, coalesce(path, []) AS path FROM m LEFT JOIN l ON l.conv_id = m.conv_id),
        p AS (
            SELECT conv_id, d AS depth, md5(CAST(to_json(path[1:d]) AS VARCHAR)) AS node, md5(CAST(to_json(path[1:d - 1]) AS VARCHAR)) AS above,
                   CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '{_BLANKS}')) ELSE 0 END AS words, d = len(path) AS ends
            FROM (SELECT conv_id, path, unnest(generate_series(0, len(path))) AS d FROM s)
        ), n AS (
            SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(words) AS words,
                   coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
            FROM p GROUP BY node, depth
        ), k AS (SELECT above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.node),
        sums AS (
            SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w.words) AS saved_tokens
            FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node
        )
        SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
        FROM w JOIN sums ON sums.node = w.node LEFT JOIN w u ON u.node = w.above AND w.depth > 0""",
    "op13_fill_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), r AS (
            SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a,
                   CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                             OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), c AS (
            SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
                   array_to_string(u[greatest(a, b) + 1:], '') AS s
            FROM r
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM c""",
}
