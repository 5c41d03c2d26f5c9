"""DuckDB SQL that states the expected answer of each registered query."""

from __future__ import annotations

from fathomline.checks.phrases import CASES

ITEMS = """
items AS (
  SELECT p_partkey AS item_id, p_name AS name, CASE WHEN p_size <= 12 THEN p_size END AS level,
         CAST(floor(p_retailprice) AS INTEGER) AS atk, p_size * 100 AS def_, lower(p_type) AS attribute,
         CASE WHEN p_type = 'PROMO' THEN NULL ELSE [p_brand, split_part(p_name, ' ', 2)] END AS properties,
         CAST(embedding AS DOUBLE[]) AS vec
  FROM part LEFT JOIN embeddings ON vec_id = p_partkey
),
contents AS (
  SELECT item_id, concat_ws(' | ', 'Name: ' || name, 'Attribute: ' || attribute, 'Level: ' || level, 'ATK: ' || atk,
         'DEF: ' || def_, 'PROPERTIES: [''' || array_to_string(properties, ''', ''') || ''']') AS content
  FROM items
)"""

QUERIES = """
asked AS (
  SELECT item_id AS query_id, name || ' with more than ' || atk || ' ATK' AS query, name || ' with' AS search_text,
         vec, CAST(atk AS BIGINT) AS eff_min,
         CASE WHEN item_id % 3 = 0 THEN CAST(atk + 100 AS BIGINT) END AS eff_max,
         CASE WHEN item_id % 5 = 1 THEN 1000 END AS min_def, CASE WHEN item_id % 5 = 2 THEN 3000 END AS max_def,
         CASE WHEN item_id % 7 = 3 THEN level END AS level, CASE WHEN item_id % 5 = 3 THEN attribute END AS attribute,
         CASE WHEN item_id % 5 = 4 THEN properties[2] END AS card_type,
         CAST(trunc(def_ / 50.0 - 5) AS INTEGER) AS lim
  FROM items WHERE vec IS NOT NULL
),
sized AS (
  SELECT *, least(greatest(lim, 1), 50) AS top_k, greatest(40, 2 * least(greatest(lim, 1), 50)) AS pool FROM asked
)"""

IN_SCOPE = """(q.eff_min IS NULL OR i.atk >= q.eff_min) AND (q.eff_max IS NULL OR i.atk <= q.eff_max)
  AND (q.min_def IS NULL OR i.def_ >= q.min_def) AND (q.max_def IS NULL OR i.def_ <= q.max_def)
  AND (q.level IS NULL OR i.level = q.level) AND (q.attribute IS NULL OR i.attribute = q.attribute)
  AND (q.card_type IS NULL OR list_contains(i.properties, q.card_type))"""


def grams(text: str) -> str:
    """SQL for the set of trigrams of a text."""
    return (
        "list_distinct(flatten(list_transform(regexp_extract_all(lower(" + text + r"), '[\p{L}\p{N}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda p: substr('  ' || w || ' ', p, 3)))))"
    )


def vector_list(scope: str, k: str, columns: str = "q.query_id, i.item_id") -> str:
    """SQL for the ranked vector candidates within ``scope``."""
    return f"""
  SELECT query_id, item_id, distance, vec_rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS INTEGER) AS vec_rank FROM (
      SELECT {columns}, q.pool, abs(round(1 - list_cosine_similarity(q.vec, i.vec), 6)) AS distance
      FROM sized q JOIN items i ON i.vec IS NOT NULL AND {scope}))
  WHERE vec_rank <= {k}"""


LEX = f"""
texts AS (SELECT DISTINCT search_text AS t FROM asked UNION SELECT DISTINCT name FROM items),
gramsets AS (SELECT t, {grams('t')} AS g FROM texts),
alike AS (
  SELECT a.t AS qt, b.t AS it,
         round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS sim
  FROM gramsets a, gramsets b
  WHERE a.t IN (SELECT search_text FROM asked) AND b.t IN (SELECT name FROM items)
)"""


def lexical_list(k: str) -> str:
    return f"""
  SELECT query_id, item_id, distance, lex_rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS INTEGER) AS lex_rank FROM (
      SELECT q.query_id, i.item_id, q.pool, round(1 - s.sim, 6) AS distance
      FROM sized q JOIN alike s ON s.qt = q.search_text AND s.sim >= 0.3
      JOIN items i ON i.name = s.it AND {IN_SCOPE}))
  WHERE lex_rank <= {k}"""


BASE = f"WITH {ITEMS},\n{QUERIES}"
FUSED_SCORE = "round(1.0::DOUBLE / (60 + coalesce(vec_rank, 1000000)) + 1.0::DOUBLE / (60 + coalesce(lex_rank, 1000000)), 9)"


def fused(join: str, pool: str) -> str:
    return f"""{BASE},\n{LEX},
vec AS ({vector_list(IN_SCOPE, pool)}),
lex AS ({lexical_list(pool)}),
fused AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS INTEGER) AS rrf_rank
    FROM (SELECT query_id, item_id, vec_rank, lex_rank, {FUSED_SCORE} AS rrf_score, pool
          FROM vec {join} JOIN lex USING (query_id, item_id) JOIN sized USING (query_id)))
  WHERE rrf_rank <= {pool}
)"""


def reranked(asked_text: str, top_k: str) -> str:
    return f"""{fused('LEFT', 'pool')},
scored AS (
  SELECT f.query_id, f.item_id, f.rrf_rank, i.name, c.content, s.query,
         CASE WHEN len(qg.g) = 0 THEN 0.0 ELSE round(len(list_intersect(qg.g, cg.g)) / len(qg.g), 6) END AS rerank_score,
         {top_k} AS keep
  FROM fused f JOIN items i USING (item_id) JOIN contents c USING (item_id) JOIN sized s USING (query_id)
  JOIN (SELECT t, {grams('t')} AS g FROM (SELECT DISTINCT {asked_text} AS t FROM asked)) qg ON qg.t = s.{asked_text}
  JOIN (SELECT item_id, {grams('content')} AS g FROM contents) cg ON cg.item_id = f.item_id
),
ranked AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS INTEGER) AS rank
    FROM scored)
  WHERE rank <= keep
)"""


# Phrase, expected lower and upper bound, expected rest after the name, kind of phrase.
def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _phrases() -> str:
    rows = ", ".join(
        f"({n}, {_sql_text(p)}, {_sql_text(lo)}, {_sql_text(hi)}, {_sql_text(rest)}, {_sql_text(tier)})"
        for n, (p, lo, hi, rest, tier) in enumerate(CASES)
    )
    return f"""
WITH phrase(n, p, lo, hi, rest, tier) AS (VALUES {rows}),
filled AS (
  SELECT p_partkey AS query_id, p_name AS name, CAST(floor(p_retailprice) AS BIGINT) AS a,
         CAST(floor(p_retailprice) AS BIGINT) + p_size * 100 AS b, phrase.*
  FROM part JOIN phrase ON n = p_partkey % {len(CASES)}
)
SELECT query_id, tier AS ext_tier, CASE lo WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'big' THEN 9223372036854775807 END AS ext_min,
       CASE hi WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'big' THEN 9223372036854775807 END AS ext_max,
       CASE WHEN tier IS NULL THEN name || '  ' || replace(replace(p, '{{a}}', a::VARCHAR), '{{b}}', b::VARCHAR)
            ELSE name || rest END AS ext_text
FROM filled"""


STORED = """
stored AS (
  SELECT c_custkey::BIGINT AS item_key, c_name AS name, c_nationkey AS level,
         CASE WHEN c_custkey % 10 = 1 THEN 'old' WHEN c_custkey % 10 <> 2
              THEN sha256(c_name || '|' || c_mktsegment) END AS content_hash,
         CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal::FLOAT::DOUBLE, 2) END AS vector
  FROM customer WHERE c_custkey % 10 <> 0
)"""
SOURCE = """
source AS (
  SELECT CASE WHEN c_custkey % 10 <> 3 THEN c_custkey::BIGINT END AS item_key,
         sha256(c_name || '|' || c_mktsegment) AS content_hash
  FROM customer
)"""
CHANGES = """
changes AS (
  SELECT item_key, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS level,
         'new' AS content_hash, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice::FLOAT::DOUBLE, 2) END AS vector
  FROM (SELECT *, o_custkey * 2 AS item_key, row_number() OVER (
          PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC) AS place FROM orders)
  WHERE place = 1
)"""
GONE = "gone AS (SELECT DISTINCT o_custkey * 2 AS item_key FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)"
UPSERTED = f"""WITH {STORED}, {CHANGES}
SELECT coalesce(c.item_key, s.item_key) AS item_key,
       CASE WHEN c.item_key IS NOT NULL THEN c.name ELSE s.name END AS name,
       CASE WHEN c.item_key IS NOT NULL THEN c.level ELSE s.level END AS level,
       CASE WHEN c.item_key IS NOT NULL THEN c.content_hash ELSE s.content_hash END AS content_hash,
       coalesce(c.vector, s.vector) AS vector
FROM stored s FULL OUTER JOIN changes c ON s.item_key = c.item_key"""
CHANGED = """SELECT s.item_key, s.content_hash FROM source s WHERE s.item_key IS NULL OR NOT EXISTS (
  SELECT 1 FROM stored t WHERE t.item_key = s.item_key AND t.content_hash = s.content_hash{more})"""

RANKED_LINES = """
ranked AS (
  SELECT l_orderkey AS query_id, CAST(l_linenumber AS INTEGER) AS rank, p_name AS name,
         CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS content
  FROM lineitem JOIN part ON p_partkey = l_partkey
),
wanted AS (SELECT o_orderkey AS query_id, o_orderpriority AS query FROM orders)"""

TOOL_REPORT = """
SELECT w.query_id, coalesce(b.n, 0) AS n_results,
       CASE WHEN b.n IS NULL THEN 'No cards found matching your query.'
            ELSE 'Top ' || b.n || ' results for: ' || w.query || chr(10) || chr(10) || b.body END AS report
FROM wanted w LEFT JOIN (
  SELECT query_id, count(*) AS n, string_agg(rank || '. ' || coalesce(name, 'None') || chr(10) || '   '
         || coalesce(content, 'None') || chr(10), chr(10) ORDER BY rank, name, content) AS body
  FROM ranked GROUP BY query_id) b USING (query_id)"""
CLI_REPORT = """
SELECT w.query_id, coalesce(b.n, 0) AS n_results,
       'Top ' || coalesce(b.n, 0) || ' Results:' || chr(10) || coalesce(chr(10) || b.body, '') AS report
FROM wanted w LEFT JOIN (
  SELECT query_id, count(*) AS n, string_agg(rank || '. ' || coalesce(name, 'None') || chr(10) || '   '
         || coalesce(content, 'None') || chr(10) || repeat('-', 60), chr(10) ORDER BY rank) AS body
  FROM ranked GROUP BY query_id) b USING (query_id)"""
CONTEXT = """SELECT query_id, string_agg('- ' || coalesce(name, 'None') || ': ' || coalesce(content, 'None'), chr(10)
  ORDER BY rank, name, content) AS context FROM ranked GROUP BY query_id"""
PROMPT = f"""SELECT w.query_id, 'Answer a question about catalogue items.' || chr(10) || 'Question: ' || w.query
  || chr(10) || chr(10) || 'Describe the most relevant of the items below and use their text. '
  || 'State nothing that the items do not say. If no item is listed, answer that none was found.'
  || chr(10) || chr(10) || 'Items:' || chr(10) || coalesce(c.context, '') || chr(10) AS prompt
FROM wanted w LEFT JOIN ({CONTEXT}) c USING (query_id)"""

EVENT_CHANGES = """
raw AS (
  SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'created' WHEN 'view' THEN 'modified'
         WHEN 'purchase' THEN 'moved' WHEN 'error' THEN 'deleted' ELSE 'opened' END AS kind,
         CASE WHEN event_id % 13 = 0 THEN '.' ELSE '' END || user_id AS shown, user_id::VARCHAR AS plain,
         CASE WHEN event_id % 11 = 0 THEN '.txt' ELSE '.json' END AS suffix, event_id % 17 = 0 AS is_directory
  FROM events
),
changes AS (
  SELECT event_id, ts, CASE WHEN kind = 'deleted' THEN 'delete' ELSE 'upsert' END AS op,
         CASE WHEN kind = 'moved' THEN '/w/old/' || plain || suffix ELSE '/w/' || shown || suffix END AS path,
         CASE WHEN kind IN ('created', 'moved') THEN 'created' WHEN kind = 'modified' THEN 'modified' END AS debounce_type
  FROM raw WHERE NOT is_directory AND suffix = '.json' AND kind <> 'opened'
    AND (kind = 'moved' OR shown NOT LIKE '.%')
)"""


def debounced(source: str, keys: str, hours: int = 6) -> str:
    """SQL that walks each key's chain event by event."""
    return f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM {source}
),
walk AS (
  SELECT {keys}, event_id, n, ts AS last, true AS kept FROM numbered WHERE n = 1
  UNION ALL
  SELECT {', '.join('e.' + k.strip() for k in keys.split(','))}, e.event_id, e.n,
         CASE WHEN e.ts - w.last >= INTERVAL {hours} HOUR THEN e.ts ELSE w.last END,
         e.ts - w.last >= INTERVAL {hours} HOUR
  FROM walk w JOIN numbered e ON e.n = w.n + 1 AND {' AND '.join(f'e.{k.strip()} = w.{k.strip()}' for k in keys.split(','))}
)"""


DOCUMENTS = """
source AS (
  SELECT p_partkey AS k, p_name AS name, lower(p_type) AS attribute, p_brand, p_type,
         CASE WHEN p_size <= 12 THEN p_size END AS level, CAST(floor(p_retailprice) AS INTEGER) + {change} AS atk,
         p_size * 100 AS def_
  FROM part WHERE p_partkey % 23 <> 7
),
docs AS (
  SELECT '/items/' || k || '.json' AS path, CASE WHEN k % 19 <> 5 THEN k END AS item_key, name, level,
         CASE WHEN k % 6 <> 3 THEN atk END AS atk, def_, attribute,
         concat_ws(' | ', 'Name: ' || name, 'Attribute: ' || attribute, 'Level: ' || level,
                   'ATK: ' || CASE WHEN k % 6 <> 3 THEN atk END, 'DEF: ' || def_,
                   CASE WHEN p_type <> 'PROMO' THEN 'PROPERTIES: [''' || p_brand || ''', '''
                        || split_part(name, ' ', 2) || ''']' END) AS content
  FROM source
)"""
CHANGE = "CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE 0 END"

URLS = "split_part(url, '?', 1)"

ORACLES: dict[str, str] = {
    "filter_combined": f"""WITH {ITEMS} SELECT item_id, atk, def_, attribute FROM items
        WHERE atk >= 910 AND atk <= 1080 AND def_ >= 500 AND def_ <= 4500 AND attribute = 'economy'""",
    "filter_null_semantics": f"WITH {ITEMS} SELECT item_id, level FROM items WHERE level = 7",
    "filter_property": f"WITH {ITEMS} SELECT item_id, name FROM items WHERE list_contains(properties, 'widget')",
    "filter_pairs_batch": f"""{BASE} SELECT q.query_id, count(*) AS n_items, min(i.item_id) AS first_item,
        CAST(sum(i.item_id) AS BIGINT) AS id_sum FROM asked q JOIN items i ON {IN_SCOPE} GROUP BY q.query_id""",
    "filter_counts_batch": f"""{BASE} SELECT q.query_id, count(i.item_id) AS n_items FROM asked q LEFT JOIN items i ON {IN_SCOPE}
        GROUP BY q.query_id""",
    "property_index_semijoin": f"""WITH {ITEMS} SELECT item_id, name FROM items i WHERE EXISTS (
        SELECT 1 FROM part WHERE p_type = 'PROMO' AND p_size <= 2 AND list_contains(i.properties, p_brand))""",
    "constraints_generated": _phrases(),
    "constraints_in_conversations": r"""SELECT conv_id, turn, least(conv_id, 700) AS ext_min, greatest(conv_id, 700) AS ext_max,
        sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM conversations""",
    "prepared_queries": f"""{BASE} SELECT query_id, search_text, eff_min, eff_max - 150 AS eff_max,
        coalesce(eff_min > eff_max - 150, false) AS contradictory FROM asked""",
    "merge_bounds": """SELECT *, coalesce(eff_min > eff_max, false) AS contradictory FROM (
        SELECT o_orderkey,
          greatest(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 END) AS eff_min,
          least(CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 500 END, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 900 END) AS eff_max
        FROM orders)""",
    "pool_and_limit": """SELECT l_orderkey, l_linenumber, top_k, greatest(40, 2 * top_k) AS pool FROM (
        SELECT l_orderkey, l_linenumber, least(greatest(CAST(trunc(l_quantity) AS INTEGER) * 2 - 10, 1), 50) AS top_k FROM lineitem)""",
    "clean_ints": """SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 2 THEN o_custkey WHEN 3 THEN -o_custkey
        WHEN 5 THEN o_custkey END AS INTEGER) AS number FROM orders""",
    "render_lists": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '["' || c_mktsegment || '''s", ''' || split_part(c_name, '#', 2) || ''']'
        WHEN c_custkey % 3 = 1 THEN '[''Customer'']' WHEN c_nationkey < 20 THEN '[]' END AS shown FROM customer""",
    "item_content": f"""WITH {ITEMS} SELECT item_id, concat_ws(' | ',
        'Name: ' || CASE WHEN item_id % 10 <> 3 THEN name ELSE 'None' END,
        CASE WHEN item_id % 10 <> 4 THEN 'Attribute: ' || attribute END, 'Level: ' || level,
        'ATK: ' || (atk - 900), 'DEF: ' || def_,
        'PROPERTIES: [''' || array_to_string(properties, ''', ''') || ''']',
        CASE WHEN item_id % 2 = 0 THEN 'Description: Made of ' || name END) AS content FROM items""",
    "document_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "collapsed_text": r"""SELECT doc_id, length(t) AS n, sha256(t) AS text_hash FROM (
        SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
    "document_trigrams": r"""SELECT doc_id, coalesce(sum(len(w)), 0)::BIGINT AS n_windows, count(DISTINCT t)::BIGINT AS n_trigrams FROM (
        SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS t, 1 FROM (
          SELECT doc_id, [] AS w FROM documents WHERE false)) GROUP BY doc_id""",
    "trigram_similarity": f"""WITH g AS (SELECT p_partkey, {grams('p_name')} AS a,
          {grams("split_part(p_name, ' ', 2) || ' ' || lower(p_type) || ' ' || p_brand")} AS b FROM part),
        s AS (SELECT p_partkey, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM g)
        SELECT p_partkey, round(sim, 6) AS similarity, round(1 - sim, 6) AS distance FROM s""",
    "cosine_distances": """SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "normalized_vectors": """SELECT vec_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length, CAST(i AS INTEGER) AS place,
        CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(v[i + 1] / n, 6) + 0.0 END AS value FROM (
          SELECT vec_id, v, unnest(range(len(v))) AS i, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS v FROM embeddings))""",
    "wrong_dims": """SELECT vec_id, CAST(60 + vec_id % 5 AS INTEGER) AS n FROM embeddings WHERE 60 + vec_id % 5 <> 64""",
    "rrf_scores": """SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE / (60 + l_linenumber)
        + 1.0::DOUBLE / (60 + CASE WHEN l_quantity > 25 THEN trunc(l_quantity) ELSE 1000000 END), 9) AS rrf_score FROM lineitem""",
    "nearest_to_one": f"""WITH {ITEMS}, one AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
        SELECT item_id, abs(round(1 - list_cosine_similarity(vec, v), 6)) AS distance FROM items, one
        WHERE vec IS NOT NULL AND def_ >= 1000 ORDER BY distance, item_id LIMIT 40""",
    "knn_all": f"{BASE} {vector_list('true', '10')}",
    "vector_topk_filtered": f"{BASE} {vector_list(IN_SCOPE, '10')}",
    "vector_topk_grid": f"{BASE} {vector_list(IN_SCOPE, '10')}",
    "ivf_exact": f"{BASE} {vector_list(IN_SCOPE, '10')}",
    "ivf_recall": f"""{BASE} SELECT query_id, count(*) AS hits, count(*) AS expected, 1.0::DOUBLE AS recall
        FROM ({vector_list('true', '10')}) GROUP BY query_id""",
    "lexical_topk": f"{BASE}, {LEX} {lexical_list('40')}",
    "trigram_index_topk": f"{BASE}, {LEX} {lexical_list('40')}",
    "rrf_fuse_left": f"""{fused('LEFT', '40')} SELECT query_id, item_id, vec_rank, lex_rank, rrf_score, rrf_rank FROM fused""",
    "rrf_fuse_outer": f"""{fused('FULL', '40')} SELECT query_id, item_id, vec_rank, lex_rank, rrf_score, rrf_rank FROM fused""",
    "hybrid_topk": f"""{fused('LEFT', 'pool')} SELECT query_id, item_id, vec_rank, lex_rank, rrf_score, rrf_rank, name, content
        FROM fused JOIN items USING (item_id) JOIN contents USING (item_id)""",
    "rerank_topk": f"{reranked('query', '5')} SELECT query_id, item_id, rerank_score, rank FROM ranked",
    "rerank_learned": f"""{fused('LEFT', 'pool')} SELECT query_id, query_id % 4 = 0 AS held_out,
        max(CAST(starts_with(search_text, name) AS INTEGER)) AS held_right, max(CAST(starts_with(search_text, name) AS INTEGER)) AS first_is_right
        FROM fused JOIN items USING (item_id) JOIN asked USING (query_id) GROUP BY query_id""",
    "hybrid_search_full": f"""{reranked('search_text', 's.top_k')}
        SELECT query_id, item_id, rrf_rank, rerank_score, rank FROM ranked""",
    "search_reports": f"""{reranked('search_text', 's.top_k')}, wanted AS (SELECT query_id, query FROM asked) {TOOL_REPORT}""",
    "search_prompts": f"""{reranked('search_text', '30').replace('greatest(40, 2 * least(greatest(lim, 1), 50)) AS pool', '60 AS pool')},
        wanted AS (SELECT query_id, query FROM asked) {PROMPT}""",
    "search_reports_cli": f"""{reranked('search_text', '30').replace('greatest(40, 2 * least(greatest(lim, 1), 50)) AS pool', '60 AS pool')},
        wanted AS (SELECT query_id, query FROM asked) {CLI_REPORT}""",
    "format_results": f"WITH {RANKED_LINES} {TOOL_REPORT}",
    "lookup_report": f"""WITH {ITEMS}, keys AS (SELECT c_custkey::BIGINT * 3 AS item_key FROM customer)
        SELECT item_key, CASE WHEN i.item_id IS NULL THEN 'Card with ID ' || item_key || ' not found.' ELSE
          'Name: ' || name || chr(10) || 'Content: ' || content || chr(10) || 'Level: ' || coalesce(level::VARCHAR, 'None')
          || ' | ATK: ' || atk || ' | DEF: ' || def_ || chr(10) || 'Attribute: ' || attribute || chr(10)
          || 'Properties: ' || coalesce('[''' || array_to_string(properties, ''', ''') || ''']', 'None') END AS report
        FROM keys LEFT JOIN items i ON i.item_id = item_key LEFT JOIN contents c ON c.item_id = item_key""",
    "build_context": f"WITH {RANKED_LINES} {CONTEXT}",
    "build_prompts": f"WITH {RANKED_LINES} {PROMPT}",
    "changed_rows": f"WITH {STORED}, {SOURCE} " + CHANGED.format(more=""),
    "changed_rows_require_vectors": f"WITH {STORED}, {SOURCE} " + CHANGED.format(more=" AND t.vector IS NOT NULL"),
    "rejected_rows": f"WITH {SOURCE} SELECT content_hash FROM source WHERE item_key IS NULL",
    "merge_upsert": UPSERTED,
    "merge_upsert_large": UPSERTED,
    "merge_delete": f"WITH {STORED}, {GONE} SELECT * FROM stored WHERE item_key NOT IN (SELECT item_key FROM gone)",
    "missing_tombstones": f"WITH {STORED}, {GONE} SELECT item_key FROM gone WHERE item_key NOT IN (SELECT item_key FROM stored)",
    "latest_per_key": """SELECT item_key, path, o_totalprice FROM (
        SELECT o_custkey AS item_key, lpad(o_orderkey::VARCHAR, 12, '0') AS path, o_totalprice,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, lpad(o_orderkey::VARCHAR, 12, '0') DESC) AS n
        FROM orders) WHERE n = 1""",
    "snapshot_diff": f"""WITH {STORED}, {SOURCE}, listed AS (SELECT * FROM source WHERE item_key IS NOT NULL)
        SELECT coalesce(l.item_key, s.item_key) AS item_key, CASE WHEN s.item_key IS NULL THEN 'insert'
          WHEN l.item_key IS NULL THEN 'delete' WHEN l.content_hash = s.content_hash THEN 'unchanged' ELSE 'update' END AS action
        FROM listed l FULL OUTER JOIN stored s ON l.item_key = s.item_key""",
    "check_keys": """SELECT item_key, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS item_key FROM orders)
        GROUP BY item_key HAVING count(*) > 1 OR item_key IS NULL""",
    "ingest_stats": f"""WITH {STORED}, {SOURCE}, changed AS ({CHANGED.format(more='')}),
        n AS (SELECT (SELECT count(*) FROM source WHERE item_key IS NOT NULL) AS seen,
          (SELECT count(*) FROM changed WHERE item_key IS NOT NULL) AS done,
          (SELECT count(*) FROM changed WHERE item_key IS NULL) AS rejected)
        SELECT 'ingested' AS status, done AS n FROM n UNION ALL SELECT 'skipped', seen - done FROM n
        UNION ALL SELECT 'rejected', rejected FROM n UNION ALL SELECT 'quarantined', 0 FROM n
        UNION ALL SELECT 'failed', 0 FROM n""",
    "index_count": f"WITH {STORED} SELECT count(*) AS total FROM stored",
    "stored_hashes": f"WITH {STORED} SELECT item_key, content_hash FROM stored",
    "upgraded_schema": """SELECT c_custkey::BIGINT AS item_key, c_name AS name, c_nationkey AS level, NULL::INTEGER AS atk,
          NULL::VARCHAR AS content_hash, true AS no_vector FROM customer
        UNION ALL SELECT s_suppkey::BIGINT + 10000000, s_name, NULL, NULL, 'x', true FROM supplier""",
    "parsed_documents": f"""WITH {DOCUMENTS.format(change='0')} SELECT path, item_key, level, atk, def_, content,
        sha256(content) AS content_hash FROM docs""",
    "ingest_job_stats": f"""WITH {DOCUMENTS.format(change=CHANGE)},
        n AS (SELECT count(*) FILTER (item_key % 4 = 0 AND atk IS NOT NULL) AS done, count(item_key) AS seen,
          count(*) - count(item_key) AS rejected FROM docs)
        SELECT 'ingested' AS status, done AS n FROM n UNION ALL SELECT 'skipped', seen - done FROM n
        UNION ALL SELECT 'rejected', rejected FROM n
        UNION ALL SELECT 'quarantined', count(*) FROM part WHERE p_partkey % 23 = 7
        UNION ALL SELECT 'failed', 0""",
    "ingest_job_index": f"""WITH {DOCUMENTS.format(change=CHANGE)} SELECT item_key, name, level, atk, def_,
        sha256(content) AS content_hash, 32 AS dims FROM docs WHERE item_key IS NOT NULL""",
    "path_filter": f"""SELECT page_id, {URLS} || '.json' AS path FROM pages WHERE page_id % 3 = 0
        AND split_part({URLS} || '.json', '/', -1) NOT LIKE '.%'""",
    "path_keys": """SELECT page_id, CASE WHEN page_id % 4 <> 0 AND page_id % 7 <> 0 THEN page_id END AS item_key FROM pages""",
    "size_guard": """SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents WHERE strlen(text) <= 1000""",
    "size_guard_pages": "SELECT page_id FROM pages WHERE strlen(html) <= 51200",
    "event_changes": f"WITH {EVENT_CHANGES} SELECT event_id, op, path, debounce_type FROM changes",
    "retained_moves": f"""WITH {EVENT_CHANGES} SELECT '/w/' || shown || suffix AS src_path, '/w/old/' || plain || suffix AS dest_path,
        epoch_us(ts) AS us FROM raw WHERE kind = 'moved' AND NOT is_directory AND suffix = '.json' AND shown NOT LIKE '.%'""",
    "debounced_events": f"""WITH RECURSIVE {debounced('events', 'user_id, event_type')}
        SELECT event_id, user_id, event_type FROM walk WHERE kept""",
    "debounced_hot_key": f"""WITH RECURSIVE one AS (SELECT *, 1 AS k FROM events), {debounced('one', 'k', 1)}
        SELECT event_id, user_id, event_type FROM walk JOIN events USING (event_id) WHERE kept""",
    "debounced_changes": f"""WITH RECURSIVE {EVENT_CHANGES}, held AS (SELECT * FROM changes WHERE op = 'upsert'),
        {debounced('held', 'path, debounce_type')}
        SELECT event_id, 'upsert' AS op, path FROM walk WHERE kept
        UNION ALL SELECT event_id, op, path FROM changes WHERE op = 'delete'""",
    "debounced_stream": f"""WITH RECURSIVE {debounced('events', 'user_id, event_type')}
        SELECT user_id::VARCHAR AS path, event_type AS debounce_type, epoch_us(last) AS us FROM walk WHERE kept""",
    "embed_row_by_row": f"""WITH {ITEMS} SELECT item_id,
        CASE WHEN '  ' || lower(regexp_replace(name, '[^A-Za-z0-9]+', '   ', 'g')) || ' ' NOT LIKE '% red %' THEN 32 ELSE -1 END AS dims,
        CASE WHEN '  ' || lower(regexp_replace(name, '[^A-Za-z0-9]+', '   ', 'g')) || ' ' LIKE '% red %' THEN 'RuntimeError: refused' END AS problem
        FROM items""",
    "empty_directory_stats": "SELECT c_custkey AS item_key, c_name AS name, CAST(0 AS BIGINT) AS n_documents FROM customer",
    "embed_both": f"""WITH {ITEMS} SELECT item_id, true AS no_hosted, 32 AS dims, 1.0::DOUBLE AS length FROM items""",
}

# The last change of an item in each of the three logs, and why it could not be applied.
ITEM_CHANGES = """
heard AS (
  SELECT event_id // 4 AS k, event_id % 3 AS log, ts, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error') AND event_id % 17 <> 0 AND event_id % 11 <> 0
),
last AS (
  SELECT k, log, op, CASE WHEN op = 'delete' THEN NULL WHEN k NOT IN (SELECT p_partkey FROM part) THEN 'missing'
           WHEN k % 29 = 3 THEN 'too large' WHEN k % 23 = 7 THEN 'unreadable' WHEN k % 19 = 5 THEN 'no key' END AS reason
  FROM heard QUALIFY row_number() OVER (PARTITION BY k, log ORDER BY ts DESC, op) = 1
)"""
ORACLES["change_stream_index"] = f"""WITH {DOCUMENTS.format(change='0')}, {ITEM_CHANGES},
final AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY k ORDER BY log DESC) = 1)
SELECT item_key, name, atk, sha256(content) AS content_hash FROM docs
JOIN final ON k = item_key WHERE op = 'upsert' AND reason IS NULL"""
ORACLES["change_stream_failures"] = f"""WITH {ITEM_CHANGES}
SELECT k || '.json' AS file, reason, count(*) AS n FROM last WHERE reason IS NOT NULL GROUP BY ALL"""
ORACLES["reconcile_index"] = f"""WITH {DOCUMENTS.format(change='0')}
SELECT item_key, name, atk, sha256(content) AS content_hash FROM docs WHERE item_key IS NOT NULL
UNION ALL SELECT c_custkey * 2, c_name, NULL, NULL FROM customer
WHERE c_custkey * 2 IN (SELECT p_partkey FROM part) AND c_custkey * 2 NOT IN (SELECT item_key FROM docs WHERE item_key IS NOT NULL)"""
REWRITTEN = DOCUMENTS.format(change="CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 0 THEN 5 ELSE 0 END")
ORACLES["reconcile_digests"] = f"""WITH {REWRITTEN}, held AS (
  SELECT item_key, name, atk, sha256(content) AS content_hash FROM docs WHERE item_key % 10 <> 9
)
SELECT * FROM held UNION ALL
SELECT c_custkey * 2, c_name, NULL, NULL FROM customer
WHERE c_custkey * 2 IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 50 <> 3)
  AND c_custkey * 2 NOT IN (SELECT item_key FROM held)"""
ORACLES["directory_stream_index"] = f"""WITH {REWRITTEN}
SELECT item_key, name, atk, sha256(content) AS content_hash FROM docs WHERE item_key % 29 <> 3 AND item_key % 10 <> 9"""
ORACLES["ingest_then_watch_index"] = f"""WITH {REWRITTEN}, held AS (
  SELECT item_key, name, atk, sha256(content) AS content_hash FROM docs
  WHERE item_key % 10 <> 9 AND (item_key % 3 <> 0 OR item_key % 29 <> 3)
)
SELECT * FROM held UNION ALL
SELECT c_custkey * 2, c_name, NULL, NULL FROM customer WHERE c_custkey * 2 NOT IN (SELECT item_key FROM held)"""
ORACLES["layout_scan"] = f"""WITH {ITEMS}
SELECT 'atk' AS filter, item_id AS item_key FROM items WHERE atk BETWEEN 1000 AND 1009
UNION ALL SELECT 'def_', item_id FROM items WHERE def_ >= 4900
UNION ALL SELECT 'level', item_id FROM items WHERE level = 3
UNION ALL SELECT 'english_attribute', item_id FROM items WHERE attribute = 'economy'"""

# Trigrams of whole documents: words first, so that no long text is indexed by position.
WORDS = r"""
words AS (
  SELECT doc_id, '  ' || unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) || ' ' AS w FROM documents
),
windows AS (
  SELECT doc_id, substr(w, unnest(range(1, length(w) - 1)), 3) AS t FROM words
)"""
ORACLES["document_trigrams"] = f"""WITH {WORDS}
SELECT d.doc_id, count(t) AS n_windows, count(DISTINCT t) AS n_trigrams FROM documents d LEFT JOIN windows USING (doc_id)
GROUP BY d.doc_id"""
SLOT = "CAST((unicode(substr(t, 1, 1)) * 961 + unicode(substr(t, 2, 1)) * 31 + unicode(substr(t, 3, 1))) % {dims} AS INTEGER)"
ORACLES["embed_hashed"] = f"""WITH {WORDS},
counts AS (SELECT doc_id, {SLOT.format(dims=64)} AS slot, count(*) AS n FROM windows GROUP BY ALL)
SELECT doc_id, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS value FROM counts"""
NAMES = f"""
names AS (SELECT p_name AS query, min(p_partkey) AS query_id FROM part GROUP BY p_name),
spread AS (
  SELECT query, '  ' || unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) || ' ' AS w FROM names
),
slots AS (
  SELECT query, {SLOT.format(dims=32)} AS slot, count(*) AS n
  FROM (SELECT query, substr(w, unnest(range(1, length(w) - 1)), 3) AS t FROM spread) GROUP BY ALL
),
coded AS (SELECT query, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY query)) AS FLOAT) AS DOUBLE) AS v FROM slots),
lengths AS (SELECT query, sqrt(sum(v * v)) AS len FROM coded GROUP BY query),
near AS (
  SELECT a.query AS q, b.query AS i, sum(a.v * b.v) AS dot FROM coded a JOIN coded b USING (slot) GROUP BY ALL
),
distances AS (
  SELECT a.query AS q, b.query AS i, abs(round(1 - coalesce(dot, 0) / (a.len * b.len), 6)) AS distance
  FROM lengths a CROSS JOIN lengths b LEFT JOIN near ON near.q = a.query AND near.i = b.query
)"""
ORACLES["vector_topk_other_column"] = f"""WITH {NAMES}
SELECT query_id, item_id, distance, vec_rank FROM (
  SELECT query_id, p_partkey AS item_id, distance,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, p_partkey) AS INTEGER) AS vec_rank
  FROM names JOIN distances ON q = query JOIN part ON p_name = i)
WHERE vec_rank <= 10"""
ORACLES["quarantined_documents"] = f"""WITH {ITEMS}, broken AS (
  SELECT *, floor(atk) AS whole FROM items WHERE item_id % 23 = 7
)
SELECT '/items/' || item_id || '.json' AS path,
  CASE WHEN item_id % 19 = 5 THEN '{{' ELSE '{{"id": ' || item_id || ', ' END
  || '"name": "' || name || '", "englishAttribute": "' || attribute || '", "atk": '
  || CASE item_id % 6 WHEN 1 THEN '"' || atk || '"' WHEN 2 THEN atk || '.7' WHEN 3 THEN '"unknown"' ELSE atk::VARCHAR END
  || ', "def": ' || def_ || CASE WHEN level IS NOT NULL THEN ', "level": ' || level ELSE '' END
  || CASE WHEN properties IS NOT NULL THEN ', "properties": ["' || array_to_string(properties, '","') || '"]' ELSE '' END
  AS bad_record
FROM broken"""
