"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fathomline.checks.views import (
    content_of_items, documents, events_as_changes, item_bodies, item_changes, item_files, item_rows, items_view,
    phrase_queries, queries_view, removed_files, table, utc,
)
from fathomline.functions.constraints import extract_constraints, merge_lower, merge_upper, prepare_queries
from fathomline.functions.scoring import clamp_limit, pool_size, rrf_score
from fathomline.functions.text import build_content, clean_int, collapse_spaces, content_hash, render_list
from fathomline.functions.trigram import trgm_similarity, trigram_windows
from fathomline.functions.vectors import check_dims, cosine_distance, l2_normalize, norm
from fathomline.operators.learned import PAIR_PARTS, fit_pair_model
from fathomline.operators import lexical, merge, reports
from fathomline.operators.codes import code_build, coded_topk
from fathomline.operators.counting import filter_counts
from fathomline.operators.debounce import debounce
from fathomline.operators.encode import HashedTrigramEncoder, embed, embed_many
from fathomline.operators.events import ignored_moves, normalize_events
from fathomline.operators.fitted import fit_encoder
from fathomline.operators.filters import Filters, filter_items, filter_pairs, items_with_properties
from fathomline.operators.fusion import rrf_fuse
from fathomline.operators.ivf import ivf_build, ivf_topk, recall_at_k
from fathomline.operators.nearest import knn_join, nearest_items, vector_topk
from fathomline.operators.rerank import HELD, rerank, with_asked, with_held
from fathomline.plans import digests
from fathomline.plans.ingest import ingest, ingest_documents, reconcile
from fathomline.plans.search import (
    context_prompts, hybrid_candidates, hybrid_search, search_report, with_limits,
)
from fathomline.session import checkpoint_dir, cut_lineage, deal
from fathomline.sources.changelog import read_change_log
from fathomline.sources.directory_stream import read_directory_changes
from fathomline.sources.index_table import FILTERED, IndexStore, existing_hashes, union_versions, upgrade_schema
from fathomline.sources.items import parse_documents, split_bad_records, to_index_rows
from fathomline.sources.paths import key_from_path, path_is_item, within_size
from fathomline.streaming.watch import debounce_stream, read_failures, watch

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

HOUR_US = 3_600_000_000
KNN_K = 10
POOL = 40


def registered(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stream_settings(spark: SparkSession):
    """A state store per shuffle partition; one per core is enough."""
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settings(spark, {
        "spark.sql.shuffle.partitions": str(stores),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# --- filters ---------------------------------------------------------------


@registered
def filter_combined(spark, sf):
    wanted = Filters(min_atk=910, max_atk=1080, min_def=500, max_def=4500, attribute="economy")
    return filter_items(item_rows(spark, sf), wanted).select("item_id", "atk", "def_", "attribute")


@registered
def filter_null_semantics(spark, sf):
    return filter_items(item_rows(spark, sf), Filters(level=7)).select("item_id", "level")


@registered
def filter_property(spark, sf):
    return filter_items(item_rows(spark, sf), Filters(card_type="widget")).select("item_id", "name")


@registered
def filter_pairs_batch(spark, sf):
    pairs = filter_pairs(prepare_queries(queries_view(spark, sf)), item_rows(spark, sf))
    return pairs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"), F.sum("item_id").alias("id_sum")
    )


@registered
def filter_counts_batch(spark, sf):
    return filter_counts(prepare_queries(queries_view(spark, sf)), item_rows(spark, sf))


@registered
def property_index_semijoin(spark, sf):
    # The brands that sell promotional items.
    promo = table(spark, sf, "part").where(F.col("p_type") == "PROMO").where(F.col("p_size") <= 2)
    wanted = promo.select(F.col("p_brand").alias("property"))
    return items_with_properties(item_rows(spark, sf), wanted).select("item_id", "name")


# --- constraints -----------------------------------------------------------


@registered
def constraints_generated(spark, sf):
    found = extract_constraints(phrase_queries(spark, sf))
    return found.select("query_id", "ext_tier", "ext_min", "ext_max", "ext_text")


@registered
def constraints_in_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat("text", F.lit(" entre "), F.col("conv_id").cast("string"), F.lit(" e 700")).alias("query"),
    )
    found = extract_constraints(turns)
    return found.select("conv_id", "turn", "ext_min", "ext_max", content_hash(F.col("ext_text")).alias("text_hash"))


@registered
def prepared_queries(spark, sf):
    prepared = prepare_queries(queries_view(spark, sf).withColumn("max_atk", F.col("max_atk") - 150))
    return prepared.select("query_id", "search_text", "eff_min", "eff_max", "contradictory")


@registered
def merge_bounds(spark, sf):
    orders = table(spark, sf, "orders")
    explicit_min = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    explicit_max = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") + 500)
    extracted_min = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000)
    extracted_max = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 900)
    merged = orders.select(
        "o_orderkey",
        merge_lower(explicit_min, extracted_min).alias("eff_min"),
        merge_upper(explicit_max, extracted_max).alias("eff_max"),
    )
    return merged.withColumn("contradictory", F.coalesce(F.col("eff_min") > F.col("eff_max"), F.lit(False)))


@registered
def pool_and_limit(spark, sf):
    limits = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * 2 - 10).alias("limit")
    )
    clamped = limits.select("l_orderkey", "l_linenumber", clamp_limit(F.col("limit")).alias("top_k"))
    return clamped.withColumn("pool", pool_size(F.col("top_k")))


# --- scalar functions ------------------------------------------------------


@registered
def clean_ints(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    text = (
        F.when(key % 7 == 0, F.col("o_orderpriority"))
        .when(key % 7 == 1, F.col("o_totalprice").cast("string"))
        .when(key % 7 == 2, F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")))
        .when(key % 7 == 3, F.concat(F.lit("-"), F.col("o_custkey").cast("string")))
        .when(key % 7 == 4, F.concat(F.lit("9999"), (F.col("o_custkey") + 10_000_000).cast("string")))
        .when(key % 7 == 5, F.concat(F.lit("+"), F.col("o_custkey").cast("string")))
    )
    return orders.select("o_orderkey", clean_int(text).alias("number"))


@registered
def render_lists(spark, sf):
    words = F.split("c_name", "#")
    owner = F.concat(F.col("c_mktsegment"), F.lit("'s"))
    lists = F.when(F.col("c_custkey") % 3 == 0, F.array(owner, F.element_at(words, 2))).when(
        F.col("c_custkey") % 3 == 1, F.array(F.element_at(words, 1))
    ).when(F.col("c_nationkey") < 20, F.array().cast("array<string>"))
    return table(spark, sf, "customer").select("c_custkey", render_list(lists).alias("shown"))


@registered
def item_content(spark, sf):
    name = F.when(F.col("item_id") % 10 != 3, F.col("name"))
    attribute = F.when(F.col("item_id") % 10 == 4, F.lit("")).otherwise(F.col("attribute"))
    effect = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Made of "), F.col("name"))).otherwise(F.lit(""))
    content = build_content(
        name, attribute, F.col("level"), F.col("atk") - 900, F.col("def_"), F.col("properties"), effect
    )
    return item_rows(spark, sf).select("item_id", content.alias("content"))


@registered
def document_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@registered
def collapsed_text(spark, sf):
    collapsed = collapse_spaces(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(collapsed).cast("bigint").alias("n"), content_hash(collapsed).alias("text_hash")
    )


@registered
def document_trigrams(spark, sf):
    windows = documents(spark, sf).select("doc_id", trigram_windows(F.col("text")).alias("w"))
    return windows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_windows"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_trigrams"),
    )


@registered
def trigram_similarity(spark, sf):
    other = F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.lower("p_type"), "p_brand")
    compared = table(spark, sf, "part").select("p_partkey", trgm_similarity(F.col("p_name"), other).alias("s"))
    return compared.select(
        "p_partkey", F.round("s", 6).alias("similarity"), F.round(1 - F.col("s"), 6).alias("distance")
    )


@registered
def cosine_distances(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    distance = cosine_distance(F.col("embedding"), F.col("next"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(distance, 6).alias("distance"))


@registered
def normalized_vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    units = table(spark, sf, "embeddings").select("vec_id", l2_normalize(scaled).alias("unit"))
    return units.select(
        "vec_id", F.round(norm(F.col("unit")), 6).alias("length"), F.posexplode("unit").alias("place", "value")
    ).withColumn("value", F.round("value", 6) + F.lit(0.0))


@registered
def wrong_dims(spark, sf):
    cut = F.slice("embedding", F.lit(1), 60 + F.col("vec_id").cast("int") % 5)
    vectors = table(spark, sf, "embeddings").select("vec_id", cut.alias("embedding"))
    return check_dims(vectors, "embedding", 64).select("vec_id", F.size("embedding").alias("n"))


@registered
def rrf_scores(spark, sf):
    lines = table(spark, sf, "lineitem")
    vec_rank = F.col("l_linenumber")
    lex_rank = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int"))
    return lines.select(
        "l_orderkey", "l_linenumber", F.round(rrf_score(vec_rank, lex_rank), 9).alias("rrf_score")
    )


# --- encoders --------------------------------------------------------------


@registered
def embed_hashed(spark, sf):
    docs = embed(documents(spark, sf), "text", HashedTrigramEncoder(64))
    values = docs.select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return values.where(F.col("value") != 0).select("doc_id", "slot", F.col("value").cast("double").alias("value"))


@registered
def embed_both(spark, sf):
    encoders = {"embedding": None, "embedding_local": HashedTrigramEncoder(32)}
    made = embed_many(item_rows(spark, sf).withColumn("content", content_of_items()), "content", encoders)
    return made.select(
        "item_id",
        F.col("embedding").isNull().alias("no_hosted"),
        F.size("embedding_local").alias("dims"),
        F.round(norm(F.col("embedding_local")), 4).alias("length"),
    )


# --- nearest vectors -------------------------------------------------------


@registered
def nearest_to_one(spark, sf):
    items = items_view(spark, sf)
    vector = table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]
    return nearest_items(items, vector, POOL, Filters(min_def=1000))


@registered
def knn_all(spark, sf):
    return knn_join(queries_view(spark, sf), items_view(spark, sf), KNN_K)


@registered
def vector_topk_filtered(spark, sf):
    return vector_topk(prepare_queries(queries_view(spark, sf)), items_view(spark, sf), KNN_K)


@registered
def vector_topk_grid(spark, sf):
    """The way for query tables too large to send around."""
    prepared = prepare_queries(queries_view(spark, sf))
    return vector_topk(prepared, items_view(spark, sf), KNN_K, force_grid=True)


@registered
def vector_topk_other_column(spark, sf):
    """Ranking by the second vector column, filled from the item names."""
    encoder = HashedTrigramEncoder(32)
    items = embed(items_view(spark, sf), "name", encoder, "embedding_local")
    queries = embed(item_names(spark, sf), "query", encoder, "query_vec")
    return vector_topk(queries, items, KNN_K, vector_col="embedding_local")


def item_names(spark: SparkSession, sf: str) -> DataFrame:
    """One query per distinct name; its id is the first item's."""
    return item_rows(spark, sf).groupBy(F.col("name").alias("query")).agg(F.min("item_id").alias("query_id"))


@registered
def ivf_exact(spark, sf):
    index = ivf_build(items_view(spark, sf), 16, fresh_folder(spark, "lists"))
    return ivf_topk(prepare_queries(queries_view(spark, sf)), index, KNN_K, nprobe=3)


@registered
def ivf_recall(spark, sf):
    """Recall of all lists together, which is complete."""
    items = items_view(spark, sf).select("item_id", "embedding")
    queries = queries_view(spark, sf).select("query_id", "query_vec")
    index = ivf_build(items, 8, fresh_folder(spark, "lists"))
    approx = ivf_topk(queries, index, KNN_K, nprobe=8, exact=False)
    return recall_at_k(approx, knn_join(queries, items, KNN_K))


@registered
def ivf_codes_recall(spark, sf):
    """Filtered search of coded lists against the exact one: what of each query's list is found, and how many lists were read."""
    queries, items = prepare_queries(queries_view(spark, sf)), items_view(spark, sf)
    index = ivf_build(items, 16, fresh_folder(spark, "lists"))
    found, read = coded_topk(queries, code_build(index, fresh_folder(spark, "codes")), KNN_K, nprobe=12)
    return recall_at_k(found, vector_topk(queries, items, KNN_K)).join(read, "query_id")


# --- names -----------------------------------------------------------------


@registered
def lexical_topk(spark, sf):
    return lexical.lexical_topk(prepare_queries(queries_view(spark, sf)), item_rows(spark, sf), POOL)


@registered
def trigram_index_topk(spark, sf):
    """By posting lists; the longer lists go to the block scan."""
    items = item_rows(spark, sf)
    return lexical.trigram_topk(prepare_queries(queries_view(spark, sf)), items, POOL, max_postings=400)


# --- fusion and search -----------------------------------------------------


def rank_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    prepared = prepare_queries(queries_view(spark, sf))
    items = items_view(spark, sf)
    return vector_topk(prepared, items, POOL), lexical.lexical_topk(prepared, items, POOL)


@registered
def rrf_fuse_left(spark, sf):
    return rrf_fuse(*rank_lists(spark, sf), POOL)


@registered
def rrf_fuse_outer(spark, sf):
    return rrf_fuse(*rank_lists(spark, sf), POOL, mode="outer")


def prepared_with_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: the queries are measured, ranked and joined again."""
    return cut_lineage(with_limits(prepare_queries(queries_view(spark, sf))))


@registered
def hybrid_topk(spark, sf):
    found = hybrid_candidates(prepared_with_pool(spark, sf), items_view(spark, sf))
    return found.select("query_id", "item_id", "vec_rank", "lex_rank", "rrf_score", "rrf_rank", "name", "content")


@registered
def rerank_topk(spark, sf):
    prepared = prepared_with_pool(spark, sf)
    found = hybrid_candidates(prepared, with_held(items_view(spark, sf)), fields=("content", HELD))
    asked = with_asked(prepared.select("query_id", F.col("query").alias("search_text")))
    ranked = rerank(found.join(asked, "query_id"), 5)
    return ranked.select("query_id", "item_id", "rerank_score", "rank")


@registered
def rerank_learned(spark, sf):
    """A scorer learned on the pairs of three quarters of the queries, and whether it puts an item of the right name first for each query."""
    prepared = prepared_with_pool(spark, sf)
    held = with_held(items_view(spark, sf), PAIR_PARTS)
    asked = with_asked(prepared.select("query_id", "search_text"), PAIR_PARTS)
    found = hybrid_candidates(prepared, held, fields=("name", "content", HELD)).join(asked, "query_id")
    marked = found.withColumns({"label": F.startswith("search_text", "name").cast("int"), "held_out": F.col("query_id") % 4 == 0})
    judged = cut_lineage(marked)
    best = rerank(judged, 1, fit_pair_model(judged.where("not held_out")))
    return judged.groupBy("query_id", "held_out").agg(F.max("label").alias("held_right")).join(
        best.select("query_id", F.col("label").alias("first_is_right")), "query_id"
    )


@registered
def hybrid_search_full(spark, sf):
    ranked = hybrid_search(queries_view(spark, sf), items_view(spark, sf), limit=None)
    return ranked.select("query_id", "item_id", "rrf_rank", "rerank_score", "rank")


@registered
def search_reports(spark, sf):
    return search_report(queries_view(spark, sf), items_view(spark, sf))


@registered
def search_reports_cli(spark, sf):
    return search_report(queries_view(spark, sf), items_view(spark, sf), style="cli")


@registered
def search_prompts(spark, sf):
    return context_prompts(queries_view(spark, sf), items_view(spark, sf))


# --- reports over plain tables ---------------------------------------------


def ranked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as its ranked results."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return table(spark, sf, "lineitem").join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").cast("int").alias("rank"),
        "name",
        F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("content"),
    )


def orders_as_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query")
    )


@registered
def format_results(spark, sf):
    return reports.format_results(ranked_lines(spark, sf), orders_as_queries(spark, sf))


@registered
def lookup_report(spark, sf):
    index = item_rows(spark, sf).withColumn("content", content_of_items()).withColumnRenamed("item_id", "item_key")
    keys = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("item_key") * 3)
    return reports.lookup_report(keys.toDF("item_key"), index, attribute="attribute")


@registered
def build_context(spark, sf):
    return reports.build_context(ranked_lines(spark, sf))


@registered
def build_prompts(spark, sf):
    return reports.build_prompts(orders_as_queries(spark, sf), reports.build_context(ranked_lines(spark, sf)))


# --- keyed changes ---------------------------------------------------------


def stored_customers(spark: SparkSession, sf: str) -> DataFrame:
    """An index that lacks some customers, holds others stale, others without a hash."""
    key = F.col("c_custkey").cast("bigint")
    rows = table(spark, sf, "customer").where(key % 10 != 0)
    digest = content_hash(F.concat_ws("|", "c_name", "c_mktsegment"))
    return rows.select(
        key.alias("item_key"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("level"),
        F.when(key % 10 == 1, F.lit("old")).when(key % 10 != 2, digest).alias("content_hash"),
        F.when(key % 3 != 0, F.array(F.col("c_acctbal").cast("float"))).alias("embedding"),
    )


def customer_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the orders say about customers: known and unknown keys, some fields empty."""
    orders = table(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("item_key"), F.col("o_orderdate").alias("modified_at"),
        F.col("o_orderkey").cast("string").alias("path"), "o_orderpriority", "o_totalprice", "o_orderkey",
    )
    last = merge.latest_per_key(orders)
    return last.select(
        "item_key",
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 100).cast("int")).alias("level"),
        F.lit("new").alias("content_hash"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_totalprice").cast("float"))).alias("embedding"),
    )


def flat_index(index: DataFrame) -> DataFrame:
    return index.select(
        "item_key", "name", "level", "content_hash",
        F.round(F.element_at("embedding", 1).cast("double"), 2).alias("vector"),
    )


def source_customers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("bigint")
    return table(spark, sf, "customer").select(
        F.when(key % 10 != 3, key).alias("item_key"),
        content_hash(F.concat_ws("|", "c_name", "c_mktsegment")).alias("content_hash"),
    )


@registered
def changed_rows(spark, sf):
    return merge.changed_rows(source_customers(spark, sf), stored_customers(spark, sf))


@registered
def changed_rows_require_vectors(spark, sf):
    return merge.changed_rows(
        source_customers(spark, sf), stored_customers(spark, sf), require_vectors=["embedding"]
    )


@registered
def rejected_rows(spark, sf):
    return merge.reject_missing_key(source_customers(spark, sf))[1].select("content_hash")


@registered
def merge_upsert(spark, sf):
    return flat_index(
        merge.merge_upsert(stored_customers(spark, sf), customer_changes(spark, sf), keep_if_null=["embedding"])
    )


@registered
def merge_upsert_large(spark, sf):
    """The full outer join used for change tables too large to send around."""
    return flat_index(
        merge.merge_upsert(
            stored_customers(spark, sf), customer_changes(spark, sf), keep_if_null=["embedding"], small=False
        )
    )


def cancelled(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return orders.where(F.col("o_totalprice") > 400_000).select((F.col("o_custkey") * 2).alias("item_key"))


@registered
def merge_delete(spark, sf):
    return flat_index(merge.merge_delete(stored_customers(spark, sf), cancelled(spark, sf)))


@registered
def missing_tombstones(spark, sf):
    return merge.missing_tombstones(stored_customers(spark, sf), cancelled(spark, sf))


@registered
def latest_per_key(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("item_key"), F.col("o_orderdate").alias("modified_at"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), "o_totalprice",
    )
    return merge.latest_per_key(orders).select("item_key", "path", "o_totalprice")


@registered
def snapshot_diff(spark, sf):
    listed = source_customers(spark, sf).where(F.col("item_key").isNotNull())
    return merge.snapshot_diff(listed, stored_customers(spark, sf))


@registered
def check_keys(spark, sf):
    keys = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("item_key"))
    return merge.check_keys(keys)


@registered
def ingest_stats(spark, sf):
    source = source_customers(spark, sf)
    return merge.ingest_stats(source, merge.changed_rows(source, stored_customers(spark, sf)))


@registered
def index_count(spark, sf):
    return merge.index_count(stored_customers(spark, sf))


@registered
def stored_hashes(spark, sf):
    return existing_hashes(stored_customers(spark, sf))


@registered
def upgraded_schema(spark, sf):
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("item_key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("level")
    )
    second = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 10_000_000).alias("item_key"), F.col("s_name").alias("name"),
        F.lit("x").alias("content_hash"),
    )
    merged = upgrade_schema(union_versions(first, second))
    return merged.select(
        "item_key", "name", "level", "atk", "content_hash", F.col("embedding").isNull().alias("no_vector")
    )


# --- documents, paths, sizes -----------------------------------------------


@registered
def parsed_documents(spark, sf):
    good, _ = split_bad_records(parse_documents(item_bodies(spark, sf)))
    return to_index_rows(good).select("path", "item_key", "level", "atk", "def_", "content", "content_hash")


@registered
def quarantined_documents(spark, sf):
    return split_bad_records(parse_documents(item_bodies(spark, sf)))[1]


def ingest_twice(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An ingest, then one of the same documents with some changed; second stats and index."""
    store = IndexStore(spark, fresh_folder(spark, "index"))
    encoders = {"embedding": None, "embedding_local": HashedTrigramEncoder(32)}
    ingest_documents(parse_documents(item_bodies(spark, sf)), store, encoders)
    again = ingest_documents(parse_documents(item_bodies(spark, sf, price_change=5)), store, encoders)
    return again.stats, store.read()


@registered
def ingest_job_stats(spark, sf):
    return ingest_twice(spark, sf)[0]


@registered
def ingest_job_index(spark, sf):
    return ingest_twice(spark, sf)[1].select(
        "item_key", "name", "level", "atk", "def_", "content_hash", F.size("embedding_local").alias("dims")
    )


# One filter on each column of the layout.
LAYOUT_FILTERS = {
    "atk": "atk between 1000 and 1009", "def_": "def_ >= 4900", "level": "level = 3", "english_attribute": "english_attribute = 'economy'",
}


@registered
def layout_scan(spark, sf):
    """A clustered snapshot read by each of its filters alone."""
    rows = item_rows(spark, sf).withColumnsRenamed({"item_id": "item_key", "attribute": "english_attribute"})
    store = IndexStore(spark, fresh_folder(spark, "index"), cluster_by=FILTERED, files=64)
    store.publish(rows)
    found = [store.read().where(rule).select(F.lit(name).alias("filter"), "item_key") for name, rule in LAYOUT_FILTERS.items()]
    return reduce(DataFrame.unionByName, found)


@registered
def path_filter(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    suffix = F.when(F.col("page_id") % 3 == 0, F.lit(".json")).when(F.col("page_id") % 3 == 1, F.lit("/.x.json"))
    paths = urls.select("page_id", F.concat("url", F.coalesce(suffix, F.lit(".JSON"))).alias("path"))
    return paths.where(path_is_item(F.col("path")))


@registered
def path_keys(spark, sf):
    stem = F.when(F.col("page_id") % 4 == 0, F.lit("draft")).otherwise(F.col("page_id").cast("string"))
    path = F.concat("url", F.lit("/"), stem, F.when(F.col("page_id") % 7 == 0, F.lit(".txt")).otherwise(F.lit(".json")))
    return table(spark, sf, "pages").select("page_id", key_from_path(path).alias("item_key"))


@registered
def size_guard(spark, sf):
    return (
        table(spark, sf, "documents")
        .where(within_size(F.col("text"), 1000))
        .select("doc_id", F.octet_length("text").alias("n_bytes"))
    )


@registered
def size_guard_pages(spark, sf):
    return table(spark, sf, "pages").where(within_size(F.col("html"))).select("page_id")


@registered
def empty_directory_stats(spark, sf):
    """A directory that was emptied: the index stays as it is, and the job has no statuses to report."""
    files, store = fresh_folder(spark, "items"), IndexStore(spark, fresh_folder(spark, "index"))
    item_files(spark, sf, files, "k = 1")
    removed_files(spark, sf, files, "k = 1")
    store.publish(table(spark, sf, "customer").select(F.col("c_custkey").alias("item_key"), F.col("c_name").alias("name")))
    result = ingest(spark, files, store, {"embedding_local": HashedTrigramEncoder(32)})
    return store.read().select("item_key", "name", F.lit(result.documents.count()).cast("bigint").alias("n_documents"))


class RefusingEncoder(HashedTrigramEncoder):
    """Fails for each batch that holds a text with a given word."""

    def load(self):
        encode = HashedTrigramEncoder.load(self)

        def careful(texts):
            if any(" red " in text for text in texts):
                raise RuntimeError("refused")
            return encode(texts)

        return careful


@registered
def embed_fitted(spark, sf):
    """Items encoded by an encoder fitted to all their contents."""
    items = item_rows(spark, sf).withColumn("content", content_of_items())
    made = embed(deal(items), "content", fit_encoder(items, "content", 32), "embedding_local")
    return made.select("item_id", F.posexplode("embedding_local").alias("slot", "value")).select(
        "item_id", "slot", F.round(F.col("value").cast("double"), 4).alias("value")
    )


@registered
def embed_row_by_row(spark, sf):
    """Batches that fail are encoded row by row: only rows that fail themselves go without a vector."""
    made = embed(item_rows(spark, sf), "name", RefusingEncoder(32), "vector", error_col="problem")
    return made.select("item_id", F.coalesce(F.size("vector"), F.lit(-1)).alias("dims"), "problem")


# --- events ----------------------------------------------------------------


@registered
def event_changes(spark, sf):
    changes = normalize_events(events_as_changes(spark, sf), "event_id")
    return changes.select("event_id", "op", "path", "debounce_type")


@registered
def retained_moves(spark, sf):
    return ignored_moves(events_as_changes(spark, sf)).select(
        "src_path", "dest_path", F.unix_micros("ts").alias("us")
    )


@registered
def debounced_events(spark, sf):
    kept = debounce(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 6 * HOUR_US, "event_id", stretch=8)
    return kept.select("event_id", "user_id", "event_type")


@registered
def debounced_hot_key(spark, sf):
    """All events on one key: its chain is composed of many stretches over several levels."""
    one = table(spark, sf, "events").withColumn("k", F.lit(1))
    return debounce(one, ["k"], "ts", HOUR_US, "event_id", stretch=8, fan=4).select("event_id", "user_id", "event_type")


@registered
def debounced_changes(spark, sf):
    """Normalised and debounced file events; deletions are all kept."""
    changes = normalize_events(events_as_changes(spark, sf), "event_id")
    upserts = changes.where(F.col("op") == "upsert")
    kept = debounce(upserts, ["path", "debounce_type"], "ts", 6 * HOUR_US, "event_id")
    return kept.unionByName(changes.where(F.col("op") == "delete")).select("event_id", "op", "path")


@registered
def debounced_stream(spark, sf):
    """The streaming job over the event table, run to its end and read back."""
    columns = T.StructType(
        [
            T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        ]
    )
    events = spark.readStream.schema(columns).option("pathGlobFilter", "events.parquet").parquet(sf)
    changes = events.select(
        F.lit("upsert").alias("op"), F.col("user_id").cast("string").alias("path"),
        F.col("event_type").alias("debounce_type"), utc("ts").alias("ts"),
    )
    hours6 = 6 * 3_600_000
    kept = debounce_stream(changes, hours6, 2 * hours6)
    out, state = fresh_folder(spark, "kept"), fresh_folder(spark, "state")
    run = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    with stream_settings(spark):
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("path", "debounce_type", F.unix_micros("ts").alias("us"))


def change_stream(spark: SparkSession, sf: str) -> IndexStore:
    """The change stream over item files, in three runs whose events are not in order of time.

    The window is a millisecond: what a later run holds back depends on when it
    runs, because state expires by arrival. ``debounced_stream`` is about windows.
    """
    files, logs, state = (fresh_folder(spark, name) for name in ("items", "log", "state"))
    store = IndexStore(spark, fresh_folder(spark, "index"))
    item_files(spark, sf, files)
    changes = item_changes(spark, sf, files)
    with stream_settings(spark):
        for log in range(3):
            changes.where(F.col("log") == log).drop("log").write.mode("append").json(logs)
            stream = watch(read_change_log(spark, logs), store, {"embedding_local": HashedTrigramEncoder(32)}, state, window_ms=1)
            stream.trigger(availableNow=True).start().awaitTermination()
    return store


@registered
def change_stream_index(spark, sf):
    return change_stream(spark, sf).read().select("item_key", "name", "atk", "content_hash")


@registered
def change_stream_failures(spark, sf):
    listed = read_failures(spark, change_stream(spark, sf))
    return listed.groupBy(F.split_part("path", F.lit("/"), F.lit(-1)).alias("file"), "reason").agg(F.count("*").alias("n"))


@registered
def reconcile_index(spark, sf):
    """An index of customers becomes one of the item files; a file that cannot be read keeps what is stored under its name."""
    folder, store = fresh_folder(spark, "items"), IndexStore(spark, fresh_folder(spark, "index"))
    item_files(spark, sf, folder)
    store.publish(table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("item_key"), F.col("c_name").alias("name")))
    reconcile(spark, folder, store, {"embedding_local": HashedTrigramEncoder(32)})
    return store.read().select("item_key", "name", "atk", "content_hash")


@registered
def reconcile_digests(spark, sf):
    """An index follows a directory by digests: all files, then some rewritten, some gone, and some rows lost from the index."""
    folder, manifest = fresh_folder(spark, "items"), fresh_folder(spark, "manifest")
    store = IndexStore(spark, fresh_folder(spark, "index"))
    encoders = {"embedding_local": HashedTrigramEncoder(32)}
    store.publish(table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("item_key"), F.col("c_name").alias("name")))
    item_files(spark, sf, folder)
    digests.reconcile_digests(spark, folder, store, encoders, manifest, buckets=16)
    item_files(spark, sf, folder, "k % 4 = 0 and k % 3 != 0", price_change=5)
    removed_files(spark, sf, folder, "k % 10 = 9")
    lost = item_rows(spark, sf).select(F.col("item_id").alias("item_key")).where("item_key % 50 = 3")
    store.apply(store.read().where("false"), lost)
    digests.reconcile_digests(spark, folder, store, encoders, manifest, buckets=16)
    return store.read().select("item_key", "name", "atk", "content_hash")


PATH_NUMBER = "cast(regexp_extract(path, '[0-9]+', 0) as bigint)"


@registered
def directory_stream_index(spark, sf):
    """A directory followed over three runs: files come, are rewritten, and go."""
    files, state, listings = (fresh_folder(spark, name) for name in ("items", "state", "listings"))
    store = IndexStore(spark, fresh_folder(spark, "index"))
    encoders = {"embedding_local": HashedTrigramEncoder(32)}

    def follow() -> None:
        events = read_directory_changes(spark, files, listings)
        watch(events, store, encoders, state, window_ms=None).trigger(availableNow=True).start().awaitTermination()

    item_files(spark, sf, files, "k % 3 != 0")
    follow()
    item_files(spark, sf, files, "k % 4 = 0 and k % 3 != 0", price_change=5)
    item_files(spark, sf, files, "k % 3 = 0")
    follow()
    removed_files(spark, sf, files, "k % 10 = 9")
    follow()
    return store.read().select("item_key", "name", "atk", "content_hash")


@registered
def ingest_then_watch_index(spark, sf):
    """Jobs and a stream take turns at one index: a snapshot, an ingest, a stream batch, another ingest, another batch."""
    files, logs, state = (fresh_folder(spark, name) for name in ("items", "log", "state"))
    store = IndexStore(spark, fresh_folder(spark, "index"))
    encoders = {"embedding_local": HashedTrigramEncoder(32)}

    def follow(kind: str, which: str) -> None:
        path = F.concat(F.lit(f"{files}/"), F.col("p_partkey").cast("string"), F.lit(".json"))
        heard = table(spark, sf, "part").where(which).select(
            F.lit(kind).alias("event_type"), path.alias("src_path"), F.lit(None).cast("string").alias("dest_path"),
            F.lit(False).alias("is_directory"), F.lit("2030-01-01T00:00:00Z").alias("ts"),
        )
        heard.write.mode("append").json(logs)
        stream = watch(read_change_log(spark, logs), store, encoders, state, window_ms=1)
        stream.trigger(availableNow=True).start().awaitTermination()

    store.publish(table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("item_key"), F.col("c_name").alias("name")))
    ingest_documents(parse_documents(item_bodies(spark, sf).where(f"{PATH_NUMBER} % 3 != 0")), store, encoders)
    item_files(spark, sf, files, "k % 3 = 0")
    with stream_settings(spark):
        follow("created", "p_partkey % 3 = 0")
        changed = item_bodies(spark, sf, price_change=5).where(f"{PATH_NUMBER} % 4 = 0 and {PATH_NUMBER} % 3 != 0")
        ingest_documents(parse_documents(changed), store, encoders)
        follow("deleted", "p_partkey % 10 = 9")
    return store.read().select("item_key", "name", "atk", "content_hash")
