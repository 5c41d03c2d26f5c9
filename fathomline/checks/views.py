"""The driver's tables seen as items, queries and changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.checks.phrases import CASES
from fathomline.functions.text import build_content
from fathomline.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str) -> Column:
    """A timestamp without a zone as the instant it is in UTC."""
    return F.concat(F.col(column).cast("string"), F.lit("Z")).cast("timestamp")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts over all cores; a text is much work for its size."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the ``part`` table, without vectors."""
    properties = F.when(
        F.coalesce(F.col("p_type") != "PROMO", F.lit(True)),
        F.array("p_brand", F.split_part("p_name", F.lit(" "), F.lit(2))),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") <= 12, F.col("p_size")).alias("level"),
        F.floor("p_retailprice").cast("int").alias("atk"),
        (F.col("p_size") * 100).alias("def_"),
        F.lower("p_type").alias("attribute"),
        properties.alias("properties"),
    )


def content_of_items():
    return build_content(
        F.col("name"), F.col("attribute"), F.col("level"), F.col("atk"), F.col("def_"), F.col("properties"),
        F.lit(None).cast("string"),
    )


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items; about a quarter of them, or fewer, has a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    rows = spread(item_rows(spark, sf_dir)).join(vectors, "item_id", "left")
    return rows.withColumn("content", content_of_items())


def queries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per item that has a vector, with filters that vary by id."""
    qid = F.col("item_id")
    vectors = spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"))
    # Merged: the items outgrow what their compressed files promise.
    held = item_rows(spark, sf_dir).join(vectors.hint("merge"), "item_id")

    def on(modulus: int, rest: int, value, kind: str):
        return F.when(qid % modulus == rest, value).cast(kind)

    return held.select(
        qid.alias("query_id"),
        F.concat("name", F.lit(" with more than "), F.col("atk").cast("string"), F.lit(" ATK")).alias("query"),
        F.col("embedding").alias("query_vec"),
        F.lit(None).cast("bigint").alias("min_atk"),
        on(3, 0, F.col("atk") + 100, "bigint").alias("max_atk"),
        on(5, 1, F.lit(1000), "bigint").alias("min_def"),
        on(5, 2, F.lit(3000), "bigint").alias("max_def"),
        on(7, 3, F.col("level"), "bigint").alias("level"),
        on(5, 3, F.col("attribute"), "string").alias("attribute"),
        on(5, 4, F.element_at("properties", 2), "string").alias("card_type"),
        (F.col("def_") / 50 - 5).cast("int").alias("limit"),
    )


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's name followed by one of the phrases, with numbers of the item."""
    phrases = F.array(*[F.lit(case[0]) for case in CASES])
    phrase = F.element_at(phrases, (F.col("item_id") % len(CASES) + 1).cast("int"))
    filled = F.replace(
        F.replace(phrase, F.lit("{a}"), F.col("atk").cast("string")),
        F.lit("{b}"), (F.col("atk") + F.col("def_")).cast("string"),
    )
    return item_rows(spark, sf_dir).select(
        F.col("item_id").alias("query_id"), F.concat("name", F.lit("  "), filled).alias("query")
    )


def events_as_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as file events, some of them of directories and other files."""
    kind = (
        F.when(F.col("event_type") == "click", F.lit("created"))
        .when(F.col("event_type") == "view", F.lit("modified"))
        .when(F.col("event_type") == "purchase", F.lit("moved"))
        .when(F.col("event_type") == "error", F.lit("deleted"))
        .otherwise(F.lit("opened"))
    )
    user = F.col("user_id").cast("string")
    suffix = F.when(F.col("event_id") % 11 == 0, F.lit(".txt")).otherwise(F.lit(".json"))
    hidden = F.when(F.col("event_id") % 13 == 0, F.lit(".")).otherwise(F.lit(""))
    return table(spark, sf_dir, "events").select(
        "event_id",
        kind.alias("event_type"),
        F.concat(F.lit("/w/"), hidden, user, suffix).alias("src_path"),
        F.when(kind == "moved", F.concat(F.lit("/w/old/"), user, suffix)).alias("dest_path"),
        (F.col("event_id") % 17 == 0).alias("is_directory"),
        utc("ts").alias("ts"),
    )


def item_bodies(spark: SparkSession, sf_dir: str, price_change: int = 0) -> DataFrame:
    """Items as JSON documents: some without a key, some cut short, numbers in several forms."""
    rows = spread(item_rows(spark, sf_dir))
    key = F.col("item_id")
    atk = F.col("atk") + F.when(key % 4 == 0, F.lit(price_change)).otherwise(F.lit(0))
    atk_text = (
        F.when(key % 6 == 1, F.concat(F.lit('"'), atk.cast("string"), F.lit('"')))
        .when(key % 6 == 2, F.concat(atk.cast("string"), F.lit(".7")))
        .when(key % 6 == 3, F.lit('"unknown"'))
        .otherwise(atk.cast("string"))
    )
    head = F.when(key % 19 == 5, F.lit("{")).otherwise(F.concat(F.lit('{"id": '), key.cast("string"), F.lit(", ")))
    body = F.concat(
        head,
        F.lit('"name": "'), F.col("name"), F.lit('", "englishAttribute": "'), F.col("attribute"),
        F.lit('", "atk": '), atk_text,
        F.lit(', "def": '), F.col("def_").cast("string"),
        F.when(F.col("level").isNotNull(), F.concat(F.lit(', "level": '), F.col("level").cast("string"))).otherwise(
            F.lit("")
        ),
        F.when(
            F.col("properties").isNotNull(),
            F.concat(F.lit(', "properties": '), F.to_json("properties")),
        ).otherwise(F.lit("")),
        F.when(key % 23 == 7, F.lit("")).otherwise(F.lit("}")),
    )
    return rows.select(
        F.concat(F.lit("/items/"), key.cast("string"), F.lit(".json")).alias("path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified_at"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        body.alias("body"),
    )


def item_files(spark: SparkSession, sf_dir: str, folder: str, keep: str = "true", price_change: int = 0) -> None:
    """Writes each document of ``item_bodies`` whose number k passes ``keep`` as a file of its own; some are made too large by blanks."""
    numbered = item_bodies(spark, sf_dir, price_change).withColumn("k", F.regexp_extract("path", "[0-9]+", 0).cast("bigint"))
    bodies = numbered.where(keep).select(
        F.split_part("path", F.lit("/"), F.lit(-1)).alias("name"),
        F.when(F.col("k") % 29 == 3, F.rpad("body", 60_000, " ")).otherwise(F.col("body")).alias("body"),
    )

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for part in parts:
            for name, body in zip(part["name"], part["body"]):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(body.encode("utf-8"))
            yield pd.DataFrame({"n": [len(part)]})

    bodies.mapInPandas(write, "n bigint").write.format("noop").mode("overwrite").save()


def removed_files(spark: SparkSession, sf_dir: str, folder: str, gone: str) -> None:
    """Deletes the files of the documents whose number k passes ``gone``."""
    names = item_rows(spark, sf_dir).select(F.col("item_id").alias("k")).where(gone)

    def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for part in parts:
            for k in part["k"]:
                path = f"{base}/{k}.json"
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
            yield pd.DataFrame({"n": [len(part)]})

    names.mapInPandas(remove, "n bigint").write.format("noop").mode("overwrite").save()


def item_changes(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The event table as a change log of item files, four events an item, with the log (of three) each is written to."""
    kind = (
        F.when(F.col("event_type") == "click", F.lit("created")).when(F.col("event_type") == "view", F.lit("modified"))
        .when(F.col("event_type") == "purchase", F.lit("moved")).when(F.col("event_type") == "error", F.lit("deleted"))
        .otherwise(F.lit("opened"))
    )
    suffix = F.when(F.col("event_id") % 11 == 0, F.lit(".txt")).otherwise(F.lit(".json"))
    path = F.concat(F.lit(folder + "/"), F.floor(F.col("event_id") / 4).cast("string"), suffix)
    moved = kind == "moved"
    return table(spark, sf_dir, "events").select(
        kind.alias("event_type"),
        F.when(moved, F.lit("/w/old.json")).otherwise(path).alias("src_path"),
        F.when(moved, path).alias("dest_path"),
        (F.col("event_id") % 17 == 0).alias("is_directory"),
        F.date_format(utc("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
        (F.col("event_id") % 3).alias("log"),
    )
