"""Text for readers: result lists, single items, context and prompts.

A query has at most as many results as its limit, so the texts of one query are
gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.text import render_list

# Wording of the reports.
NOTHING_FOUND = "No cards found matching your query."
NOT_FOUND = "Card with ID {} not found."
CLI_RULE = "-" * 60


def in_rank_order(rank: str, line: Column, separator: str) -> Column:
    """Aggregate: the lines of a group joined by rank."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), separator)


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def format_results(ranked: DataFrame, queries: DataFrame, style: str = "tool") -> DataFrame:
    """``query_id, n_results, report``; one row per query, also without results.

    ``tool`` writes a header, a numbered name and the indented content of each
    result, each followed by an empty line. ``cli`` rules off the results.
    """
    number, name, content = F.col("rank").cast("string"), _shown(F.col("name")), _shown(F.col("content"))
    if style == "tool":
        entry = F.concat(number, F.lit(". "), name, F.lit("\n   "), content, F.lit("\n"))
    elif style == "cli":
        entry = F.concat(number, F.lit(". "), name, F.lit("\n   "), content, F.lit("\n" + CLI_RULE))
    else:
        raise ValueError(f"style must be 'tool' or 'cli', not {style!r}")
    body = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), in_rank_order("rank", entry, "\n").alias("body")
    )
    n = F.coalesce("n", F.lit(0))
    count = n.cast("string")
    if style == "tool":
        header = F.concat(F.lit("Top "), count, F.lit(" results for: "), _shown(F.col("query")))
        report = F.when(n == 0, F.lit(NOTHING_FOUND)).otherwise(F.concat(header, F.lit("\n\n"), F.col("body")))
    else:
        header = F.concat(F.lit("Top "), count, F.lit(" Results:\n"))
        report = F.concat_ws("\n", header, F.col("body"))
    return queries.select("query_id", "query").join(body, "query_id", "left").select(
        "query_id", n.cast("bigint").alias("n_results"), report.alias("report")
    )


def lookup_report(keys: DataFrame, index: DataFrame, key: str = "item_key", attribute: str = "english_attribute") -> DataFrame:
    """``key, report`` for each wanted key, found or not."""
    fields = index.select(
        key, "name", "content", "level", "atk", "def_", F.col(attribute).alias("attribute"), "properties",
        F.lit(True).alias("__found"),
    )
    before, after = NOT_FOUND.split("{}")
    missing = F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after))
    numbers = F.concat(
        F.lit("Level: "), _shown(F.col("level")), F.lit(" | ATK: "), _shown(F.col("atk")),
        F.lit(" | DEF: "), _shown(F.col("def_")),
    )
    found = F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), _shown(F.col("name"))),
        F.concat(F.lit("Content: "), _shown(F.col("content"))),
        numbers,
        F.concat(F.lit("Attribute: "), _shown(F.col("attribute"))),
        F.concat(F.lit("Properties: "), _shown(render_list(F.col("properties")))),
    )
    return keys.select(key).join(fields, key, "left").select(
        key, F.when(F.col("__found"), found).otherwise(missing).alias("report")
    )


def build_context(ranked: DataFrame) -> DataFrame:
    """``query_id, context``: one ``- name: content`` line per result, by rank."""
    line = F.concat(F.lit("- "), _shown(F.col("name")), F.lit(": "), _shown(F.col("content")))
    return ranked.groupBy("query_id").agg(in_rank_order("rank", line, "\n").alias("context"))


PROMPT_HEAD = "Answer a question about catalogue items.\nQuestion: "
PROMPT_BODY = (
    "\n\nDescribe the most relevant of the items below and use their text. "
    "State nothing that the items do not say. "
    "If no item is listed, answer that none was found.\n\nItems:\n"
)


def build_prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """``query_id, prompt``: the question as it was asked, and its context."""
    text = F.concat(
        F.lit(PROMPT_HEAD), _shown(F.col("query")), F.lit(PROMPT_BODY), F.coalesce("context", F.lit("")), F.lit("\n")
    )
    return queries.select("query_id", "query").join(context, "query_id", "left").select(
        "query_id", text.alias("prompt")
    )
