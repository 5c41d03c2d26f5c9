"""Which paths are items, and which key a path stands for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix of item files and the largest file that is read.
ITEM_SUFFIX = ".json"
MAX_ITEM_BYTES = 50 * 1024


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_is_item(path: Column) -> Column:
    """A file with exactly the item suffix that is not hidden."""
    name = file_name(path)
    return F.coalesce(name.endswith(ITEM_SUFFIX) & ~name.startswith("."), F.lit(False))


def key_from_path(path: Column) -> Column:
    """The number a file is named by; NULL if its stem is no number.

    The pattern is anchored at both ends of the name, so it takes one pass however long the path is.
    """
    digits = F.regexp_extract(F.substring_index(path, "/", -1), r"\A *([+-]?[0-9]+(?:_[0-9]+)*) *\.json\z", 1)
    return F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint")


def within_size(text: Column, limit: int = MAX_ITEM_BYTES) -> Column:
    """At most ``limit`` bytes of UTF-8."""
    return F.octet_length(text) <= limit
