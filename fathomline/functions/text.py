"""Column functions for content text, hashing and lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels, separator and order of the content text.
CONTENT_SEPARATOR = " | "
LABEL_NAME = "Name: "
LABEL_ATTRIBUTE = "Attribute: "
LABEL_LEVEL = "Level: "
LABEL_ATK = "ATK: "
LABEL_DEF = "DEF: "
LABEL_PROPERTIES = "PROPERTIES: "
LABEL_DESCRIPTION = "Description: "

# What Python counts as white space beyond the Unicode White_Space property.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none is left at either end."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def clean_int(value: Column) -> Column:
    """Integer written in a string, NULL where the string is no integer.

    Accepts blanks around the number, a sign, and single underscores between
    digits. ``"12.7"`` is no integer.
    """
    text = F.trim(F.regexp_replace(value.cast("string"), r"\A\s+|\s+\z", ""))
    digits = F.when(text.rlike(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"), F.replace(text, F.lit("_"), F.lit("")))
    return digits.try_cast("int")


def quote_text(value: Column) -> Column:
    """One string in single quotes; double quotes if it holds only single ones."""
    escaped = value
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    has_single = F.contains(value, F.lit("'"))
    has_double = F.contains(value, F.lit('"'))
    return (
        F.when(value.isNull(), F.lit("None"))
        .when(has_single & ~has_double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def render_list(items: Column) -> Column:
    """``['Dragon', 'Effect']``; NULL stays NULL, an empty list gives ``[]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quote_text), ", "), F.lit("]"))


def labelled(label: str, value: Column) -> Column:
    """``label`` followed by the value; NULL where there is no value."""
    return F.concat(F.lit(label), value.cast("string"))


def build_content(
    name: Column,
    attribute: Column,
    level: Column,
    atk: Column,
    def_: Column,
    properties: Column,
    effect: Column,
) -> Column:
    """The text that is hashed and embedded.

    Empty attribute and effect are left out, a zero number is kept, and a
    missing name prints as ``None``. ``concat_ws`` drops the NULL parts.
    """
    return F.concat_ws(
        CONTENT_SEPARATOR,
        labelled(LABEL_NAME, F.coalesce(name, F.lit("None"))),
        labelled(LABEL_ATTRIBUTE, F.nullif(attribute, F.lit(""))),
        labelled(LABEL_LEVEL, level),
        labelled(LABEL_ATK, atk),
        labelled(LABEL_DEF, def_),
        labelled(LABEL_PROPERTIES, render_list(properties)),
        labelled(LABEL_DESCRIPTION, F.nullif(effect, F.lit(""))),
    )


def content_hash(content: Column) -> Column:
    """SHA-256 of the UTF-8 bytes as 64 lower-case hex digits."""
    return F.sha2(content, 256)
