"""Trigram sets and their similarity, after the public pg_trgm definition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fathomline.functions.binding import let

# Fixed value: the public default of the similarity threshold.
DEFAULT_THRESHOLD = 0.3


def padded_words(text: Column) -> Column:
    """Lower-cased words, each with two blanks before it and one after it.

    The string is meant for windows of three characters; windows that straddle
    two words are the ones whose last two characters are blanks.
    """
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit("  "), words, F.lit(" ")))


def trigram_windows(text: Column) -> Column:
    """All trigrams of all words, in order and with repeats."""
    return _windows(padded_words(text))


def _windows(padded: Column) -> Column:
    return F.regexp_extract_all(padded, F.lit(r"(?s)(?=(..[^ ]|.[^ ] ))"), F.lit(1))


def trigrams(text: Column) -> Column:
    """The set of trigrams of ``text``; NULL stays NULL, no word gives an empty set."""
    return F.array_distinct(trigram_windows(text))


def held_trigrams(wanted: Column, padded: Column) -> Column:
    """Those of ``wanted``, the trigrams of another text, that are trigrams of a text with these ``padded_words``.

    They are looked up in the padded words, so that no set is built of them. No
    trigram ends in two blanks; wherever one stands it is a trigram of a word.
    """
    # A question mark stands for half of a character beyond 16 bits, which the padded words do not show.
    halved = F.exists(wanted, lambda gram: F.contains(gram, F.lit("?")))
    looked_up = F.filter(wanted, lambda gram: F.contains(padded, gram))
    return F.when(halved, F.array_intersect(wanted, F.array_distinct(_windows(padded)))).otherwise(looked_up)


def set_similarity(left: Column, right: Column) -> Column:
    """Shared over all trigrams of two sets; 0 when both are empty."""

    def ratio(shared: Column, total: Column) -> Column:
        return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)

    def compare(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        similarity = let(shared, lambda n: ratio(n, F.size(a) + F.size(b) - n))
        return F.when(a.isNotNull() & b.isNotNull(), similarity)

    return let(left, lambda a: let(right, lambda b: compare(a, b)))


def trgm_similarity(left: Column, right: Column) -> Column:
    return set_similarity(trigrams(left), trigrams(right))


def trgm_distance(left: Column, right: Column) -> Column:
    return 1 - trgm_similarity(left, right)
