"""Numeric bounds written inside free-text queries, in English and Portuguese.

A text is cut into lexemes: known phrases, numbers, blanks, other words, single
characters. A table gives each lexeme a letter for what it means. From every
number the lexemes are then walked outwards: to the nearest phrase on its left,
over a unit on its right, to the nearest suffix. What a phrase means, on which
side of the number it stands and how near, is said once, in ``SENSES``. The
strongest kind in the text decides, then the first place. Everything is a
column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.binding import let
from fathomline.functions.text import collapse_spaces

# The words and phrases the queries use.
KEYWORDS = ("atk", "ataque", "attack", "attack power", "pontos de ataque")
EQUALITY_KEYWORDS = ("atk", "ataque", "attack power", "pontos de ataque")
RANGE_OPENERS = ("between", "entre")
RANGE_SEPARATORS = ("até", "and", "e", "to", "a", "-")
MIN_SIGNS = (">=", ">", "≥")
MAX_SIGNS = ("<=", "<", "≤")
MIN_PHRASES = (
    "more than", "over", "above", "greater than", "at least", "no less than", "not less than",
    "exceeding", "exceeds", "minimum", "minimum of",
    "mais de", "acima de", "maior que", "pelo menos", "no mínimo", "no minimo",
    "mínimo", "mínimo de", "minimo", "minimo de",
)
MAX_PHRASES = (
    "under", "below", "at most", "no more than", "maximum", "maximum of",
    "abaixo de", "menor que", "no máximo", "no maximo", "máximo", "máximo de", "maximo", "maximo de",
)
MAX_PHRASES_NOT_NEGATED = ("less than", "menos de")
MIN_SUFFIXES = ("or more", "ou mais")
MAX_SUFFIXES = ("or less", "ou menos")
EXACT_WORDS = ("exactly",)
EQUALITY_LINKS = ("igual a", "equal to", "equals", "equal", "de", "of")
VAGUE_WORDS = ("up to", "about", "around", "approximately", "approx")
PREPOSITIONS = ("de", "of")

# Case folding and classes must be Unicode-aware, or upper-case accents are missed.
FLAGS = "(?isuU)"
LETTERS = r"\p{L}\p{M}_"

# What a lexeme means. A phrase stands under the last letter that lists it; "no over" is no lower bound.
PHRASES = {
    "w": tuple(f"no {p}" for p in MIN_PHRASES) + tuple(f"{n} {p}" for n in ("no", "not") for p in MAX_PHRASES_NOT_NEGATED),
    "b": RANGE_OPENERS,
    "s": RANGE_SEPARATORS[:-1],
    "L": MIN_PHRASES,
    "U": MAX_PHRASES + MAX_PHRASES_NOT_NEGATED,
    "M": MIN_SUFFIXES,
    "m": MAX_SUFFIXES,
    "x": EXACT_WORDS,
    "q": EQUALITY_LINKS,
    "p": PREPOSITIONS,
    "z": VAGUE_WORDS,
    "c": ("com",),
    "i": ("with",),
}
SIGNS = {"l": MIN_SIGNS, "u": MAX_SIGNS, "P": ("+",), "H": ("-",), "D": (".",), "z": ("~",)}
NUMBER, BLANK, WORD, OTHER = "n", "_", "w", "o"

LOWER, UPPER, BOTH = "lower", "upper", "both"
KINDS = {"range": BOTH, "op_min": LOWER, "op_max": UPPER, "comp_min": LOWER, "comp_max": UPPER, "eq": BOTH}

BEFORE, BEHIND = "before", "behind"
MUST, MAY, NONE = "must", "may", "none"
KEYWORD, PREPOSITION, VAGUE = ("k", "v"), ("p",), ("z",)
SUFFIX, SEPARATOR, OPENER, DOT, DASH = ("M", "m"), ("s", "H"), ("b",), ("D",), ("H",)


@dataclass(frozen=True)
class Sense:
    """What a phrase says about a number: its kind, its side, and whether a blank stands between.

    ``lead`` lists what may stand in front of a phrase and belongs to it, nearest
    first. Behind a number a unit may come first, and behind all of it another.
    """

    kind: str
    letters: tuple[str, ...]
    side: str
    gap: str
    lead: tuple[tuple[str, ...], ...] = ()


SENSES = (
    Sense("op_min", ("l",), BEFORE, MAY),
    Sense("op_min", ("P",), BEHIND, NONE),
    Sense("op_max", ("u",), BEFORE, MAY),
    Sense("comp_min", ("L",), BEFORE, MUST, (KEYWORD, ("c",))),
    Sense("comp_min", ("M",), BEHIND, MUST),
    Sense("comp_max", ("U",), BEFORE, MUST),
    Sense("comp_max", ("m",), BEHIND, MUST),
    Sense("eq", ("x",), BEFORE, MUST),
)


class Walk:
    """Steps among the letters of a text, from the number at ``at``."""

    def __init__(self, letters: Column, at: Column):
        self.letters, self.at = letters, at

    def holds(self, place: Column, kinds) -> Column:
        return F.coalesce(F.get(self.letters, place).isin(*kinds), F.lit(False))

    def over_blank(self, place: Column, step: int = 1) -> Column:
        return F.when(self.holds(place, BLANK), place + step).otherwise(place)

    def unit_from(self, place: Column) -> Column:
        """Behind the unit that begins at ``place``: a keyword, perhaps after a preposition; NULL if there is none."""
        return let(self.over_blank(place), lambda a: let(
            F.when(self.holds(a, PREPOSITION), self.over_blank(a + 1)).otherwise(a),
            lambda b: F.when(self.holds(b, KEYWORD), b + 1),
        ))

    def with_unit(self, place: Column) -> Column:
        return F.coalesce(self.unit_from(place), place)

    def led(self, place: Column, lead) -> Column:
        """Where a phrase at ``place`` begins, with the words of ``lead`` in front of it."""
        def one_more(kinds) -> Column:
            return let(place, lambda p: F.when(self.holds(p - 1, BLANK) & self.holds(p - 2, kinds), p - 2).otherwise(p))

        for kinds in lead:
            place = one_more(kinds)
        return place

    def no_suffix(self, place: Column) -> Column:
        return ~(self.holds(place, BLANK) & self.holds(place + 1, SUFFIX))

    # Each of these gives a struct of the first and the last place (exclusive) of the phrase, or NULL.

    def span(self, fits: Column, begin: Column, end: Column) -> Column:
        return F.when(fits, F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))

    def before(self, sense: Sense) -> Column:
        gap = self.holds(self.at - 1, BLANK)
        left = self.over_blank(self.at - 1, -1)
        near = gap if sense.gap == MUST else F.lit(True)
        return self.span(near & self.holds(left, sense.letters), self.led(left, sense.lead), self.with_unit(self.at + 1))

    def behind(self, sense: Sense) -> Column:
        if sense.gap == NONE:
            return self.span(self.holds(self.at + 1, sense.letters), self.at, self.with_unit(self.at + 2))
        # The suffix follows the number or its unit, after a blank.
        unit = self.unit_from(self.at + 1)
        suffix = let(unit, lambda u: F.when(self.holds(u, BLANK) & self.holds(u + 1, sense.letters), u + 1).when(
            self.holds(self.at + 2, sense.letters), self.at + 2
        ))
        return let(suffix, lambda place: self.span(
            self.holds(self.at + 1, BLANK) & place.isNotNull(), self.at, self.with_unit(place + 1)
        ))

    def between(self) -> Column:
        """Two numbers with a separator, told by an opener in front or a unit behind."""
        opened = self.holds(self.at - 1, BLANK) & self.holds(self.at - 2, OPENER)
        separator = self.over_blank(self.at + 1)
        second = let(separator, lambda s: F.when(self.holds(s, SEPARATOR), self.over_blank(s + 1)))
        return let(second, lambda n: let(self.unit_from(n + 1), lambda unit: self.span(
            self.holds(n, NUMBER) & ~self.holds(n + 1, DOT) & (opened | unit.isNotNull()),
            F.when(opened, self.at - 2).otherwise(self.at), F.coalesce(unit, n + 1),
        )))

    def named(self) -> Column:
        """A keyword in front of the number, perhaps with a word that links them."""
        left = self.over_blank(self.at - 1, -1)
        linked = let(left, lambda p: F.when(self.holds(self.at - 1, BLANK) & self.holds(p, "k"), p).when(
            self.holds(p, ("q", "p")) & self.holds(p - 1, BLANK) & self.holds(p - 2, "k"), p - 2
        ))
        return let(linked, lambda p: self.span(p.isNotNull() & self.no_suffix(self.at + 1), p, self.at + 1))

    def measured(self) -> Column:
        """A unit behind the number that is a word of its own, with nothing vague in front."""
        ended = (BLANK, OTHER, *SIGNS)
        vague = self.holds(self.over_blank(self.at - 1, -1), VAGUE)
        return let(self.unit_from(self.at + 1), lambda u: self.span(
            u.isNotNull() & self.holds(u - 2, BLANK) & (F.get(self.letters, u).isNull() | self.holds(u, ended)) & self.no_suffix(u) & ~vague,
            self.led(self.at, (("c", "i"),)), u,
        ))

    def found(self) -> list[tuple[str, Column]]:
        """Kind and span of all that can be said about the number, which is no part of a decimal; only a range may follow a dash."""
        whole = ~self.holds(self.at - 1, DOT) & ~self.holds(self.at + 1, DOT)
        plain = whole & ~self.holds(self.at - 1, DASH)
        said = [(s.kind, self.before(s) if s.side == BEFORE else self.behind(s)) for s in SENSES]
        said += [("eq", self.named()), ("eq", self.measured())]
        return [("range", F.when(whole, self.between()))] + [(kind, F.when(plain, span)) for kind, span in said]


def _any(words, gap: str = " ") -> str:
    """One of ``words``, longest first; ``gap`` stands between the words of a phrase."""
    ordered = sorted(words, key=len, reverse=True)
    return "(?:" + "|".join(gap.join(re.escape(part) for part in word.split(" ")) for word in ordered) + ")"


@dataclass(frozen=True)
class ConstraintSpec:
    """Which measured field the phrases speak about."""

    keywords: tuple[str, ...] = KEYWORDS
    equality_keywords: tuple[str, ...] = EQUALITY_KEYWORDS

    def letters(self) -> dict[str, str]:
        """The letter of each known lexeme, in lower case with single blanks."""
        known = {word: letter for table in (PHRASES, SIGNS) for letter, words in table.items() for word in words}
        return known | dict.fromkeys(self.keywords, "v") | dict.fromkeys(self.equality_keywords, "k")

    def lexeme(self) -> str:
        """Matches one lexeme after another, with nothing left between them."""
        begins, ends = f"(?<![{LETTERS}])", f"(?![{LETTERS}])"
        phrases = {word for words in PHRASES.values() for word in words}
        signs = [sign for words in SIGNS.values() for sign in words]
        return FLAGS + "|".join((
            begins + _any(self.keywords + self.equality_keywords, r"\s+"), begins + _any(phrases) + ends,
            _any(signs), "[0-9]+", r"\s+", f"[{LETTERS}]+", ".",
        ))


def constraint(text: Column, spec: ConstraintSpec = ConstraintSpec()) -> Column:
    """``struct<tier, lower, upper, rest>`` of the first phrase of the strongest kind that occurs.

    Bounds are inclusive, also for "more than". A range may be written in either
    order. ``rest`` is the text itself where nothing matched and where the
    phrase was all there was.
    """
    known = F.create_map(*[F.lit(part) for pair in spec.letters().items() for part in pair])
    kinds = list(KINDS)

    def letter(lexeme: Column) -> Column:
        kind = (
            F.when(lexeme.rlike("^[0-9]"), F.lit(NUMBER))
            .when(lexeme.rlike(r"(?U)^\s"), F.lit(BLANK))
            .when(lexeme.rlike(f"^[{LETTERS}]"), F.lit(WORD))
            .otherwise(F.lit(OTHER))
        )
        return F.coalesce(F.try_element_at(known, F.lower(F.regexp_replace(lexeme, r"(?U)\s+", " "))), kind)

    def strongest(letters: Column, at: Column) -> Column:
        """Kind, place and span of the strongest thing said about the number at ``at``; of equals the one listed first."""
        said = [
            F.when(span.isNotNull(), F.struct(
                F.lit(kinds.index(kind)).alias("rank"), at.alias("at"), F.lit(order).alias("order"), span.alias("span")
            ))
            for order, (kind, span) in enumerate(Walk(letters, at).found())
        ]
        return F.array_min(F.filter(F.array(*said), lambda x: x.isNotNull()))

    def decide(q: Column, lexemes: Column, letters: Column) -> Column:
        places = F.filter(F.transform(letters, lambda c, i: F.when(c == NUMBER, i)), lambda i: i.isNotNull())
        best = F.array_min(F.filter(F.transform(places, lambda at: strongest(letters, at)), lambda x: x.isNotNull()))
        return let(best, lambda b: outcome(q, lexemes, F.get(F.array(*map(F.lit, kinds)), b["rank"]), b["span"]["begin"], b["span"]["end"]))

    def outcome(q: Column, lexemes: Column, tier: Column, begin: Column, end: Column) -> Column:
        digits = F.filter(F.slice(lexemes, begin + 1, end - begin), lambda x: x.rlike("^[0-9]"))
        # A number beyond the type is the largest there is: it still bounds.
        values = F.transform(digits, lambda n: F.coalesce(n.try_cast("bigint"), F.lit(2**63 - 1)))
        left = F.concat(F.slice(lexemes, F.lit(1), begin), F.slice(lexemes, end + 1, F.size(lexemes)))
        return let(tier, lambda t: F.struct(
            t.alias("tier"),
            F.when(t.isin([k for k, bound in KINDS.items() if bound != UPPER]), F.array_min(values)).alias("lower"),
            F.when(t.isin([k for k, bound in KINDS.items() if bound != LOWER]), F.array_max(values)).alias("upper"),
            F.coalesce(F.nullif(collapse_spaces(F.array_join(left, "")), F.lit("")), q).alias("rest"),
        ))

    return let(text, lambda q: let(
        F.regexp_extract_all(q, F.lit(spec.lexeme()), F.lit(0)),
        lambda lexemes: let(F.transform(lexemes, letter), lambda codes: decide(q, lexemes, codes)),
    ))


def extract_constraints(
    df: DataFrame, text_col: str = "query", spec: ConstraintSpec = ConstraintSpec(), prefix: str = "ext"
) -> DataFrame:
    """Adds ``{prefix}_tier``, ``{prefix}_min``, ``{prefix}_max`` and ``{prefix}_text``."""
    return (
        df.withColumn("__found", constraint(F.col(text_col), spec))
        .withColumns(
            {
                f"{prefix}_tier": F.col("__found.tier"),
                f"{prefix}_min": F.col("__found.lower"),
                f"{prefix}_max": F.col("__found.upper"),
                f"{prefix}_text": F.col("__found.rest"),
            }
        )
        .drop("__found")
    )


def merge_lower(explicit: Column, extracted: Column) -> Column:
    """The tighter of two lower bounds; a missing one does not count."""
    return F.greatest(explicit, extracted)


def merge_upper(explicit: Column, extracted: Column) -> Column:
    return F.least(explicit, extracted)


def with_query_columns(queries: DataFrame) -> DataFrame:
    """Adds the optional filter columns a query table leaves out, as NULL."""
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in (
            ("min_atk", "bigint"), ("max_atk", "bigint"), ("min_def", "bigint"), ("max_def", "bigint"),
            ("level", "bigint"), ("attribute", "string"), ("card_type", "string"), ("limit", "int"),
        )
        if name not in queries.columns
    }
    return queries.withColumns(missing) if missing else queries


def prepare_queries(queries: DataFrame, spec: ConstraintSpec = ConstraintSpec()) -> DataFrame:
    """Adds ``search_text, eff_min, eff_max, contradictory`` to a query table."""
    found = extract_constraints(with_query_columns(queries), "query", spec)
    merged = found.withColumns(
        {
            "search_text": F.col("ext_text"),
            "eff_min": merge_lower(F.col("min_atk").cast("bigint"), F.col("ext_min")),
            "eff_max": merge_upper(F.col("max_atk").cast("bigint"), F.col("ext_max")),
        }
    ).drop("ext_tier", "ext_min", "ext_max", "ext_text")
    return merged.withColumn("contradictory", F.coalesce(F.col("eff_min") > F.col("eff_max"), F.lit(False)))
